"""Resolution without a workspace at hand: an import's text against the indexed catalog alone.

Each way of resolving is a generator of keys with a rank. All keys of all
imports meet one index in one join, and the least rank decides, instead of a
join for every step. Imports of one folder and text are asked once, so a
target that everyone imports is one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import resolve_relative
from codeloom.operators.resolve import Rules, _aliased, _folder


def _cleaned(target: Column) -> Column:
    """A target without blanks and quotes around it, with ``/`` separators."""
    return F.replace(F.regexp_replace(F.trim(target), "^['\"]|['\"]\\z", ""), F.lit("\\"), F.lit("/"))


def _bare(path: Column) -> Column:
    """A path without its last ending."""
    return F.regexp_replace(path, r"\.[^/.]+\z", "")


def _key(rank: int, kind: str, key: Column, when: Column | None = None) -> Column:
    """A struct of a generator; null where it does not apply."""
    made = F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), key.alias("key"))
    held = key.isNotNull() & (key != "")
    return F.when(held if when is None else held & when, made)


def path_index(files: DataFrame) -> DataFrame:
    """(kind, key, path): every file by its path, by its path without ending (and ``/index``), and by every end of that after a slash.

    Case is ignored. Of several files of one key the last by path counts; of
    several keys with one end the one that came first.
    """
    paths = files.select("path", F.regexp_replace(F.replace("path", F.lit("\\"), F.lit("/")), r"^\./", "").alias("norm")).withColumn("low", F.lower("norm"))
    whole = paths.groupBy(F.col("low").alias("key")).agg(F.max("path").alias("path")).select(F.lit("path").alias("kind"), "key", "path")
    stem = F.lower(_bare(F.col("norm")))
    stems = paths.select("path", F.posexplode(F.filter(F.array(stem, F.when(stem.endswith("/index"), F.regexp_replace(stem, r"/index\z", ""))), lambda s: s.isNotNull())).alias("place", "key"))
    keyed = stems.groupBy("key").agg(F.max("path").alias("path"), F.min(F.struct("path", "place")).alias("first"))
    parts = F.split("key", "/")
    ends = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(2), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "/"))).otherwise(F.array().cast("array<string>"))
    tails = keyed.select("path", "first", F.explode(ends).alias("end")).groupBy(F.col("end").alias("key")).agg(F.min_by("path", "first").alias("path"))
    return whole.unionByName(keyed.select(F.lit("stem").alias("kind"), "key", "path")).unionByName(tails.select(F.lit("end").alias("kind"), "key", "path"))


def resolve_files(imports: DataFrame, files: DataFrame) -> DataFrame:
    """``imports`` (source, target) with the file that the target names and the step that found it (1 to 5), else null.

    A relative target by its whole path (1) or without ending (2); any target,
    ``@/`` being ``src/``, by its path (3), without ending (4), or as the end of a
    path (5).
    """
    asked = imports.select(_folder(F.col("source")).alias("folder"), "target").distinct().withColumn("c", _cleaned(F.col("target")))
    dotted = F.col("c").startswith(".")
    joined = F.lower(resolve_relative(F.col("folder"), F.col("c")))
    alias = F.lower(F.regexp_replace(F.regexp_replace("c", "^@/", "src/"), r"^\./", ""))
    keys = F.array(_key(1, "path", joined, dotted), _key(2, "stem", _bare(joined), dotted), _key(3, "path", alias), _key(4, "stem", _bare(alias)), _key(5, "end", alias))
    tried = asked.select("folder", "target", F.explode(F.filter(keys, lambda k: k.isNotNull())).alias("k")).select("folder", "target", "k.rank", "k.kind", "k.key")
    best = tried.join(path_index(files), ["kind", "key"]).groupBy("folder", "target").agg(F.min(F.struct("rank", "path")).alias("b"))
    found = best.select("folder", "target", F.col("b.path").alias("file"), F.col("b.rank").alias("step"))
    return imports.withColumn("folder", _folder(F.col("source"))).join(found, ["folder", "target"], "left").drop("folder")


def _above(path: Column) -> Column:
    """A path and every folder around it."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def resolve_domains(imports: DataFrame, domains: DataFrame, files: DataFrame, symbols: DataFrame, packages: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """``imports`` (source, target) with the domain that the target lies in and the step that found it, else null.

    Steps: a relative path (1), a package's name (2), a dotted path (3), an alias
    (4), a PSR-4 prefix (5), an indexed file (6), a symbol with a capital as the last part (7), and a domain's root
    among the target's folders (8, of the first domain). A path lies in the
    domain with the longest root around it. ``domains`` has name, root and
    place; ``files`` path and domain; ``symbols`` name and domain; ``packages``
    name and domain.
    """
    asked = imports.select(_folder(F.col("source")).alias("folder"), "target").distinct().withColumn("c", F.regexp_replace(F.trim("target"), "^['\"]|['\"]\\z", ""))
    c, folder = F.col("c"), F.col("folder")
    dots = F.length(F.regexp_extract(c, r"^(\.+)", 1))
    slashed = c.startswith("./") | c.startswith("../")
    rest = F.replace(F.substring(c, dots + 1, F.length(c)), F.lit("."), F.lit("/"))
    up = F.concat_ws("/", F.when(dots > 1, F.array_join(F.array_repeat(F.lit(".."), dots - 1), "/")), F.nullif(rest, F.lit("")))
    relative = F.when(slashed, resolve_relative(folder, c)).when(c.startswith("."), resolve_relative(folder, up))
    dotted = F.when(c.contains(".") & ~c.contains("/"), resolve_relative(F.lit(""), F.replace(c, F.lit("."), F.lit("/"))))
    aliased = F.get(_aliased(c, rules), F.lit(0))
    psr = F.lit(None).cast("string")
    for prefix in sorted(rules.psr4, key=len):
        to = F.concat(F.lit(rules.psr4[prefix][0].rstrip("/") + "/"), F.replace(F.substring(c, F.lit(len(prefix) + 1), F.length(c)), F.lit("\\"), F.lit("/")))
        psr = F.when(F.startswith(c, F.lit(prefix)), to).otherwise(psr)

    def paths(rank: int, path: Column) -> Column:
        return F.when(path.isNotNull() & (path != ""), F.transform(_above(path), lambda p: F.struct(F.lit(rank).alias("rank"), F.lit("root").alias("kind"), p.alias("key"), (-F.length(p)).alias("fit"))))

    def single(rank: int, kind: str, keys: Column) -> Column:
        return F.transform(keys, lambda k: F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), k.alias("key"), F.lit(0).alias("fit")))

    low = F.lower(F.replace(c, F.lit("\\"), F.lit("/")))
    parts = F.split(low, "/")
    # From the first folder on any end; from a later one, an end before the last.
    inner = F.flatten(
        F.transform(
            F.sequence(F.lit(1), F.size(parts)),
            lambda a: F.transform(F.filter(F.sequence(a, F.size(parts)), lambda b: (a == 1) | (b < F.size(parts))), lambda b: F.array_join(F.slice(parts, a, b - a + 1), "/")),
        )
    )
    named = F.regexp_extract(c, r"(?:^|[\\/])([A-Z][A-Za-z0-9_]*)[\\/]*\z", 1)
    generators = [
        paths(1, relative), single(2, "package", _above(c)), paths(3, dotted), paths(4, aliased), paths(5, psr), single(6, "file", F.array(c, F.replace(c, F.lit("\\"), F.lit("/")))),
        single(7, "symbol", F.array(named)), F.when(c.contains("/") & ~c.startswith(".") & ~c.startswith("/"), single(8, "low", inner)),
    ]
    none = F.array().cast("array<struct<rank:int,kind:string,key:string,fit:int>>")
    keys = F.array_distinct(F.concat(*[F.coalesce(g.cast("array<struct<rank:int,kind:string,key:string,fit:int>>"), none) for g in generators]))
    tried = asked.filter("c <> ''").select("folder", "target", F.explode(keys).alias("k")).select("folder", "target", "k.rank", "k.kind", "k.key", "k.fit").filter("key <> ''")
    roots = domains.select(F.regexp_replace("root", r"^\./|/\z", "").alias("key"), F.col("name").alias("domain"), "place")
    flat = lambda df, kind, column: df.groupBy(F.col(column).alias("key")).agg(F.min("domain").alias("domain")).select(F.lit(kind).alias("kind"), "key", "domain", F.lit(0).alias("place"))
    index = roots.select(F.lit("root").alias("kind"), "key", "domain", "place").unionByName(roots.select(F.lit("low").alias("kind"), F.lower("key").alias("key"), "domain", "place"))
    places = domains.select(F.col("name").alias("domain"), "place")
    index = index.unionByName(packages.withColumnRenamed("name", "key").join(places, "domain").select(F.lit("package").alias("kind"), "key", "domain", "place"))
    index = index.unionByName(flat(files, "file", "path")).unionByName(flat(symbols, "symbol", "name"))
    best = tried.join(index, ["kind", "key"]).groupBy("folder", "target").agg(F.min(F.struct("rank", "fit", "place", "domain")).alias("b"))
    found = best.select("folder", "target", F.col("b.domain").alias("domain"), F.col("b.rank").alias("step"))
    return imports.withColumn("folder", _folder(F.col("source"))).join(found, ["folder", "target"], "left").drop("folder")
