"""Relational operators over catalog tables: lookups, members, impact, hotspots, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_domain(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Symbols with their file's path and domain."""
    return symbols.join(files.select("file_id", "path", "domain"), "file_id")


def hotspots(symbols: DataFrame, by: str = "risk", min_lines: int = 30, min_nesting: int = 1, limit: int = 30, domain: str | None = None, kind: str | None = None) -> DataFrame:
    """The symbols that are riskiest, longest or most nested; ties go by name, path and place."""
    rows = symbols.filter((F.col("line_count") >= min_lines) & (F.col("nesting_depth") >= min_nesting))
    if domain is not None:
        rows = rows.filter(F.lower("domain") == domain.lower())
    if kind is not None:
        rows = rows.filter(F.col("kind") == kind)
    risk = F.col("line_count") * (F.lit(1.0) + F.col("nesting_depth") * F.lit(0.3))
    rows = rows.withColumn("risk_score", F.floor(risk + 0.5).cast("bigint")).withColumn("risk", F.round(risk, 6))
    first = {"risk": ["risk", "nesting_depth"], "lines": ["line_count", "nesting_depth"], "nesting": ["nesting_depth", "line_count"]}[by]
    return rows.orderBy(*[F.desc(c) for c in first], "name", "path", "line_start", "line_end", "visibility").limit(limit)


def members(symbols: DataFrame) -> DataFrame:
    """Counts and ordered names of each container's methods and properties, per file."""
    rows = symbols.filter("container is not null")
    names = lambda kind: F.array_join(F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("name")))), ",")
    return rows.groupBy("file_id", "container").agg(names("method").alias("methods"), names("property").alias("properties"), F.count("*").alias("n_members"))


def enclosing(lines: DataFrame, symbols: DataFrame) -> DataFrame:
    """The innermost symbol around each (file_id, line): an equi-join on the file, then the shortest span.

    The span decides, then place and name; the join is an interval only within
    a file, so it is as large as a file's own symbols.
    """
    spans = symbols.select("file_id", "name", "line_start", "line_end")
    met = lines.join(spans, "file_id").filter("line between line_start and line_end")
    rank = F.struct((F.col("line_end") - F.col("line_start")).alias("span"), "line_start", "name")
    return met.groupBy("file_id", "line").agg(F.min(rank).alias("best")).select("file_id", "line", F.col("best.name").alias("name"), F.col("best.span").alias("span"))


def longest_prefix(paths: DataFrame, path: str, domains: DataFrame) -> DataFrame:
    """The domain whose root is the longest folder prefix of each path; null when none is.

    Each path meets the roots by equality, on the path itself and its folders.
    """
    parts = F.split(path, "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    each = paths.select(path).filter(F.col(path).isNotNull()).distinct().withColumn("root", F.explode(folders))
    met = each.join(domains.select(F.col("name").alias("owner"), F.col("root_path").alias("root")), "root")
    best = met.groupBy(path).agg(F.max_by("owner", F.struct(F.length("root"), "owner")).alias("owner"))
    return paths.join(best, path, "left")


def contains_ignoring_case(text: Column, part: str) -> Column:
    """``LIKE '%part%'`` without case, where ``%`` and ``_`` in the part mean themselves."""
    return F.contains(F.lower(text), F.lit(part.lower()))


def word_references(rows: DataFrame, text: Column, word: str) -> DataFrame:
    """Rows whose text has ``word`` between word boundaries; a cheap substring test comes first."""
    quoted = "\\Q" + word.replace("\\E", "\\E\\\\E\\Q") + "\\E"
    return rows.filter(contains_ignoring_case(text, word) & text.rlike(rf"\b{quoted}\b"))


def impact(edges: DataFrame, files: DataFrame) -> DataFrame:
    """Per target: dependents, distinct files and domains, and a risk (more than 5 files or 2 domains high, from 2 of either medium)."""
    rows = edges.join(files.select(F.col("file_id").alias("source_id"), "path", "domain"), "source_id")
    counted = rows.groupBy("target").agg(F.count("*").alias("dependents"), F.countDistinct("path").alias("n_files"), F.countDistinct("domain").alias("n_domains"))
    risk = F.when((F.col("n_files") > 5) | (F.col("n_domains") > 2), "high").when((F.col("n_files") >= 2) | (F.col("n_domains") >= 2), "medium").otherwise("low")
    return counted.withColumn("risk", risk)


def inbound(edges: DataFrame, top: int = 5) -> DataFrame:
    """Per file of an edge list: inbound files, a level (5 high, 2 medium) and the first consumers.

    Only the first consumers of a file are gathered; each source is counted once.
    """
    once = edges.select(F.col("dst").alias("file"), "src").distinct()
    counted = once.groupBy("file").agg(F.count("src").alias("n_inbound"))
    first = once.withColumn("k", F.row_number().over(Window.partitionBy("file").orderBy(F.col("src").asc_nulls_last()))).filter(F.col("k") <= top)
    shown = first.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list("src")), lambda x: x.cast("string")), ",").alias("consumers"))
    level = F.when(F.col("n_inbound") >= 5, "high").when(F.col("n_inbound") >= 2, "medium").otherwise("low")
    return counted.join(shown, "file").select("file", "n_inbound", level.alias("level"), "consumers")


def connections(edges: DataFrame) -> DataFrame:
    """Per file: how many files it imports, how many import it, and both lists in order; one shuffle of the edges in both directions."""
    both = edges.select(F.col("src").alias("file"), F.col("dst").alias("to"), F.lit(None).cast("bigint").alias("by")).unionByName(edges.select(F.col("dst").alias("file"), F.lit(None).cast("bigint").alias("to"), F.col("src").alias("by")))
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.collect_set(c)), lambda x: x.cast("string")), ",")
    return both.groupBy("file").agg(listed("to").alias("imports"), listed("by").alias("imported_by"), F.countDistinct("to").alias("n_imports"), F.countDistinct("by").alias("n_imported_by"))


def last_wins(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the last by ``order``."""
    rank = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__k", F.row_number().over(rank)).filter("__k = 1").drop("__k")


def snapshot_diff(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """Each key of two snapshots with its status: added, deleted, modified or unchanged."""
    a, b = old.select(key, F.col(digest).alias("old")), new.select(key, F.col(digest).alias("new"))
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") != F.col("new"), "modified").otherwise("unchanged")
    return a.join(b, key, "full").select(key, status.alias("status"))


def replace_rows(base: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """The base without the keys that ``fresh`` has, and all of ``fresh``: a file's rows change as a unit."""
    return base.join(fresh.select(key).distinct(), key, "left_anti").unionByName(fresh)


def suggest(targets: DataFrame, name: str, query: str, limit: int = 10, least: float = 0.3) -> DataFrame:
    """Names most like a query: OSA similarity with prefix, substring and word bonuses."""
    from codeloom.functions.similarity import similarity

    return targets.select(F.col(name).alias("name")).distinct().withColumn("score", F.round(similarity(F.lit(query), F.col("name")), 4)).filter(F.col("score") >= least).orderBy(F.desc("score"), "name").limit(limit)


#: The columns that tell one declaration from every other.
IDENTITY = ("path", "name", "kind", "signature", "line_start", "line_end", "content_hash", "language")


def same_identity(actual: DataFrame, wanted: DataFrame, columns: tuple[str, ...] = IDENTITY) -> DataFrame:
    """Rows of ``actual`` that a row of ``wanted`` equals in all identity columns; null equals null."""
    asked = wanted.select(*[F.col(c).alias(f"__{c}") for c in columns]).distinct()
    alike = F.lit(True)
    for c in columns:
        alike = alike & F.col(c).eqNullSafe(F.col(f"__{c}"))
    return actual.join(asked, alike, "left_semi")


def reuse_members(names: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """Each requested ``name`` with its symbol's kind, path, domain, methods and properties.

    Of several symbols of a name the first by path and line counts; its members
    are the file's ``name::...``, in order of lines. A name without a symbol is
    of kind ``unknown``.
    """
    asked = names.select("name").distinct()
    roots = symbols.join(asked, "name", "left_semi").join(files.select("file_id", "path", "domain"), "file_id")
    first = roots.groupBy("name").agg(F.min(F.struct("path", "line_start", "file_id", "kind", "domain")).alias("r")).select("name", "r.file_id", "r.kind", "r.path", "r.domain")
    parts = F.split("name", "::")
    holders = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "::"))
    shown = F.col("signature" if "signature" in symbols.columns else "name").alias("member")
    own = symbols.filter(F.contains("name", F.lit("::"))).select("file_id", shown, F.col("kind").alias("member_kind"), F.col("line_start").alias("at"), F.explode(holders).alias("name"))
    met = first.select("name", "file_id").join(own, ["name", "file_id"])
    listed = lambda kind: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("member_kind") == kind, F.struct("at", "member")))), lambda m: m["member"]), ",")
    members_of = met.groupBy("name").agg(listed("method").alias("methods"), listed("property").alias("properties"))
    out = asked.join(first.drop("file_id"), "name", "left").join(members_of, "name", "left")
    return out.select("name", F.coalesce("kind", F.lit("unknown")).alias("kind"), "path", "domain", F.coalesce("methods", F.lit("")).alias("methods"), F.coalesce("properties", F.lit("")).alias("properties"))


def overlay(base: Column, over: Column) -> Column:
    """Two maps as one, where a key of the second replaces the first's; a null map is empty."""
    rest = F.map_filter(base, lambda k, _: ~F.array_contains(F.map_keys(over), k))
    return F.when(base.isNull(), over).when(over.isNull(), base).otherwise(F.map_concat(rest, over))
