"""Import resolution of JavaScript and TypeScript by the workspace's own manifests.

Configurations inherit over a tree; every configuration's effective options are
the least-ranked definition on its way up, found by following ``extends`` for
all configurations at once. Every import becomes candidate paths in tiers
(relative, alias substitutions in order, base folder, workspace packages); one
join with the listing keeps those that exist, and the first tier with a file
decides. Nothing is read on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.text import resolve_relative
from codeloom.operators.resolve import NODE_BUILTINS, _folder, _js_candidates
from codeloom.plans.shared import materialize

LENIENT = {"allowComments": "true", "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "bad"}
CONFIG = "extends string, compilerOptions struct<baseUrl:string,paths:map<string,array<string>>>, bad string"
PACKAGE = "name string, exports string, module string, main string, tsconfig string, workspaces string, dependencies map<string,string>, devDependencies map<string,string>, peerDependencies map<string,string>, optionalDependencies map<string,string>, bad string"
# The conditions of an export, in the order in which they are taken.
CONDITIONS = ("import", "default", "require", "types")


def _json(content: Column, schema: str) -> Column:
    """A JSON document with comments and commas before an end."""
    return F.from_json(F.regexp_replace(content, r",(\s*[}\]])", "$1"), schema, LENIENT)


def _listed(raw: Column) -> Column:
    """A string, or a list of strings, as a list."""
    return F.when(raw.startswith("["), F.from_json(raw, "array<string>")).when(raw.isNotNull(), F.array(raw))


def _under(folder: Column, path: Column) -> Column:
    return resolve_relative(folder, path)


def configs(files: DataFrame) -> DataFrame:
    """Effective options of every ``*.json`` configuration among ``files`` (path, content): path, folder, base (baseUrl's folder), paths_base, paths and problem.

    An own option wins over an inherited one, a later ``extends`` over an
    earlier; ``paths`` replace each other whole; ``baseUrl`` belongs to the
    folder where it is written. A circle, a missing parent and a document that
    is no JSON are problems, and leave no options.
    """
    named = files.filter(F.col("path").rlike(r"(?:^|/)[^/]*\.json\z"))
    parsed = named.select("path", _folder(F.col("path")).alias("folder"), _json(F.col("content"), CONFIG).alias("c"))
    base = F.when(F.col("c.compilerOptions.baseUrl").isNotNull(), _under(F.col("folder"), F.col("c.compilerOptions.baseUrl")))
    own = materialize(parsed.select("path", "folder", _listed(F.col("c.extends")).alias("extends"), base.alias("base"), F.col("c.compilerOptions.paths").alias("paths"), (F.col("c.bad").isNotNull() | F.col("c").isNull()).alias("bad")), "configs")
    known = own.select("path")
    asked = own.select("path", "folder", F.size("extends").alias("n"), F.posexplode("extends").alias("i", "ref"))
    at = F.when(F.col("ref").startswith("."), _under(F.col("folder"), F.col("ref"))).otherwise(F.concat(F.lit("node_modules/"), F.col("ref")))
    packages = named.filter(F.col("path").rlike(r"(?:^|/)package\.json\z")).select(_folder(F.col("path")).alias("at"), F.coalesce(_json(F.col("content"), PACKAGE)["tsconfig"], F.lit("tsconfig.json")).alias("entry"))
    asked = asked.withColumn("at", at).join(packages, "at", "left")
    # A file with its ending, else with .json, else a package's own configuration.
    tries = F.array(F.when(F.col("at").endswith(".json"), F.col("at")), F.when(~F.col("at").endswith(".json"), F.concat("at", F.lit(".json"))), F.when(~F.col("at").endswith(".json"), F.concat_ws("/", "at", F.coalesce("entry", F.lit("tsconfig.json")))))
    tried = asked.select("path", "i", "n", F.posexplode(tries).alias("k", "parent")).filter("parent is not null")
    met = tried.join(known.withColumnRenamed("path", "parent"), "parent").groupBy("path", "i", "n").agg(F.min(F.struct("k", "parent")).alias("p"))
    ups = materialize(asked.select("path", "i", "n").join(met, ["path", "i", "n"], "left").select("path", (F.col("n") - F.col("i")).alias("rank"), F.col("p.parent").alias("parent")), "extends")
    # Each configuration's ways up, all at once; a way's ranks order what it defines.
    frontier = own.select(F.col("path").alias("config"), "path", F.array().cast("array<int>").alias("way"), F.array("path").alias("visited"), F.lit(None).cast("string").alias("problem"))
    ways = frontier
    while True:
        up = frontier.filter("problem is null").join(ups, "path")
        problem = F.when(F.col("parent").isNull(), "tsconfig_extends_not_found").when(F.array_contains("visited", F.col("parent")), "circular_tsconfig_extends")
        step = up.select("config", F.col("parent").alias("path"), F.concat("way", F.array("rank")).alias("way"), F.concat("visited", F.array("parent")).alias("visited"), problem.alias("problem"))
        frontier = materialize(step, "config-ways")
        if frontier.isEmpty():
            break
        ways = ways.unionByName(frontier)
    defined = ways.join(own.select("path", F.col("folder").alias("where"), "base", "paths", "bad"), "path", "left")
    first = lambda c, *more: F.min_by(F.struct(c, *more), F.when(F.col(c).isNotNull(), F.col("way")))
    merged = defined.groupBy("config").agg(first("base").alias("b"), first("paths", "where").alias("p"), F.max(F.coalesce("problem", F.when(F.col("bad"), "malformed_tsconfig"))).alias("problem"))
    good = F.col("problem").isNull()
    return merged.select(
        F.col("config").alias("path"), _folder(F.col("config")).alias("folder"), F.when(good, F.col("b.base")).alias("base"), F.when(good, F.col("p.where")).alias("paths_base"), F.when(good, F.col("p.paths")).alias("paths"), "problem"
    )


def nearest(sources: DataFrame, found: DataFrame, name: str = "tsconfig.json") -> DataFrame:
    """``sources`` (source) with the columns of the configuration called ``name`` in the nearest folder above, null where none is."""
    own = found.filter(F.element_at(F.split("path", "/"), -1) == name).withColumnRenamed("path", "config")
    parts = F.split(_folder(F.col("source")), "/")
    above = F.array_union(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")))
    each = sources.select("source").distinct().select("source", F.explode(above).alias("folder"))
    best = each.join(own, "folder").withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy(F.desc(F.length("folder"))))).filter("k = 1").drop("k")
    return sources.join(best, "source", "left")


def _entries(packages: DataFrame) -> DataFrame:
    """(package, folder, key, entry, conditional) of every export of (folder, p); keys begin with a dot."""
    exports = F.col("p.exports")
    table = F.when(exports.startswith("{"), F.from_json(exports, "map<string,string>")).when(exports.isNotNull(), F.create_map(F.lit("."), exports))
    rows = packages.filter(exports.isNotNull()).select(F.col("p.name").alias("package"), "folder", F.explode(table).alias("key", "raw"))
    inner = F.from_json("raw", "map<string,string>")
    picked = F.coalesce(*[F.try_element_at(inner, F.lit(c)) for c in CONDITIONS])
    entry = F.when(F.col("raw").startswith("{"), F.when(~picked.startswith("{"), picked)).otherwise(F.col("raw"))
    return rows.select("package", "folder", "key", entry.alias("entry"), (F.col("raw").startswith("{") & entry.isNull()).alias("conditional"))


def _alias(target: Column, paths: Column) -> Column:
    """The first alias that fits: exact ones, then those with the longest text before their one star; a struct of key and substituted values."""
    star = lambda k: F.instr(k, "*")
    head = lambda k: F.substring(k, F.lit(1), star(k) - 1)
    tail = lambda k: F.substring(k, star(k) + 1, F.length(k))

    def fits(e):
        k = e["key"]
        return ((star(k) == 0) & (target == k)) | ((star(k) > 0) & (F.instr(tail(k), "*") == 0) & F.startswith(target, head(k)) & F.endswith(target, tail(k)) & (F.length(target) >= F.length(k) - 1))

    met = F.filter(F.map_entries(paths), fits)
    ranked = F.array_sort(F.transform(met, lambda e: F.struct(F.when(star(e["key"]) == 0, F.lit(-(1 << 30))).otherwise(-star(e["key"])).alias("r"), e["key"].alias("key"), e["value"].alias("value"))))
    best = F.get(ranked, F.lit(0))
    k = best["key"]
    middle = F.when(star(k) > 0, F.substring(target, star(k), F.length(target) - F.length(k) + 1)).otherwise("")
    return F.when(k.isNotNull(), F.struct(k.alias("key"), F.transform(best["value"], lambda v: F.concat(F.substring_index(v, "*", 1), F.when(F.instr(v, "*") > 0, F.concat(middle, F.substring(v, F.instr(v, "*") + 1, F.length(v)))).otherwise(""))).alias("values")))


def resolve_js(imports: DataFrame, files: DataFrame, nested: str = "unsupported") -> DataFrame:
    """``imports`` (source, target) with status, reason and files, by the manifests among ``files`` (path, content).

    ``nested`` says what a configuration nearer than the root's means:
    ``unsupported``, or ``nearest`` to resolve by it. An alias that fits and
    names no file leaves the import to workspace packages; a package's exports
    are taken by their key, then by the pattern with the longest text before
    its star. Null targets are unresolved.
    """
    listing = materialize(files.select("path").distinct(), "listing")
    manifests = materialize(files.filter(F.col("path").rlike(r"\.json\z")).select("path", "content"), "manifests")
    found = materialize(configs(manifests), "configs")
    rows = materialize(nearest(imports.select("source", "target").distinct(), found), "js-imports").withColumn("here", _folder(F.col("source")))
    target = F.col("target")
    relative = target.startswith(".") | target.startswith("/")
    bare = F.regexp_replace(target, "^(?:node|bun):", "")
    package = F.regexp_extract(target, r"^((?:@[^/]+/)?[^/]+)", 1)
    joined = resolve_relative(F.col("here"), target)
    alias = _alias(target, F.col("paths"))
    at = F.coalesce("base", "paths_base", F.lit(""))
    local = F.when(target.startswith("@/"), F.concat(F.lit("src/"), F.substring(target, F.lit(3), F.length(target)))).otherwise(target)

    # The root's manifest: declared packages and which folders are workspaces.
    every = manifests.filter(F.col("path").rlike(r"(?:^|/)package\.json\z")).select("path", _folder(F.col("path")).alias("folder"), _json(F.col("content"), PACKAGE).alias("p"))
    every = materialize(every, "packages")
    root = every.filter("path = 'package.json'")
    patterns = root.select(F.explode(_listed(F.coalesce(F.get_json_object("p.workspaces", "$.packages"), F.col("p.workspaces")))).alias("pattern"))
    parent = F.regexp_extract("folder", r"^(.*)/[^/]+\z", 1)
    keyed = every.filter("folder <> ''").select("folder", "p", F.explode(F.array(F.col("folder"), F.concat(parent, F.lit("/*")))).alias("pattern"))
    inside = materialize(keyed.join(patterns.select(F.regexp_replace("pattern", r"^\./", "").alias("pattern")), "pattern", "left_semi").select("folder", "p").dropDuplicates(["folder"]), "workspaces")
    declared = root.select(F.explode(F.array("p.dependencies", "p.devDependencies", "p.peerDependencies", "p.optionalDependencies")).alias("d")).filter("d is not null").select(F.explode(F.map_keys("d")).alias("package")).distinct().withColumn("declared", F.lit(True))
    entries = materialize(_entries(inside), "entries")

    say = lambda status, reason: F.struct(F.lit(status).alias("status"), reason.alias("reason"))
    decided = (
        F.when(target.isNull(), say("unresolved", F.lit("no_target")))
        .when(relative & joined.isNull(), say("unsupported", F.lit("outside_workspace")))
        .when(~relative & (bare.isin(*NODE_BUILTINS) | target.rlike("^(?:node|bun):")), say("external", F.lit("runtime_builtin")))
        .when(~relative & (F.coalesce("folder", F.lit("")) != "") & F.lit(nested == "unsupported"), say("unsupported", F.lit("nested_tsconfig_project_selection_unknown")))
        .when(~relative & F.col("problem").isNotNull(), say("unsupported", F.concat(F.lit("manifest_or_source_error: "), "problem")))
    )
    rows = materialize(rows.select("source", "target", "here", decided.alias("decided"), alias.alias("alias"), at.alias("at"), "base", relative.alias("relative"), joined.alias("joined"), local.alias("local"), package.alias("package")), "js-rows")
    todo = rows.filter("decided is null")

    # Tiers: 0 relative, then each substitution of the alias, the base folder, the workspace's own paths.
    one = lambda tier, path, reason: F.struct(F.lit(tier).alias("tier"), _js_candidates(path).alias("paths"), F.lit(reason).alias("reason"))
    by_alias = F.transform(F.col("alias.values"), lambda v, i: F.struct((i + 1).alias("tier"), _js_candidates(_under(F.col("at"), v)).alias("paths"), F.lit("tsconfig_paths").alias("reason")))
    plain = F.when(F.col("relative"), F.array(one(0, F.col("joined"), "relative_path"))).when(F.col("alias").isNotNull(), by_alias).when(F.col("base").isNotNull(), F.array(one(1000, _under(F.col("base"), F.col("target")), "tsconfig_baseurl"))).otherwise(F.array(one(1000, F.col("local"), "workspace_path")))
    tried = todo.select("source", "target", F.explode(plain).alias("t")).select("source", "target", "t.tier", "t.reason", F.explode(F.array_distinct("t.paths")).alias("path")).filter("path is not null")
    # Workspace packages: the export of the asked key, else a pattern, else the package's own entry.
    names = inside.select(F.col("p.name").alias("package"), "folder", F.coalesce("p.module", "p.main", F.lit("index")).alias("entry"))
    sub = F.regexp_replace(F.substring("target", F.length("package") + 1, F.length("target")), "^/", "")
    of_package = todo.filter("not relative").join(names, "package").select("source", "target", "package", "folder", sub.alias("sub"), "entry")
    key = F.when(F.col("sub") == "", F.lit(".")).otherwise(F.concat(F.lit("./"), F.col("sub")))
    stars = entries.withColumn("star", F.instr("key", "*"))
    asked = materialize(of_package.withColumn("wanted", key), "js-packages")
    exact = asked.join(stars.filter("star = 0").select("package", "folder", "key", F.col("entry").alias("exported"), "conditional"), ["package", "folder"]).filter((F.col("key") == F.col("wanted")) | (F.col("key") == F.concat("wanted", F.lit(".js"))))
    exact = exact.select("source", "target", "folder", F.lit(0).alias("r"), F.length("key").alias("l"), "exported", "conditional")
    near = asked.join(stars.filter("star > 0").select("package", "folder", "key", "star", F.col("entry").alias("form")), ["package", "folder"])
    head, tail = F.substring(F.col("key"), F.lit(1), F.col("star") - 1), F.substring(F.col("key"), F.col("star") + 1, F.length("key"))
    near = near.filter(F.startswith(F.col("wanted"), head) & F.endswith(F.col("wanted"), tail) & (F.length("wanted") >= F.length("key") - 1))
    middle = F.substring(F.col("wanted"), F.col("star"), F.length("wanted") - F.length("key") + 1)
    near = near.select("source", "target", "folder", F.lit(1).alias("r"), (-F.col("star")).alias("l"), F.replace("form", F.lit("*"), middle).alias("exported"), F.lit(False).alias("conditional"))
    best = exact.unionByName(near).groupBy("source", "target", "folder").agg(F.min(F.struct("r", "l", "exported", "conditional")).alias("x"))
    chosen = asked.join(best, ["source", "target", "folder"], "left")
    unclear = chosen.filter((F.col("sub") == "") & F.col("x.conditional")).select("source", "target").distinct().withColumn("unclear", F.lit(True))
    own = chosen.select("source", "target", F.lit(2000).alias("tier"), F.lit("workspace_package").alias("reason"), F.explode(_js_candidates(_under(F.col("folder"), F.coalesce("x.exported", F.nullif("sub", F.lit("")), "entry")))).alias("path"))
    hits = tried.unionByName(own.filter("path is not null")).join(listing, "path", "left_semi")
    # All of the first tier with any file; several files there are ambiguous.
    ranked = hits.withColumn("least", F.min("tier").over(Window.partitionBy("source", "target"))).filter("tier = least")
    answers = ranked.groupBy("source", "target").agg(F.array_sort(F.collect_set("path")).alias("files"), F.min("reason").alias("by"))
    joined_rows = rows.join(answers, ["source", "target"], "left").join(unclear, ["source", "target"], "left").join(declared, "package", "left")
    many = F.size("files") > 1
    status = F.coalesce(F.col("decided.status"), F.when(many, "ambiguous").when(F.col("files").isNotNull(), "resolved").when(F.col("unclear"), "unsupported").when(~F.col("relative") & F.col("declared"), "external").otherwise("unresolved"))
    reason = F.coalesce(F.col("decided.reason"), F.when(F.col("files").isNotNull(), F.col("by")).when(F.col("unclear"), "conditional_package_exports").when(F.col("relative"), "file_not_found").when(F.col("declared"), "package_manifest_dependency").otherwise("package_not_declared"))
    out = joined_rows.select("source", "target", status.alias("status"), reason.alias("reason"), F.coalesce("files", F.array().cast("array<string>")).alias("files"))
    back = imports.join(out.withColumnRenamed("source", "s_").withColumnRenamed("target", "t_"), F.col("source").eqNullSafe(F.col("s_")) & F.col("target").eqNullSafe(F.col("t_")), "left")
    return back.drop("s_", "t_")
