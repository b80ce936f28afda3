"""Domains of repositories, from the shape of their folders.

Folders come from the paths of files: each file tells every folder above it
whether it holds sources. Rules propose domains in tiers, and a repository takes
its first tier that proposes any. All repositories are read together; a
repository's proposals are as many as its folders of two levels, whatever its
size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.plans.shared import materialize

# Folders of workspaces, of modules (in the order in which later ones win), and of layered code.
WORKSPACES = ("apps", "packages", "modules", "libs")
MODULAR = ("app/Domain", "app/Domains", "app/domain", "app/domains", "app/modules", "app/features", "src/domains", "src/domain", "src/features", "src/modules", "domains", "domain", "modules", "features")
STANDARD = ("src", "app", "lib")
# Names of layers.
SHARED = ("types", "shared", "common", "contracts")
CORE = ("core", "domain", "services", "usecase", "internal")
ADAPTERS = ("cli", "mcp", "api", "controllers", "routes", "handlers", "delivery")
LARAVEL = (("routes", "routes"), ("database", "database"), ("views", "resources/views"))
COLUMNS = ("repo", "tier", "style", "name", "root", "allowed", "forbidden", "place")


def folders(files: DataFrame) -> DataFrame:
    """(repo, folder, parent, name, depth, sources, direct) of every folder above a file of (repo, path, is_source); the repository's own has an empty path."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.struct(n.alias("depth"), F.when(n == 0, "").otherwise(F.array_join(F.slice(parts, 1, n), "/")).alias("folder")))
    rows = files.select("repo", "is_source", (F.size(parts) - 1).alias("own"), F.explode(above).alias("f"))
    met = rows.groupBy("repo", F.col("f.folder").alias("folder"), F.col("f.depth").alias("depth")).agg(F.max("is_source").alias("sources"), F.max(F.col("is_source") & (F.col("own") == F.col("f.depth"))).alias("direct"))
    cut = F.regexp_extract("folder", r"^(.*)/[^/]*\z", 1)
    return met.select("repo", "folder", cut.alias("parent"), F.element_at(F.split("folder", "/"), -1).alias("name"), "depth", F.coalesce("sources", F.lit(False)).alias("sources"), F.coalesce("direct", F.lit(False)).alias("direct"))


def _strings(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def _proposed(rows: DataFrame, tier: int, style: Column | str, allowed: Column | None = None, forbidden: Column | None = None) -> DataFrame:
    """Proposals of (repo, name, root, place) in the columns of :data:`COLUMNS`."""
    empty = _strings()
    style = F.lit(style) if isinstance(style, str) else style
    return rows.select("repo", F.lit(tier).alias("tier"), style.alias("style"), "name", "root", F.array_sort(F.coalesce(allowed if allowed is not None else empty, empty)).alias("allowed"), F.array_sort(F.coalesce(forbidden if forbidden is not None else empty, empty)).alias("forbidden"), "place")


def _workspaces(dirs: DataFrame, repos: DataFrame) -> DataFrame:
    own = dirs.filter((F.col("depth") == 2) & F.col("parent").isin(*WORKSPACES)).join(repos.filter("is_monorepo").select("repo"), "repo", "left_semi")
    low = F.lower("name")
    order = F.concat(F.array_position(_strings(*WORKSPACES), F.col("parent")).cast("string"), F.lit("/"), F.col("name"))
    rows = own.select("repo", "parent", F.col("folder").alias("root"), low.alias("low"), order.alias("place")).withColumn("n", F.count("*").over(Window.partitionBy("repo", "low")))
    rows = rows.withColumn("wanted", F.when(F.col("n") > 1, F.concat_ws("-", "parent", "low")).otherwise(F.col("low")))
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("repo", "wanted").orderBy("place")))
    rows = rows.withColumn("name", F.when(F.col("k") > 1, F.concat_ws("-", "wanted", "k")).otherwise(F.col("wanted")))
    apps = F.col("parent") == "apps"
    names = rows.groupBy("repo").agg(F.collect_set(F.when(apps, F.col("name"))).alias("apps"), F.collect_set(F.when(~apps, F.col("name"))).alias("others"))
    return _proposed(rows.join(names, "repo"), 1, "monorepo-workspaces", F.when(apps, F.col("others")), F.when(~apps, F.col("apps")))


def _modular(dirs: DataFrame) -> DataFrame:
    k = F.array_position(_strings(*MODULAR), F.col("parent"))
    found = dirs.filter(F.col("parent").isin(*MODULAR) & F.col("sources")).select("repo", "parent", F.lower("name").alias("name"), F.col("folder").alias("root"), k.alias("k"))
    # Of folders of one name the later place wins.
    last = found.groupBy("repo", "name").agg(F.max_by("root", F.struct("k", "root")).alias("root"), F.min("k").cast("string").alias("place"))
    own = _proposed(last, 2, "modular-ddd", _strings("common", "root", "shared"))
    around = found.filter(F.col("parent").contains("/")).groupBy("repo", F.regexp_extract("parent", "^([^/]+)", 1).alias("folder")).agg(F.max("k").alias("k"))
    top = around.join(dirs.filter("direct").select("repo", "folder"), ["repo", "folder"]).groupBy("repo").agg(F.max_by("folder", "k").alias("root"), F.max("k").alias("upto"))
    known = found.join(top.select("repo", "upto"), "repo").filter(F.col("k") <= F.col("upto")).groupBy("repo").agg(F.collect_set("name").alias("names"))
    root = top.join(known, "repo").select("repo", F.lit("root").alias("name"), "root", F.lit("~").alias("place"), "names")
    return own.unionByName(_proposed(root, 2, "modular-ddd", F.col("names")))


def _layered(dirs: DataFrame, repos: DataFrame) -> DataFrame:
    tops = dirs.filter(F.col("folder").isin(*STANDARD))
    subs = dirs.filter((F.col("depth") == 2) & F.col("parent").isin(*STANDARD) & F.col("sources"))
    listed = subs.groupBy("repo", F.col("parent").alias("folder")).agg(F.collect_set(F.lower("name")).alias("names"))
    first = tops.join(listed, ["repo", "folder"], "left").filter(F.col("names").isNotNull() | F.col("direct"))
    first = first.withColumn("k", F.row_number().over(Window.partitionBy("repo").orderBy(F.array_position(_strings(*STANDARD), F.col("folder"))))).filter("k = 1")
    first = first.join(repos.select("repo", "framework"), "repo", "left").select("repo", "folder", "names", "direct", F.when(F.col("framework").isin("mcp-server", "cli"), "cli-adapter").otherwise("layered-monolith").alias("style"))
    name, names = F.col("name"), F.col("names")
    layer = subs.withColumn("low", F.lower("name")).drop("direct", "sources").join(first.select("repo", F.col("folder").alias("parent"), "names", "style"), ["repo", "parent"])
    layer = layer.groupBy("repo", F.col("low").alias("name"), "names", "style").agg(F.max("folder").alias("root")).withColumn("place", F.col("name"))
    shared, core, adapters = (F.array_intersect(names, _strings(*g)) for g in (SHARED, CORE, ADAPTERS))
    kernel, inner = name.isin(*SHARED), name.isin(*CORE)
    allowed = F.when(kernel, _strings()).when(inner, shared).otherwise(F.array_union(shared, core))
    forbidden = F.when(kernel, F.array_union(adapters, core)).when(inner, adapters).otherwise(_strings())
    own = _proposed(layer, 3, F.col("style"), allowed, forbidden)
    roots = first.filter("names is not null and direct").select("repo", F.lit("root").alias("name"), F.col("folder").alias("root"), F.lit("~").alias("place"), "names", "style")
    flat = first.filter("names is null").select("repo", F.lit("app").alias("name"), F.col("folder").alias("root"), F.lit("").alias("place"))
    return own.unionByName(_proposed(roots, 3, F.col("style"), F.col("names"))).unionByName(_proposed(flat, 3, "layered-monolith"))


def _frameworks(dirs: DataFrame, repos: DataFrame) -> DataFrame:
    laravel = F.coalesce((F.col("language") == "php") | F.contains("framework", F.lit("laravel")), F.lit(False))
    php = repos.filter(laravel).select("repo")
    app = dirs.filter("folder = 'app'").join(php, "repo", "left_semi").select("repo", F.lit("app").alias("name"), F.lit("app").alias("root"), F.lit("0").alias("place"))
    found = _proposed(app, 4, "layered-monolith")
    for name, root in LARAVEL:
        rows = dirs.filter(F.col("folder") == root).join(php, "repo", "left_semi").select("repo", F.lit(name).alias("name"), F.lit(root).alias("root"), F.lit(f"1{name}").alias("place"))
        found = found.unionByName(_proposed(rows, 4, "layered-monolith"))
    go = repos.filter(~laravel & (F.col("language") == "go")).select("repo")
    own = dirs.join(go, "repo", "left_semi")
    pkg = own.filter("folder = 'pkg' and sources").select("repo", F.lit("pkg").alias("name"), F.lit("pkg").alias("root"), F.lit("0").alias("place"))

    def parted(top: str, prefix: str, place: str) -> DataFrame:
        """The folders in a folder, or that folder when it has sources of its own alone."""
        inside = own.filter((F.col("parent") == top) & (F.col("depth") == 2) & F.col("sources")).groupBy("repo", F.concat(F.lit(prefix), F.lower("name")).alias("name")).agg(F.max("folder").alias("root"))
        whole = own.filter((F.col("folder") == top) & F.col("sources")).join(inside.select("repo"), "repo", "left_anti").select("repo", F.lit(top).alias("name"), F.lit(top).alias("root"))
        return inside.unionByName(whole).withColumn("place", F.concat(F.lit(place), "name"))

    has_pkg = pkg.select("repo", _strings("pkg").alias("pkg"))
    internal, cmd = parted("internal", "", "1").join(has_pkg, "repo", "left"), parted("cmd", "cmd-", "2")
    before = pkg.select("repo", "name").unionByName(internal.select("repo", "name")).groupBy("repo").agg(F.collect_set("name").alias("names"))
    earlier = F.collect_list("name").over(Window.partitionBy("repo").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    cmd = cmd.withColumn("earlier", earlier).join(before, "repo", "left").withColumn("names", F.array_union(F.coalesce("names", _strings()), "earlier"))
    found = found.unionByName(_proposed(pkg, 4, "clean-architecture", None, _strings("cmd", "internal")))
    return found.unionByName(_proposed(internal, 4, "clean-architecture", F.col("pkg"), _strings("cmd"))).unionByName(_proposed(cmd, 4, "clean-architecture", F.col("names")))


def _tops(dirs: DataFrame) -> DataFrame:
    own = dirs.filter((F.col("depth") == 1) & F.col("sources")).groupBy("repo", F.lower("name").alias("name")).agg(F.max("folder").alias("root")).withColumn("place", F.col("name"))
    names = own.groupBy("repo").agg(F.collect_set("name").alias("names"))
    root = dirs.filter((F.col("depth") == 0) & F.col("direct")).join(names, "repo", "left").select("repo", F.lit("root").alias("name"), F.lit(".").alias("root"), F.lit("~").alias("place"), "names")
    return _proposed(own, 5, "generic").unionByName(_proposed(root, 5, "generic", F.col("names")))


def discover(files: DataFrame, repos: DataFrame) -> DataFrame:
    """(repo, tier, style, name, root, allowed, forbidden) of each repository's domains.

    ``files`` has repo, path and is_source, ignored ones left out; ``repos``
    repo, language, framework and is_monorepo. Names are unique in a
    repository, lists are sorted. A repository without sources has no domains.
    """
    dirs = materialize(folders(files), "folders")
    known = materialize(repos.select("repo", "language", "framework", "is_monorepo"), "repos")
    tiers = [_workspaces(dirs, known), _modular(dirs), _layered(dirs, known), _frameworks(dirs, known), _tops(dirs)]
    every = materialize(reduce(DataFrame.unionByName, tiers), "proposals")
    first = every.withColumn("least", F.min("tier").over(Window.partitionBy("repo"))).filter("tier = least")
    return first.select(*COLUMNS[:-1])


def archetypes(dirs: DataFrame, domains: DataFrame) -> DataFrame:
    """(repo, name, archetype, pattern) of domains: a folder each as ``folder/**`` without hidden ones, else all files as ``source``."""
    inside = dirs.filter(~F.col("name").startswith(".") & (F.col("depth") > 0)).select("repo", F.when(F.col("parent") == "", ".").otherwise(F.col("parent")).alias("root"), F.col("name").alias("sub"))
    rows = domains.select("repo", "name", "root").join(inside, ["repo", "root"], "left")
    named = rows.groupBy("repo", "name", F.lower("sub").alias("archetype")).agg(F.max("sub").alias("sub"))
    return named.select("repo", "name", F.coalesce("archetype", F.lit("source")).alias("archetype"), F.coalesce(F.concat("sub", F.lit("/**")), F.lit("**/*.*")).alias("pattern"))
