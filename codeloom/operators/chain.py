"""Execution chains: what a route's handler reaches over imports, in the order of a breadth-first search.

The search keeps discovery order: files found at a level are ordered by their
parent's place and then by the import's place, and the first discovery of a
file counts. A chain holds at most ``most`` nodes, so a search stops where its
budget ends: no chain carries more than that from one level to the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.text import http_verb, inferred_uri, stage_of, stage_rank
from codeloom.plans.shared import materialize

MOST, DEPTH, DEEPEST = 25, 5, 8
NODE = "struct<stage:string,symbol:string,file:string,line:int,via:string>"


def held_depth(depth: int | None) -> int:
    """Hops of a search: 0 and null mean the default, others are held between 1 and 8."""
    return min(max(int(depth or DEPTH), 1), DEEPEST)


def main_symbols(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file, stage, symbol, line) of each of ``files`` (path, archetype): its first class or interface, else function, else symbol, else its own name.

    ``symbols`` has path, name, kind, line_start and ``place``, its order in the file.
    """
    rank = F.when(F.col("kind").isin("class", "interface"), 0).when(F.col("kind") == "function", 1).otherwise(2)
    best = symbols.groupBy("path").agg(F.min(F.struct(rank.alias("r"), "place", "name", "line_start")).alias("s"))
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]+\z", "")
    shown = F.coalesce(F.col("s.name"), F.nullif(stem, F.lit("")), F.lit("Module"))
    return files.join(best, "path", "left").select(F.col("path").alias("file"), stage_of(F.col("path"), F.col("archetype")).alias("stage"), shown.alias("symbol"), F.coalesce(F.col("s.line_start"), F.lit(1)).cast("int").alias("line"))


def discovered(starts: DataFrame, imports: DataFrame, depth: int | None = None, most: int = MOST) -> DataFrame:
    """(start, file, via, depth, place): files in the order in which each start's search meets them, places from 1.

    ``starts`` has start (the chain), node (its file) and room (how many files
    it may still take); ``imports`` src, dst and place, a file's imports in
    order (several files of one import share its place). An import is looked at
    while there is room, so one that names several files may pass the budget by
    the rest of them. A lost executor repeats one level.
    """
    steps = materialize(imports.filter("src <> dst").groupBy("src", "dst").agg(F.min("place").alias("step")).select(F.col("src").alias("node"), F.col("dst").alias("next"), "step"), "chain-steps")
    begun = starts.select("start", "node", F.col("room").cast("int").alias("room"))
    frontier = materialize(begun.select("start", "node", F.lit(0).alias("place"), "room", F.lit(0).alias("last")), "chain-level")
    seen = frontier.select("start", F.col("node").alias("file"))
    found = None
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("p", "int"), ("step", steps.schema["step"].dataType), ("via", steps.schema["node"].dataType), ("room", "int"), ("last", "int"))]
    by_file = Window.partitionBy("start", "file").orderBy(F.asc_nulls_first("p"), "step", "via")
    order, by_import, own = Window.partitionBy("start").orderBy("p", "step", "file"), Window.partitionBy("start").orderBy("p", "step"), Window.partitionBy("start")
    for level in range(1, held_depth(depth) + 1):
        open_ = frontier.filter("room > 0")
        if level > 1 and open_.isEmpty():
            break
        # A file that many chains have reached is a hot key of the left side, which Spark splits by its size.
        met = open_.join(steps, "node").select("start", F.col("next").alias("file"), F.col("place").alias("p"), "step", F.col("node").alias("via"), "room", "last")
        # One shuffle a level: all that is decided is decided within a chain, which holds few rows. Seen files have no place and come first.
        both = met.unionByName(seen.select("start", "file", *nothing)).repartition("start")
        first = both.withColumn("k", F.row_number().over(by_file)).filter("k = 1 and p is not null")
        ranked = first.withColumn("k", F.row_number().over(order)).withColumn("k0", F.rank().over(by_import)).filter("k0 <= room").withColumn("used", F.max("k").over(own))
        taken = materialize(ranked.select("start", "file", "via", F.lit(level).alias("depth"), (F.col("last") + F.col("k")).cast("int").alias("place"), (F.col("room") - F.col("used")).alias("room"), (F.col("last") + F.col("used")).alias("last")), "chain-level")
        if taken.isEmpty():
            break
        more = taken.select("start", "file", "via", "depth", "place")
        found = more if found is None else found.unionByName(more)
        frontier = taken.withColumnRenamed("file", "node")
        seen = seen.unionByName(taken.select("start", "file"))
    if found is None:
        return begun.select("start", F.col("node").alias("file"), F.lit("").alias("via"), F.lit(0).alias("depth"), F.lit(0).alias("place")).limit(0)
    return found


def expand(chains: DataFrame, imports: DataFrame, mains: DataFrame, depth: int | None = None, most: int = MOST) -> DataFrame:
    """``chains`` (chain_id, file, nodes) with what their file reaches over imports, by stage, at most ``most`` nodes.

    Nodes of an earlier expansion (those with ``via``) are dropped first, so a
    stored chain expands to any depth. Nodes of a stage keep their order:
    their own first, then discovery. A file already in the chain at its stage
    is searched from but not repeated. A chain without a file keeps its nodes.
    """
    own = F.filter("nodes", lambda n: n["via"].isNull())
    rows = materialize(chains.select("chain_id", "file", own.alias("own")), "chains")
    starts = rows.filter("file is not null").select(F.col("chain_id").alias("start"), F.col("file").alias("node"), (F.lit(most) - F.size("own")).alias("room"))
    met = discovered(starts, imports, depth, most).join(mains, "file")
    node = F.struct("place", F.struct("stage", "symbol", "file", "line", "via").cast(NODE).alias("node"))
    # At most ``most`` nodes a chain.
    gathered = met.groupBy(F.col("start").alias("chain_id")).agg(F.transform(F.array_sort(F.collect_list(node)), lambda x: x["node"]).alias("more"))
    joined = rows.join(gathered, "chain_id", "left")
    fresh = F.filter(F.coalesce("more", F.array().cast(f"array<{NODE}>")), lambda m: ~F.exists("own", lambda n: (n["stage"] == m["stage"]) & (n["file"] == m["file"])))
    every = F.concat("own", fresh)
    placed = F.transform(every, lambda n, i: F.struct(stage_rank(n["stage"]).alias("r"), i.alias("i"), n.alias("n")))
    return joined.select("chain_id", "file", F.slice(F.transform(F.array_sort(placed), lambda x: x["n"]), 1, most).alias("nodes"))


def _node(stage: str, symbol: Column, file: Column, line: Column) -> Column:
    return F.struct(F.lit(stage).alias("stage"), symbol.alias("symbol"), file.alias("file"), line.cast("int").alias("line"), F.lit(None).cast("string").alias("via")).cast(NODE)


def of_routes(routes: DataFrame, imports: DataFrame, mains: DataFrame, depth: int | None = None, most: int = MOST) -> DataFrame:
    """(chain_id, file, nodes) of routes: ingress, middlewares as validation, controller, then what its file imports.

    ``routes`` has chain_id, http_method, route_uri, path, line, middlewares,
    controller (shown), controller_file and controller_line; without a file
    the chain ends at its middlewares.
    """
    start = F.array(_node("ingress", F.concat_ws(" ", "http_method", "route_uri"), F.col("path"), F.col("line")))
    checks = F.transform(F.coalesce("middlewares", F.array().cast("array<string>")), lambda m: _node("validation", m, F.lit(None).cast("string"), F.lit(None)))
    handler = F.when(F.col("controller_file").isNotNull(), F.array(_node("controller", F.col("controller"), F.col("controller_file"), F.coalesce("controller_line", F.lit(1))))).otherwise(F.array().cast(f"array<{NODE}>"))
    return expand(routes.select("chain_id", F.col("controller_file").alias("file"), F.concat(start, checks, handler).alias("nodes")), imports, mains, depth, most)


def of_methods(methods: DataFrame, imports: DataFrame, mains: DataFrame, depth: int | None = None, most: int = MOST) -> DataFrame:
    """The same of controller methods (chain_id, path, controller, method, line), with the route that their names imply."""
    verb, uri = http_verb(F.col("method")), inferred_uri(F.col("path"), F.col("method"))
    nodes = F.array(_node("ingress", F.concat_ws(" ", verb, uri), F.col("path"), F.col("line")), _node("controller", F.concat_ws("::", "controller", "method"), F.col("path"), F.col("line")))
    return expand(methods.select("chain_id", F.col("path").alias("file"), nodes.alias("nodes")), imports, mains, depth, most)
