"""Graph operators over edge tables: first evidence, bounded search, cycles, prefix fix-points."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.plans.shared import materialize
from codeloom.plans.skew import salted_lookup


def first_evidence(edges: DataFrame, order: list[Column]) -> DataFrame:
    """One edge per (src, dst), with the first row's evidence and how many rows it has; loops go."""
    return edges.filter("src <> dst").groupBy("src", "dst").agg(F.min(F.struct(*order)).alias("first"), F.count("*").alias("n"))


def reachable(edges: DataFrame, starts: DataFrame, depth: int = 5, most: int | None = None) -> DataFrame:
    """Bounded breadth-first search: (start, node, depth) with the least depth, starts themselves at 0.

    ``depth`` is held between 1 and 8, and 0 means the default. Each round joins
    the frontier to the edges and drops what was seen; the seen set is written to
    the shared folder, so lineage stays short. ``most`` keeps that many nodes a
    start, nearest first; a start that has as many is not searched from any more.
    """
    depth = min(max(int(depth or 5), 1), 8)
    # Every round reads the edges, so they are written once.
    steps = materialize(edges.select(F.col("src").alias("node"), F.col("dst").alias("next")).distinct(), "edges")
    # So are the starts, which every round's seen set begins with.
    seen = frontier = materialize(starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("depth")).distinct(), "bfs")
    for level in range(1, depth + 1):
        met = frontier.join(steps, "node").select("start", F.col("next").alias("node")).distinct()
        frontier = materialize(met.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("depth", F.lit(level)), "bfs")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if most is not None:
            # What is further away than a level that fills a start's room is not kept.
            full = seen.groupBy("start").agg(F.count("*").alias("n")).filter(F.col("n") >= most)
            frontier = frontier.join(full, "start", "left_anti")
    if most is not None:
        rank = Window.partitionBy("start").orderBy("depth", "node")
        seen = seen.withColumn("__k", F.row_number().over(rank)).filter(F.col("__k") <= most).drop("__k")
    return seen


def _rings(steps: DataFrame) -> DataFrame:
    """(node, colour) of the nodes on a cycle of ``steps`` (src, dst), where no node has two ways out; a cycle is named by its least node.

    A round doubles every node's way ahead and keeps those that such a way
    leads to and leads on from, so only cycles are left after as many rounds as
    the longest way has binary digits. A round without a change ends it: ways of
    one length then permute what is left, and the least node met on one is the
    least of all that follow.
    """
    ways = materialize(steps.select(F.col("src").alias("node"), F.col("dst").alias("ahead"), F.least("src", "dst").alias("low")), "ring")
    left = ways.count()
    while left:
        met = ways.join(ways.select(F.col("ahead").alias("node")).distinct(), "node", "left_semi")
        further = ways.select(F.col("node").alias("ahead"), F.col("ahead").alias("further"), F.col("low").alias("beyond"))
        doubled = met.join(further, "ahead").select("node", F.col("further").alias("ahead"), F.least("low", "beyond").alias("low"), (F.col("beyond") < F.col("low")).alias("told"))
        after = materialize(doubled, "ring")
        n, told = after.agg(F.count("*"), F.count_if("told")).first()
        ways, left, before = after.drop("told"), n, left
        if n == before and not told:
            break
    return ways.select("node", F.col("low").alias("colour"))


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes on any cycle, of whatever length; a component is named by its least node.

    Where no node has two ways out, or none two ways in, doubled ways tell the
    cycles (:func:`_rings`). Else each round gives every node the least node
    that reaches it, then walks back from those names inside their colour: what
    they reach and is reached by them is a component. The rest goes on, without
    the edges between colours.
    Loops do not count. Nodes and edges stay in tables; only counts reach the
    driver. A round's steps are as many as its longest shortest way, which
    shortcuts over names already known make fewer.
    """
    live = materialize(edges.filter("src <> dst").select("src", "dst").distinct(), "live")
    found, before = None, None
    while True:
        n, sources, targets = live.agg(F.count("*"), F.count_distinct("src"), F.count_distinct("dst")).first()
        if n == 0:
            break
        if n in (sources, targets):
            rings = _rings(live if n == sources else live.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
            found = rings if found is None else found.unionByName(rings)
            break
        # What has no way in, or none out, is on no cycle.
        if n != before:
            before = n
            live = materialize(live.join(live.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(live.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi"), "live")
            continue
        nodes = live.select(F.col("src").alias("node")).union(live.select("dst")).distinct()
        colour = materialize(nodes.withColumn("colour", F.col("node")), "colour")
        while True:
            ahead = live.join(colour.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("told"))
            stepped = colour.join(ahead, "node", "left").select("node", "colour", F.least("colour", F.coalesce("told", "colour")).alias("own"))
            names = stepped.select(F.col("node").alias("own"), F.col("own").alias("further"))
            # Many nodes share a name, so the name's own row is spread.
            hopped = salted_lookup(stepped, names, ["own"], F.col("node"))
            after = materialize(hopped.select("node", F.least("own", F.coalesce("further", "own")).alias("colour"), F.col("colour").alias("was")), "colour")
            colour = after.select("node", "colour")
            if after.filter("colour <> was").isEmpty():
                break
        ends = live.join(colour.select(F.col("node").alias("src"), "colour"), "src").join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("there")), "dst")
        inside = materialize(ends.filter("colour = there").select("src", "dst", "colour"), "inside")
        reached = colour.filter("node = colour")
        frontier = reached
        while True:
            back = inside.join(frontier.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node"), "colour").distinct()
            frontier = materialize(back.join(reached.select("node"), "node", "left_anti"), "back")
            if frontier.isEmpty():
                break
            reached = reached.unionByName(frontier)
        whole = materialize(reached, "component")
        found = whole if found is None else found.unionByName(whole)
        live = materialize(inside.join(whole.select(F.col("node").alias("src")), "src", "left_anti").join(whole.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst"), "live")
    if found is None:
        return live.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    large = found.groupBy("colour").agg(F.count("*").alias("n")).filter("n > 1")
    return found.join(large.select("colour"), "colour", "left_semi").select("node", F.col("colour").alias("component"))


def cycle_members(edges: DataFrame, length: int | None = None) -> DataFrame:
    """Nodes on a cycle (of at most ``length`` edges, where given), with the shortest such length.

    Every node is searched from at once and stops when its cycle closes. The
    pairs met are at most the square of the nodes, so this is for domain and
    module graphs; :func:`strong_components` tells who is on a cycle at any size.
    """
    steps = materialize(edges.filter("src <> dst").select(F.col("src").alias("node"), F.col("dst").alias("next")).distinct(), "edges")
    seen = frontier = materialize(steps.select(F.col("node").alias("start"), F.col("next").alias("node")), "cycle")
    found, n = None, 1
    while not frontier.isEmpty() and (length is None or n < length):
        n += 1
        met = frontier.join(steps, "node").select("start", F.col("next").alias("node")).distinct()
        closed = materialize(met.filter("start = node").select("node", F.lit(n).alias("length")), "closed")
        found = closed if found is None else found.unionByName(closed)
        fresh = met.join(seen, ["start", "node"], "left_anti").join(closed.select(F.col("node").alias("start")), "start", "left_anti")
        frontier = materialize(fresh, "cycle")
        seen = seen.unionByName(frontier)
    if found is None:
        return steps.select("node", F.lit(2).alias("length")).limit(0)
    return found


def cycles(edges: DataFrame) -> DataFrame:
    """Cycles that a depth-first search meets, each once, rotated to begin at its least node.

    The search visits nodes and successors in order. It runs in one task on the
    distinct edges of a domain or module graph, which an architecture bounds;
    use :func:`cycle_members` on file graphs.
    """

    def search(rows: pd.DataFrame) -> pd.DataFrame:
        after: dict[str, list[str]] = {}
        for a, b in sorted(zip(rows["src"], rows["dst"], strict=True)):
            after.setdefault(a, []).append(b)
        done: set[str] = set()
        found: dict[tuple[str, ...], None] = {}
        for root in sorted(after):
            if root in done:
                continue
            path, work, place = [root], [iter(after.get(root, ()))], {root: 0}
            while work:
                node = next(work[-1], None)
                if node is None:
                    work.pop()
                    last = path.pop()
                    del place[last]
                    done.add(last)
                elif node in place:
                    ring = path[place[node] :]
                    low = ring.index(min(ring))
                    found[tuple(ring[low:] + ring[:low])] = None
                elif node not in done:
                    place[node] = len(path)
                    path.append(node)
                    work.append(iter(after.get(node, ())))
        return pd.DataFrame({"cycle": [" -> ".join([*c, c[0]]) for c in found], "length": [len(c) for c in found]})

    own = edges.filter("src <> dst").select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst")).distinct()
    return own.withColumn("g", F.lit(1)).groupBy("g").applyInPandas(search, "cycle string, length int")


def prefixes(mounts: DataFrame, roots: DataFrame, rounds: int = 10) -> DataFrame:
    """Fix-point of router prefixes: (router, prefix) for every way from a root over mounts (parent, child, path).

    Stops when a round finds nothing new, or after ``rounds``.
    """
    mounts = materialize(mounts.select("parent", "child", "path"), "mounts")
    # Every round reads the seen prefixes, so the first are written as well.
    seen = frontier = materialize(roots.select("router", "prefix").distinct(), "prefix")
    for _ in range(rounds):
        met = frontier.join(mounts, F.col("router") == F.col("parent")).select(F.col("child").alias("router"), F.regexp_replace(F.concat("prefix", F.lit("/"), "path"), "/+", "/").alias("prefix")).distinct()
        frontier = materialize(met.join(seen, ["router", "prefix"], "left_anti"), "prefix")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen
