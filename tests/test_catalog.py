"""Catalog operators on small hand-made tables."""

import random

import pytest
from pyspark.sql import functions as F

from codeloom import queries
from codeloom.functions import text
from codeloom.operators import catalog, graph, policy, slices
from codeloom.operators.components import connected_components
from codeloom.operators.topology import merge


def column(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("path", "want"),
    [("app/Http/Controllers/A.php", "controller"), ("shop/views.py", "controller"), ("src/report.py", "repository"), ("a/transaction.ts", "action"), ("resources/views/a.blade.php", "resource"), ("views/a.py", "controller"), ("x/main.go", "unknown"), ("ui/views/x.html", "view")],
)
def test_archetype(spark, path, want):
    assert column(spark, path, text.archetype) == want


@pytest.mark.parametrize(
    ("glob", "path", "fits"),
    [("**/a.py", "a.py", True), ("**/a.py", "x/y/a.py", True), ("*.py", "x/a.PY", True), ("src/*.py", "src/x/a.py", False), ("src/**", "src/x/a.py", True), ("a?.py", "ab.py", True), ("a.py", "aXpy", False)],
)
def test_globs(spark, glob, path, fits):
    assert column(spark, path, lambda c: c.rlike(text.glob_regex(glob))) is fits


def test_touchpoint_star_is_one_level(spark):
    rows = spark.createDataFrame([("src/a.py",), ("src/b/a.py",), ("lib/x.py",)], "path string")
    out = {r.path: r.allowed for r in policy.touchpoints(rows, "path", ["src/*", "lib/x.py"]).collect()}
    assert out == {"src/a.py": True, "src/b/a.py": False, "lib/x.py": True}


@pytest.mark.parametrize(("folder", "target", "want"), [("a/b", "../c", "a/c"), ("a", "./x/./y", "a/x/y"), ("", "../z", None), ("a/b", "../../q", "q")])
def test_relative_imports(spark, folder, target, want):
    assert spark.range(1).select(text.resolve_relative(F.lit(folder), F.lit(target))).first()[0] == want


def test_ignored_paths(spark):
    seen = {p: column(spark, p, lambda c: text.is_ignored(c, ("gen/*", "*.min.js"))) for p in ("src/a.ts", "node_modules/x.js", "src/.cache/a.py", "gen/x/y.py", "a.min.js", "./src/b.ts")}
    assert [p for p, v in seen.items() if not v] == ["src/a.ts", "./src/b.ts"]


@pytest.mark.parametrize(("name", "query", "fits"), [("Order::save", "save", True), ("Order::save", "order->SAVE", True), ("Order::save", "Order", False), ("a.Order::save", "Order.save", True), ("save_item", "save%", False)])
def test_symbol_names(spark, name, query, fits):
    assert column(spark, name, lambda c: text.name_matches(c, query)) is fits


def test_small_text_functions(spark):
    assert column(spark, "/a/{id}/b/:slug", text.normalise_uri) == "/a/:param/b/:param"
    assert column(spark, "getUserName_v2", text.tokens) == ["get", "user", "name", "v2"]
    assert column(spark, "Ubah status the orderList", text.query_tokens) == ["status", "order", "list"]
    assert [column(spark, m, text.table_name) for m in ("OrderEntry", "Box", "Day", "User")] == ["order_entries", "boxes", "days", "users"]
    assert [column(spark, m, text.http_verb) for m in ("storeItem", "updateAll", "destroy", "index")] == ["POST", "PUT", "DELETE", "GET"]
    assert [column(spark, p, text.language) for p in ("a.blade.php", "a.php", "b.TSX", "x.md", "k.kt")] == ["blade", "php", "typescript", None, "kotlin"]
    assert column(spark, "./Src\\Util/index.ts", text.normalise_path) == "src/util"
    assert column(spark, "Order::Item.save", text.container) == "Order::Item"
    assert column(spark, None, text.platform_tag) == "unspecified"


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (5, 5), (None, 4), (10, 3), *[(20, 20 + i) for i in range(1, 40)]]
    out = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert out == {**dict.fromkeys((1, 2, 3, 10), 1), 8: 8, 9: 8, **dict.fromkeys(range(20, 60), 20)}
    assert connected_components(spark.createDataFrame([], "src string, dst string")).collect() == []


def test_search_cycles_and_prefixes(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "d"), ("e", "f"), ("f", "e")], "src string, dst string")
    out = {(r.start, r.node): r.depth for r in graph.reachable(edges, spark.createDataFrame([("a",)], "node string"), 2).collect()}
    assert out == {("a", "a"): 0, ("a", "b"): 1, ("a", "c"): 2}
    assert {r.node: r.length for r in graph.cycle_members(edges).collect()} == {"a": 3, "b": 3, "c": 3, "e": 2, "f": 2}
    assert sorted(r.cycle for r in graph.cycles(edges).collect()) == ["a -> b -> c -> a", "e -> f -> e"]
    mounts = spark.createDataFrame([("r", "s", "/s"), ("s", "t", "t/"), ("t", "s", "x")], "parent string, child string, path string")
    seen = {(r.router, r.prefix) for r in graph.prefixes(mounts, spark.createDataFrame([("r", "/api")], "router string, prefix string"), 3).collect()}
    assert seen == {("r", "/api"), ("s", "/api/s"), ("t", "/api/s/t/"), ("s", "/api/s/t/x")}


def test_policy(spark):
    rules = spark.createDataFrame([("a", "b", False, True), ("a", "c", True, False), ("b", "c", False, False)], "src string, dst string, forbidden boolean, allowed boolean")
    edges = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "c"), ("a", "a"), ("c", "a")], "src string, dst string")
    strict = {(r.src, r.dst): r.rule for r in policy.audit(edges, rules).collect()}
    assert strict == {("a", "c"): "forbidden_dependency", ("b", "c"): "disallowed_dependency", ("c", "a"): "disallowed_dependency"}
    assert policy.audit(edges, rules, strict=False).count() == 1
    domains = spark.createDataFrame([("a",), ("b",)], "name string")
    asked = spark.createDataFrame([("x.py", "a", "c", 3), ("y.py", None, "b", 9)], "file string, src string, dst string, line int")
    assert sorted((r.file, r.line, r.rule) for r in policy.proposed(asked, domains, rules).collect()) == [("x.py", 3, "forbidden_dependency"), ("y.py", 1, "unmapped_domain")]
    got = spark.createDataFrame([(1, 1), (0, 1), (0, 0)], "v int, i int").select(policy.verdict(F.col("v"), F.col("i"))).collect()
    assert [r[0] for r in got] == ["rejected", "unknown", "approved"]


def test_similarity_cases():
    from codeloom.functions.similarity import osa, score

    assert (osa("getuser", "getusre"), osa("ca", "abc"), osa("", "ab")) == (1, 3, 2)
    assert score("OrderService", "orderservice") == 1.0 and score("", "x") == 0.0
    assert score("OrderServce", "OrderService") > 0.85 and score("getUsre", "getUser") > 0.8 and score("UserRepository", "UserService") > 0.4


def test_enclosing_prefix_and_snapshots(spark):
    symbols = spark.createDataFrame([(1, "C", 1, 50), (1, "C::m", 5, 9), (1, "f", 60, 61)], "file_id int, name string, line_start int, line_end int")
    lines = spark.createDataFrame([(1, 7), (1, 30), (1, 55), (2, 7)], "file_id int, line int")
    assert {r.line: r.name for r in catalog.enclosing(lines, symbols).collect()} == {7: "C::m", 30: "C"}
    domains = spark.createDataFrame([("a", "src"), ("b", "src/b")], "name string, root_path string")
    paths = spark.createDataFrame([("src/b/x",), ("src/bx",), ("lib",)], "path string")
    assert {r.path: r.owner for r in catalog.longest_prefix(paths, "path", domains).collect()} == {"src/b/x": "b", "src/bx": "a", "lib": None}
    old, new = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x")], "k int, h string"), spark.createDataFrame([(1, "x"), (2, "y"), (4, "x")], "k int, h string")
    assert {r.k: r.status for r in catalog.snapshot_diff(old, new, "k", "h").collect()} == {1: "unchanged", 2: "modified", 3: "deleted", 4: "added"}
    assert sorted((r.k, r.h) for r in catalog.replace_rows(old, new, "k").collect()) == [(1, "x"), (2, "y"), (3, "x"), (4, "x")]


def test_slices_and_topology(spark):
    rows = spark.createDataFrame([(1, "GET", "/a/{id}", "get._a_id_"), (2, "GET", "/a/{key}", "x"), (3, "POST", "/a/{id}", "y"), (4, "GET", "/b", "z")], "slice_id int, http_method string, route_uri string, route_name string")
    assert {r.slice_id: r.match_rank for r in slices.match(rows, "get /a/{id}").collect()} == {1: 1, 2: 2, 3: 3}
    nodes = spark.createDataFrame([(1, 0, "job", "j"), (1, 1, "service", "s"), (1, 2, "ingress", "i"), (1, 3, "service", "t")], "c int, seq int, stage string, symbol string")
    assert [n.symbol for n in slices.ordered_chains(nodes, "c").first().chain] == ["i", "s", "t", "j"]
    schema = "id int, status string, platform string"
    out = merge(spark.createDataFrame([(1, "VERIFIED", "p"), (2, "DETECTED", "p"), (3, "DETECTED", "p")], schema), spark.createDataFrame([(1, "DETECTED", "q"), (2, "DETECTED", "q"), (4, "DETECTED", "q")], schema), "id")
    assert {r.id: r.platform for r in out.collect()} == {1: "p", 2: "q", 3: "p", 4: "q"}


def test_strong_components_match_reachability(spark):
    rnd = random.Random(2)
    pairs = {(rnd.randrange(40), rnd.randrange(40)) for _ in range(55)} | {(100 + i, 100 + (i + 1) % 9) for i in range(9)} | {(3, 100), (7, 7)}
    reach = {a: {b for x, b in pairs if x == a} for a in {n for p in pairs for n in p}}
    for _ in range(8):
        reach = {a: bs | {c for b in bs for c in reach[b]} for a, bs in reach.items()}
    same = {a: {b for b in reach[a] if a in reach.get(b, ())} | {a} for a in reach}
    want = {(a, min(s)) for a, s in same.items() if len(s) > 1}
    edges = spark.createDataFrame(sorted(pairs), "src int, dst int")
    assert {tuple(r) for r in graph.strong_components(edges).collect()} == want
    lengths = {r.node: r.length for r in graph.cycle_members(edges).collect()}
    assert set(lengths) == {a for a, _ in want} and {lengths[100 + i] for i in range(9)} == {9}
    assert {r.node for r in graph.cycle_members(edges, 4).collect()} == {a for a, n in lengths.items() if n <= 4}
    assert graph.strong_components(edges.limit(0)).collect() == [] and graph.cycle_members(edges.limit(0)).collect() == []


def test_single_successors_take_few_rounds(spark, monkeypatch):
    """A way of 120 parts into a ring of 40, a second ring, a way to nowhere: both directions, in rounds as few as a length's digits."""
    pairs = [(i, i + 1) for i in range(159)] + [(159, 120)] + [(1000 - i, 1000 - (i + 1) % 3) for i in range(3)] + [(2000, 2001), (2001, 2002), (3, 3)]
    want = {(i, 120) for i in range(120, 160)} | {(i, 998) for i in range(998, 1001)}
    written = []
    monkeypatch.setattr(graph, "materialize", lambda df, name, keep=graph.materialize: (written.append(name), keep(df, name))[1])
    edges = spark.createDataFrame(pairs, "src int, dst int")
    assert {tuple(r) for r in graph.strong_components(edges).collect()} == want and len(written) < 20
    assert {tuple(r) for r in graph.strong_components(edges.selectExpr("dst AS src", "src AS dst")).collect()} == want and len(written) < 40


def _orders(folder):
    """Lines of five orders, each a way over parts."""
    ways = [(7, 8, 9, 10), (100, 8, 12, 9), (77, 100, 8), (0, 7, 12), (12, 13, 14, 13)]
    return folder(lineitem=([(o, p, 1, n) for o, way in enumerate(ways) for n, p in enumerate(way)], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int"))


def test_prefix_rounds_read_tables_not_the_orders(spark, folder):
    found = queries.queries()["prefix_fixpoint"](spark, _orders(folder))
    assert "l_partkey" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {r.prefix for r in found.collect() if r.router >= 12} == {"/r77", "/r77/r100"} | {way + end for way in ("/r0/r7/r12", "/r0/r7/r8/r12") for end in ("", "/r13", "/r13/r14")}


def test_search_rounds_read_tables_not_the_orders(spark, folder):
    at = _orders(folder)
    near = [(0, 0), (7, 1), (8, 2), (12, 2), (9, 3), (13, 3), (10, 4), (14, 4)]
    for name in ("bfs_depth5", "bfs_capped25"):
        found = queries.queries()[name](spark, at)
        assert "l_partkey" not in found._jdf.queryExecution().optimizedPlan().toString()
        assert sorted((r.depth, r.node) for r in found.collect() if r.start == 0) == sorted((d, n) for n, d in near)


def test_a_full_start_is_not_searched_from(spark, monkeypatch):
    """Ten parts around the start fill its room; the long way behind them takes no more rounds."""
    written = []
    monkeypatch.setattr(graph, "materialize", lambda df, name, keep=graph.materialize: (written.append(name), keep(df, name))[1])
    edges = spark.createDataFrame([(0, n) for n in range(1, 11)] + [(n, n + 1) for n in range(10, 20)], "src int, dst int")
    rows = graph.reachable(edges, edges.filter("src = 0").select(F.col("src").alias("node")), depth=8, most=5).collect()
    assert sorted((r.depth, r.node) for r in rows) == [(0, 0), (1, 1), (1, 2), (1, 3), (1, 4)] and written.count("bfs") == 3
