"""Symbol impact, feature context, scopes and the other operators that need hand-made cases."""

import pytest
from pyspark.sql import functions as F

from codeloom.functions import text
from codeloom.operators import catalog, graph, policy, slices, topology
from codeloom.operators.impact import impact_risk, mentions_file, parse_target, receiver, symbol_impact


def tables(spark):
    symbols = spark.createDataFrame(
        [(1, "Cart", "class", 1, 30, ""), (1, "Cart::total", "method", 5, 9, "def total()"), (2, "Page", "class", 1, 20, ""), (2, "Page::show", "method", 4, 8, ""), (4, "Save", "method", 1, 9, "func (c *Store) Save()")],
        "file_id long, name string, kind string, line_start int, line_end int, signature string",
    )
    files = spark.createDataFrame([(1, "shop/cart.py", "shop"), (2, "web/page.py", "web"), (3, "api/raw.py", "api"), (4, "db/store.go", "db"), (5, "x/other.py", None)], "file_id long, path string, domain string")
    imports = spark.createDataFrame(
        [(2, 2, "shop.cart", "from shop.cart import Cart"), (2, 2, "shop.cart", "from shop.cart import Cart"), (3, 1, "../shop/cart", "import '../shop/cart'"), (5, 1, "../shop/cart", "import { Bag } from '../shop/cart'"), (5, 3, "Cartoon", "import Cartoon"), (1, 1, "Cart", "import Cart"), (5, 4, None, None), (3, 2, "./db/store.go", "x")],
        "file_id long, line_number int, target string, statement string",
    )
    contents = spark.createDataFrame([(2, "a\nb\nc\nd\r\n  cart.total()\nCart::total(1)"), (5, "x.total()"), (3, None)], "file_id long, content string")
    return symbols, files, imports, contents


def test_impact_of_a_container_and_a_method(spark):
    symbols, files, imports, contents = tables(spark)
    rows = {(r.path, r.line, r.caller, r.kind, r.domain) for r in symbol_impact(symbols, files, imports, "Cart").collect()}
    # The import by path counts, a named import of something else and a longer word do not.
    want = {("web/page.py", 2, "Page", "class", "web"), ("api/raw.py", 1, "api/raw.py:1", "import", "api")}
    assert rows == want
    found = symbol_impact(symbols, files, imports, "Cart::total", contents)
    rows = {(r.path, r.line, r.caller, r.kind, r.domain) for r in found.collect()}
    assert rows == want | {("web/page.py", 5, "Page::show", "method", None), ("web/page.py", 6, "Page::show", "method", None)}
    risk = impact_risk(found).first()
    assert (risk.total_dependents, risk.affected_files, risk.risk) == (4, 2, "medium")


@pytest.mark.parametrize(("query", "n"), [("", 0), ("Cart::none", 0), ("Nobody", 0), ("Store::Save", 1), ("Other::Save", 0), ("Cart@total", 2)])
def test_impact_needs_a_declaration(spark, query, n):
    symbols, files, imports, _ = tables(spark)
    assert symbol_impact(symbols, files, imports, query).count() == n


def test_impact_of_one_file_and_of_empty_tables(spark):
    symbols, files, imports, contents = tables(spark)
    assert {r.path for r in symbol_impact(symbols, files, imports, "Cart", file="shop/cart.py").collect()} == {"web/page.py", "api/raw.py"}
    assert symbol_impact(symbols, files, imports, "Cart", file="web/page.py").count() == 0
    assert symbol_impact(symbols, files, imports, "Cart", domain="WEB").count() == 0
    empty = [t.limit(0) for t in (symbols, files, imports)]
    found = symbol_impact(*empty, "Cart::total", contents)
    assert found.count() == 0 and impact_risk(found).first().risk == "low"


def test_targets_and_files_by_name(spark):
    assert [parse_target(q) for q in ("A::b", " A@b ", "A")] == [("A", "b"), ("A", "b"), ("A", "")]
    said = spark.createDataFrame([("from shop.cart import X",), ("import '../shop/Cart.js'",), ("import mycart",), ("carts",), ("cart",), ("x/cart;",), ("require(\"cart\")",), ("my cart",), (None,)], "s string")
    assert [r[0] for r in said.select(mentions_file(F.col("s"), "shop/cart.py")).collect()] == [True, True, False, False, True, True, True, False, None]
    said = spark.createDataFrame([("./user.service",), ("./user.service.js",), ("./user",), ("a\\user.service",)], "s string")
    assert [r[0] for r in said.select(mentions_file(F.col("s"), "a/user.service.ts")).collect()] == [True, True, False, True]


def test_receivers(spark):
    said = ["func (c *Store) Save()", "func (Store) Save()", "func (s *Stack[K, V]) Push(v V)", "func Save(c *Store)", "func(c Store) x()", "def f(Store)", "func", ""]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, s string")
    assert [r[0] for r in rows.orderBy("i").select(receiver(F.col("s"))).collect()] == ["Store", "Store", "Stack", "", "Store", "", "", ""]


def test_reused_symbols(spark):
    symbols, files, _, _ = tables(spark)
    names = spark.createDataFrame([("Cart",), ("Nobody",), ("Cart",)], "name string")
    rows = {r.name: (r.kind, r.path, r.methods, r.properties) for r in catalog.reuse_members(names, symbols, files).collect()}
    assert rows == {"Cart": ("class", "shop/cart.py", "def total()", ""), "Nobody": ("unknown", None, "", "")}


def test_identity_takes_null_as_equal(spark):
    columns = ", ".join(f"{c} string" for c in catalog.IDENTITY)
    one = ("p", "n", "k", None, "1", "2", "h", "py")
    actual = spark.createDataFrame([one, one, (*one[:7], "go")], columns)
    assert catalog.same_identity(actual, spark.createDataFrame([one, one], columns)).count() == 2


def test_overlay_of_maps(spark):
    rows = spark.createDataFrame([({"a": 1, "b": 2}, {"b": 3}), (None, {"b": 3}), ({"a": 1}, None)], "x map<string,int>, y map<string,int>")
    assert [r[0] for r in rows.select(catalog.overlay(F.col("x"), F.col("y"))).collect()] == [{"a": 1, "b": 3}, {"b": 3}, {"a": 1}]


def test_ranked_slices(spark):
    rows = spark.createDataFrame([(i, i % 3) for i in range(8)], "slice_id long, points long")
    hit = slices.ranked(rows, F.col("points")).collect()
    assert [(r.slice_id, r.role) for r in sorted(hit, key=lambda r: (-r.score, r.slice_id))] == [(2, "primary"), (5, "alternative"), (1, "alternative"), (4, "alternative")]
    miss = slices.ranked(rows, F.lit(0)).collect()
    assert sorted((r.slice_id, r.found, r.role) for r in miss) == [(i, False, "alternative") for i in range(5)]
    assert slices.ranked(rows.limit(0), F.lit(1)).count() == 0


TRACED = [
    (1, "GET", "/orders", "orders.index", "App\\OrderController", "index", [("OrderController::index", "app/order.php")]),
    (2, "POST", "/orders/{id}/pay", "orders.pay", "App\\OrderController", "pay", [("PayUseCase", "app/pay.php"), (None, None)]),
    (3, "GET", "/orders/{id}", None, "OrderController", "show", None),
    (4, "GET", "/orders/:order", None, None, None, []),
    (5, "JOB", "job:cleanup", None, "CleanupJob", "handle", None),
    (6, "POST", "/orders", None, "App\\OrderController", "store", None),
]


@pytest.mark.parametrize(
    ("asked", "want"),
    [
        ("get /orders", [(1, 1, "exact", "primary")]), ("GET /orders/{x}", [(3, 1, "inferred", "primary"), (4, 1, "inferred", "alternative")]), ("GET /orders/{id}", [(3, 1, "exact", "primary")]), ("PUT /orders", []),
        ("/orders", [(1, 2, "exact", "primary"), (6, 2, "exact", "alternative")]), ("/orders/:any/pay", [(2, 2, "inferred", "primary")]), ("Orders.Pay", [(2, 3, "exact", "primary")]), ("job Cleanup", [(5, 4, "exact", "primary")]),
        ("OrderController@store", [(6, 5, "exact", "primary")]), ("OrderController", [(1, 5, "exact", "primary")]), ("src/OrderController.php", [(1, 5, "exact", "primary")]), ("PayUse", [(2, 6, "inferred", "primary")]), ("pay.php", [(2, 6, "inferred", "primary")]),
        ("handle", [(5, 6, "inferred", "primary")]), ("nothing of it", []), ("", []),
    ],
)
def test_slice_trace(spark, asked, want):
    rows = spark.createDataFrame(TRACED, "slice_id int, http_method string, route_uri string, route_name string, controller_class string, action_name string, chain array<struct<symbol:string,file:string>>")
    assert [(r.slice_id, r.step, r.confidence, r.role) for r in slices.trace(rows, asked).orderBy("slice_id").collect()] == want


def test_derived_feature(spark):
    rows = spark.createDataFrame([(1, "GET", "/cart", "get.cart", 7), (2, "GET", "/cart", "get.cart", 8), (3, "GET", "/x", "get.x", 9)], "slice_id long, http_method string, route_uri string, route_name string, conv_id long")
    nodes = spark.createDataFrame([(7, "Old", "o.py"), (8, "Cart::show", "c.py"), (8, "Cart::show", None), (9, "X", "x.py")], "conv_id long, symbol string, file string")
    assert {tuple(r) for r in slices.derived_feature(rows, nodes, "CART").collect()} == {("symbol", "Cart::show"), ("touchpoint", "c.py")}


@pytest.mark.parametrize(
    ("path", "method", "want"),
    [("app/UserController.php", "store", "/users"), ("app/UserController.php", "showOne", "/users/:id"), ("a/cart.ts", "remove", "/carts/:id"), ("a/cart.ts", "export", "/carts/export"), ("Controller.php", "index", "/resource/index")],
)
def test_inferred_uri(spark, path, method, want):
    assert spark.range(1).select(text.inferred_uri(F.lit(path), F.lit(method))).first()[0] == want


@pytest.mark.parametrize(
    ("given", "want"),
    [({}, "all"), ({"file": "a.py"}, "file"), ({"files": ("a.py", "b.py")}, "file"), ({"domain": "x"}, "domain"), ({"staged": True}, "staged"), ({"scope": "all"}, "all")],
)
def test_scopes(given, want):
    assert policy.check_scope(**given) == want


@pytest.mark.parametrize(
    "given",
    [{"file": "a", "files": ("b",)}, {"staged": True, "scope": "all"}, {"scope": "file"}, {"scope": "all", "file": "a"}, {"scope": "domain"}, {"scope": "all", "domain": "x"}, {"proposed_imports": ("x",)}, {"file": " "}, {"scope": "other"}],
)
def test_contradicting_scopes(given):
    with pytest.raises(ValueError):
        policy.check_scope(**given)


def test_audit_with_cycles_and_relevance(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "a")], "src string, dst string")
    rules = spark.createDataFrame([("a", "b", True, False), ("b", "c", False, True)], "src string, dst string, forbidden boolean, allowed boolean")
    rows = {tuple(r) for r in policy.full_audit(edges, rules, graph.cycles(edges)).collect()}
    assert rows == {("a", "b", "forbidden_dependency", None), ("c", "a", "disallowed_dependency", None), ("a", "b", "circular_dependency", "a -> b -> c -> a")}
    assert policy.of_domain(policy.audit(edges, rules), "c").count() == 1
    files = spark.createDataFrame([("a.py", "x"), ("b.py", "y"), ("c.py", "x")], "path string, domain string")
    assert [policy.relevant(files).count(), policy.relevant(files, "x").count(), policy.relevant(files, "x", ("a.py", "b.py")).count()] == [3, 2, 1]


def test_an_unknown_feature_allows_nothing(spark):
    domains = spark.createDataFrame([("a",), ("b",)], "name string")
    rules = spark.createDataFrame([("a", "b", False, True)], "src string, dst string, forbidden boolean, allowed boolean")
    imports = spark.createDataFrame([("a/x.py", "a", "b", 3)], "file string, src string, dst string, line int")
    assert policy.evaluate(imports, domains, rules).count() == 0
    assert [r.rule for r in policy.evaluate(imports, domains, rules, "f", {}).collect()] == ["unknown_feature"]
    assert [r.rule for r in policy.evaluate(imports, domains, rules, "f", {"f": ["b/**"]}).collect()] == ["touchpoint_violation"]
    assert policy.evaluate(imports, domains, rules, "f", {"f": ["a/**"]}).count() == 0


def test_distributed(spark):
    schema = "layer string, parent string, address string"
    assert not topology.is_distributed(spark.createDataFrame([("host", None, "localhost")], schema)).first().distributed
    assert topology.is_distributed(spark.createDataFrame([("host", None, "a.b")], schema)).first().distributed
    assert not topology.is_distributed(spark.createDataFrame([], schema)).first().distributed
