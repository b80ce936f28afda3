"""Questions, hints, calls and staged commits."""

import pytest
from pyspark.sql import functions as F

from codeloom.operators import policy, symbols


@pytest.mark.parametrize(
    ("asked", "want"),
    [
        ("Call to undefined method App\\A::go()", ("App\\A", "go", "method")), ("'User' object has no attribute 'name'", ("User", "name", None)), ("A::b()", ("A", "b", "method")),
        ("a->b", ("a", "b", "method")), ("a.b", ("a", "b", None)), ("run()", (None, "run", "function")), ("Method OrderController::calculateTotal() does not exist", ("OrderController", "calculateTotal", "method")),
        ("App/A->go()", ("App/A", "go", "method")), ("a.b.c", (None, "a.b.c", None)), (" Order ", (None, "Order", None)),
    ],
)
def test_questions(asked, want):
    got = symbols.parse_query(asked)
    assert (got["container"], got["member"], got["kind"]) == want


def test_hints_and_calls(spark):
    body = "Cart::add($x); // Log::no()\n$this->repo->save($y); this.mail.send(1); this.db.query('A::b()'); Cart::add(2);"
    row = spark.createDataFrame([("function f(Order $o, ?User $u, int $n)", "run(a: Box, b: string)", body)], "a string, b string, c string")
    got = row.select(symbols.type_hints(F.col("a")), symbols.type_hints(F.col("b")), symbols.outbound_calls(F.col("c"))).first()
    assert list(got) == [["Order", "User"], ["Box"], ["Cart::add", "Repo::save", "Mail::send"]]


def test_calls_behind_strings_and_namespaces(spark):
    bodies = [r"\App\Services\Pay::run(); $u = 'http://x'; Log::put(1);", r"$s = 'it\'s Cart::add(1)'; Box::open();", "const q = `Cart::add(1) ${x}`; Box::open();", "/* Cart::a() */ Box::open(); // Cart::b()", "App\\Pay::go('a', \"b // c\"); Box::open();", None]
    rows = spark.createDataFrame([(i, b.replace("\\\\", "\\") if b else b) for i, b in enumerate(bodies)], "i int, b string")
    got = [r[0] for r in rows.orderBy("i").select(symbols.outbound_calls(F.col("b"))).collect()]
    assert got == [["Pay::run", "Log::put"], ["Box::open"], ["Box::open"], ["Box::open"], ["Pay::go", "Box::open"], None]


def test_calls_resolve_only_when_one_fits(spark):
    known = spark.createDataFrame([("Cart::add",), ("Box::add",), ("Repo::save",)], "name string")
    calls = spark.createDataFrame([("x", "add"), ("x", "save"), ("x", "none"), ("x", "Box::add")], "caller string, member string")
    assert {r.member: (r.target, r.n_candidates) for r in symbols.resolve_calls(calls, known).collect()} == {"add": (None, 2), "save": ("Repo::save", 1), "none": (None, 0), "Box::add": ("Box::add", 1)}


def test_staged_audit(spark):
    rules = spark.createDataFrame([("a", "b", True, False)], "src string, dst string, forbidden boolean, allowed boolean")
    base = spark.createDataFrame([("1", "a", "b"), ("2", "a", "b"), ("3", "a", "b")], "file string, src string, dst string")
    staged = spark.createDataFrame([("1", "D", None, None), ("2", "M", "a", "c"), ("4", "A", "a", "b")], "file string, status string, src string, dst string")
    assert [r.file for r in policy.staged_audit(base, staged, rules, strict=False).collect()] == ["4"]


def test_inspect(spark):
    rows = spark.createDataFrame([("p1", "A", 5), ("p2", "B", 400), ("p3", "C", 1), ("p4", "D", 1), ("p5", "D", 1)], "path string, name string, line_count int")
    then = spark.createDataFrame([(f"p{i}", "h") for i in range(1, 6)], "path string, content_hash string")
    now = spark.createDataFrame([("p1", "h"), ("p2", "x"), ("p4", "h"), ("p5", "h")], "path string, content_hash string")
    got = {n: {r.status for r in symbols.inspect(rows, now, n, then).collect()} for n in "ABCD"}
    assert got == {"A": {"current"}, "B": {"stale"}, "C": {"unavailable"}, "D": {"ambiguous"}}
