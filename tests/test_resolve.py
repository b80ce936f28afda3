"""Import resolution per language, and behavioural facts."""

from pyspark.sql import functions as F

from codeloom.functions.behaviour import facts
from codeloom.operators.resolve import Rules, resolve, target_domain

FILES = ["src/a.ts", "src/b.tsx", "src/lib/index.ts", "src/two.ts", "src/two.js", "app/m/__init__.py", "app/m/order.py", "src/util.py", "app/Models/Order.php", "pay/box.go", "pay/box_test.go", "pay/open.go", "main.go", "src/sub/c.ts"]
RULES = Rules(aliases={"@lib": ["src/lib"], "~/*": ["gen/*", "src/*"], "~/sub/*": ["src/sub/*"]}, js_packages=("react", "@org/kit"), python_packages=("numpy",), psr4={"App\\": ["app/"]}, php_vendors=("Illuminate",), go_module="m.io/shop")
CASES = [
    ("src/x.ts", "typescript", "./a", "resolved", ["src/a.ts"]),
    ("src/sub/x.ts", "typescript", "../b.js", "resolved", ["src/b.tsx"]),
    ("src/x.ts", "typescript", "./lib", "resolved", ["src/lib/index.ts"]),
    ("src/x.ts", "typescript", "./two", "ambiguous", ["src/two.ts", "src/two.js"]),
    ("src/x.ts", "typescript", "./none", "unresolved", []),
    ("src/x.ts", "typescript", "../../out", "unsupported", []),
    ("src/x.ts", "typescript", "node:fs", "external", []),
    ("src/x.ts", "typescript", "@org/kit/x", "external", []),
    ("src/x.ts", "typescript", "left-pad", "unresolved", []),
    ("src/x.ts", "typescript", "@lib", "resolved", ["src/lib/index.ts"]),
    ("src/x.ts", "typescript", "~/a", "resolved", ["src/a.ts"]),
    ("src/x.ts", "typescript", "~/sub/c", "resolved", ["src/sub/c.ts"]),
    ("src/x.ts", "typescript", "@/b", "resolved", ["src/b.tsx"]),
    ("src/x.ts", "typescript", "dynamic:name", "unresolved", []),
    ("app/m/x.py", "python", ".order", "resolved", ["app/m/order.py"]),
    ("app/n/x.py", "python", "..m", "resolved", ["app/m/__init__.py"]),
    ("x.py", "python", "app.m.order", "resolved", ["app/m/order.py"]),
    ("x.py", "python", "util", "resolved", ["src/util.py"]),
    ("x.py", "python", "os.path", "external", []),
    ("x.py", "python", "numpy", "external", []),
    ("x.py", "python", "nowhere", "unresolved", []),
    ("a.php", "php", "App\\Models\\Order", "resolved", ["app/Models/Order.php"]),
    ("a.php", "php", "Illuminate\\Support\\Str", "external", []),
    ("a.php", "php", "Other\\X", "unresolved", []),
    ("main.go", "go", "m.io/shop/pay", "resolved", ["pay/box.go", "pay/open.go"]),
    ("main.go", "go", "fmt", "external", []),
    ("main.go", "go", "m.io/shop/none", "unresolved", []),
    ("a.rs", "rust", "crate::x", "unsupported", []),
]


def test_resolution(spark):
    imports = spark.createDataFrame([c[:3] for c in CASES], "source string, language string, target string")
    files = spark.createDataFrame([(p,) for p in FILES], "path string")
    out = {(r.source, r.target): (r.status, r.files) for r in resolve(imports, files, RULES).collect()}
    wrong = [(c, out[c[0], c[2]]) for c in CASES if out[c[0], c[2]] != (c[3], c[4])]
    assert not wrong and len(out) == len(CASES)


def test_one_target_domain(spark):
    rows = spark.createDataFrame([("a", "resolved", ["x/1", "x/2"]), ("b", "resolved", ["x/1", "y/1"]), ("c", "ambiguous", ["x/1"])], "source string, status string, files array<string>")
    files = spark.createDataFrame([("x/1", "x"), ("x/2", "x"), ("y/1", "y")], "path string, domain string")
    assert {r.source: r.target_domain for r in target_domain(rows, files).collect()} == {"a": "x", "b": None, "c": None}


def test_behaviour(spark):
    body = """
        // event(new Ignored())
        $this->authorize('update', $order);
        abort_if(!$ok, 403);
        DB::transaction(function () {
            $order->status = 'done';
            $order->update(['a' => 1]);
            $this->x = 1;
        });
        event(new OrderPlaced($order)); SendMailJob::dispatch($order);
    """
    got = spark.createDataFrame([(body,)], "b string").select(facts(F.col("b")).alias("f")).first().f
    assert got.guards == ["update", "abort_guard"] and got.has_transaction
    assert (got.events, got.jobs, got.mutations) == (["OrderPlaced"], ["SendMailJob"], ["order.status", "order.update()"])


def test_behaviour_of_several_marks(spark):
    body = """
        @UseGuards(AuthGuard, Other)
        Gate::authorize("see"); abort_unless($a, 1);
        broadcast(new Seen($x)); Event::dispatch(new Done()); this.eventEmitter.emit('user.made', u);
        this.queue.add('mail', {}); dispatch(new CleanTask()); $request->name = 1; $a->b == 2;
        await this.db.transaction(async () => {}); $user->delete();
    """
    got = spark.createDataFrame([(body,), (None,), ("",)], "b string").select(facts(F.col("b")).alias("f")).collect()
    f = got[0].f
    assert (f.guards, f.has_transaction, f.events) == (["AuthGuard", "Other", "see", "abort_guard"], True, ["Seen", "Done", "user.made"])
    assert (f.jobs, f.mutations) == (["mail", "CleanTask"], ["user.delete()"])
    assert (got[2].f.guards, got[2].f.has_transaction, got[2].f.mutations) == ([], False, [])


def test_all_guards_and_every_way_to_dispatch(spark):
    body = "@UseGuards(AuthGuard('jwt'), RolesGuard, new ScopeGuard(a, b))\nrun() { ProcessPayment::dispatchSync($x); Bus::dispatch(new PayJob($y, f(1))); MailJob::dispatchIf(true); dispatch(new Late()); el.dispatchEvent(new Event('x')); Event::dispatch(Seen::class); }"
    f = spark.createDataFrame([(body,)], "b string").select(facts(F.col("b")).alias("f")).first().f
    assert f.guards == ["AuthGuard", "RolesGuard", "ScopeGuard"]
    assert f.jobs == ["ProcessPayment", "PayJob", "MailJob", "Late"] and f.events == ["Seen"]


def test_standard_names_and_empty_targets(spark):
    asks = [("m.py", "python", "bz2"), ("m.py", "python", "calendar"), ("m.py", "python", "nowhere"), ("m.php", "php", "Exception"), ("m.php", "php", "\\Closure"), ("m.php", "php", "PDO"), ("m.php", "php", "Unknown\\Lib"), ("m.ts", "typescript", ""), ("m.php", "php", "")]
    rows = resolve(spark.createDataFrame(asks, "source string, language string, target string"), spark.createDataFrame([("m.py",)], "path string"), Rules()).collect()
    assert {(r.language, r.target): r.status for r in rows} == {(g, t): "external" if t in ("bz2", "calendar", "Exception", "\\Closure", "PDO") else "unresolved" for _, g, t in asks}
