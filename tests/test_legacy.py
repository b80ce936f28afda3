"""Each step of the legacy resolution, and the order between steps."""

from codeloom.operators.legacy import resolve_domains, resolve_files
from codeloom.operators.resolve import Rules


def test_files_by_every_step(spark):
    files = spark.createDataFrame([(p,) for p in ("src/a/Main.ts", "src/a/util.ts", "src/b/index.ts", "lib/util.js", "src/x.ts", "src/x.js", "deep/er/b.ts")], "path string")
    asks = {"./util.ts": ("src/a/util.ts", 1), "./MAIN": ("src/a/Main.ts", 2), "'./util'": ("src/a/util.ts", 2), "src/x.ts": ("src/x.ts", 3), "@/x": ("src/x.ts", 4), "src/b": ("src/b/index.ts", 4), "er/b": ("deep/er/b.ts", 5), "a/util": ("src/a/util.ts", 5), "b": ("deep/er/b.ts", 5), "zod": (None, None), "": (None, None), None: (None, None), "../../../x": (None, None)}
    rows = resolve_files(spark.createDataFrame([("src/a/Main.ts", t) for t in asks], "source string, target string"), files).collect()
    assert {r.target: (r.file, r.step) for r in rows} == asks


def test_domains_by_every_step(spark):
    domains = spark.createDataFrame([("shop", "src/shop", 1), ("cart", "src/shop/cart", 2), ("bank", "src/bank", 3), ("misc", "tools", 4)], "name string, root string, place int")
    files = spark.createDataFrame([("vendor/own.php", "misc")], "path string, domain string")
    symbols = spark.createDataFrame([("Ledger", "bank"), ("small", "bank")], "name string, domain string")
    packages = spark.createDataFrame([("@w/bank", "bank"), ("@w/bank-extra", "misc")], "name string, domain string")
    rules = Rules(aliases={"~/*": ["src/*"]}, psr4={"App\\": ["src/bank/"], "App\\Cart\\": ["src/shop/cart/"]})
    asks = {
        "./x": ("cart", 1), "../y": ("shop", 1), "...bank.z": ("bank", 1), "@w/bank": ("bank", 2), "@w/bank-extra/a": ("misc", 2), "src.shop.cart.item": ("cart", 3), "~/shop/x": ("shop", 4), "App\\Cart\\Item": ("cart", 5), "App\\Other": ("bank", 5),
        "vendor/own.php": ("misc", 6), "Some\\Ledger": ("bank", 7), "small": (None, None), "a/src/bank/b": ("bank", 8), "SRC/Shop/cart/x": ("shop", 8), "a/src/bank": (None, None), "zod": (None, None), None: (None, None),
    }
    rows = resolve_domains(spark.createDataFrame([("src/shop/cart/m.py", t) for t in asks], "source string, target string"), domains, files, symbols, packages, rules).collect()
    assert {r.target: (r.domain, r.step) for r in rows} == asks
