"""Import resolution: existence checks as joins on the scanned listing.

Every import becomes its candidate paths, in order of preference; one join with
the file listing keeps those that exist, and a count decides the status. Rules
of the workspace's manifests (aliases, prefixes, declared packages) come as
small tables parsed by the driver.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.text import resolve_relative
from codeloom.plans.shared import materialize

# Endings that an import may leave out, and what compiled endings stand for.
JS_ENDINGS = (".ts", ".tsx", ".mts", ".cts", ".js", ".jsx", ".mjs", ".cjs", ".json", ".vue", ".d.ts")
COMPILED = {".js": (".ts", ".tsx", ".d.ts"), ".mjs": (".mts",), ".cjs": (".cts",), ".jsx": (".tsx",)}
NODE_BUILTINS = tuple("assert buffer child_process cluster crypto dgram dns events fs http http2 https module net os path perf_hooks process querystring readline stream string_decoder timers tls tty url util v8 vm worker_threads zlib bun".split())
#: The standard library of the Python that runs the driver.
PYTHON_STDLIB = tuple(sorted(sys.stdlib_module_names))
# Classes and interfaces that PHP itself declares.
PHP_CLASSES = tuple(
    "ArgumentCountError ArithmeticError ArrayAccess ArrayIterator ArrayObject Attribute BackedEnum CachingIterator Closure Collator Countable CURLFile DateInterval DatePeriod DateTime DateTimeImmutable DateTimeInterface DateTimeZone DirectoryIterator DivisionByZeroError DOMDocument DOMElement DOMNode DOMXPath DomainException Error ErrorException Exception Fiber FilesystemIterator FilterIterator Generator InvalidArgumentException Iterator IteratorAggregate IteratorIterator JsonException JsonSerializable LengthException LimitIterator Locale LogicException MessageFormatter mysqli NumberFormatter OuterIterator OutOfBoundsException OutOfRangeException OverflowException ParseError PDO PDOException PDOStatement Phar RangeException RecursiveDirectoryIterator RecursiveIteratorIterator Reflection ReflectionClass ReflectionException ReflectionFunction ReflectionMethod ReflectionNamedType ReflectionObject ReflectionProperty RegexIterator RuntimeException Serializable SimpleXMLElement SoapClient SplDoublyLinkedList SplFileInfo SplFileObject SplFixedArray SplHeap SplMaxHeap SplMinHeap SplObjectStorage SplPriorityQueue SplQueue SplStack SplSubject SplObserver stdClass Stringable Throwable Transliterator Traversable TypeError UnderflowException UnexpectedValueException UnitEnum UnhandledMatchError ValueError WeakMap WeakReference XMLReader XMLWriter ZipArchive".split()
)


@dataclass(frozen=True)
class Rules:
    """What a workspace's manifests say."""

    #: Alias patterns with at most one ``*`` and their substitutions, in order.
    aliases: dict[str, list[str]] = field(default_factory=dict)
    js_packages: tuple[str, ...] = ()
    python_roots: tuple[str, ...] = ("src", "")
    python_packages: tuple[str, ...] = ()
    #: PHP namespace prefixes and their folders.
    psr4: dict[str, list[str]] = field(default_factory=dict)
    php_vendors: tuple[str, ...] = ()
    go_module: str | None = None


def _among(name: Column, names: tuple[str, ...]) -> Column:
    return name.isin(*names) if names else F.lit(False)


def _folder(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"^(.*)/[^/]*\z", 1), r"^/", "")


def _js_candidates(base: Column) -> Column:
    plain = [F.concat(base, F.lit(e)) for e in JS_ENDINGS]
    index = [F.concat(base, F.lit("/index" + e)) for e in JS_ENDINGS]
    swapped = [F.when(F.endswith(base, F.lit(old)), F.concat(F.regexp_replace(base, old.replace(".", r"\.") + r"\z", ""), F.lit(e))) for old, new in COMPILED.items() for e in new]
    return F.array(base, *swapped, *plain, *index)


def _aliased(target: Column, rules: Rules) -> Column:
    """The first alias that fits, exact ones first, then by the longest text before the ``*``; its substitutions."""
    order = sorted(rules.aliases, key=lambda a: ("*" in a, -len(a.split("*")[0])))
    out = None
    for a in order:
        head, star, tail = a.partition("*")
        fits = target == a if not star else F.startswith(target, F.lit(head)) & F.endswith(target, F.lit(tail)) & (F.length(target) >= len(head) + len(tail))
        middle = F.substring(target, F.lit(len(head) + 1), F.length(target) - len(head) - len(tail))
        to = F.array(*[F.concat(F.lit(s.partition("*")[0]), middle if "*" in s else F.lit(""), F.lit(s.partition("*")[2])) for s in rules.aliases[a]])
        out = F.when(fits, to) if out is None else out.when(fits, to)
    return F.coalesce(out if out is not None else F.lit(None).cast("array<string>"), F.array().cast("array<string>"))


def candidates(imports: DataFrame, rules: Rules) -> DataFrame:
    """imports with ``status`` when no file can decide it, and ``paths`` to try otherwise, in groups that all belong to one answer.

    ``imports`` has source, language and target.
    """
    target, language = F.col("target"), F.col("language")
    js, py, go, php = language.isin("typescript", "javascript", "frontend"), language == "python", language == "go", language == "php"
    here = _folder(F.col("source"))
    relative = target.startswith(".")
    joined = resolve_relative(here, target)
    package = F.regexp_extract(target, r"^((?:@[^/]+/)?[^/]+)", 1)
    aliased = F.flatten(F.transform(_aliased(target, rules), _js_candidates))
    js_paths = F.when(relative, _js_candidates(joined)).when(F.size(_aliased(target, rules)) > 0, aliased).when(target.startswith("@/"), _js_candidates(F.concat(F.lit("src/"), F.substring(target, F.lit(3), F.length(target)))))
    js_status = F.when(F.regexp_replace(package, "^(?:node|bun):", "").isin(*NODE_BUILTINS) | target.rlike("^(?:node|bun):"), "external").when(_among(package, rules.js_packages), "external")

    dots = F.length(F.regexp_extract(target, r"^(\.+)", 1))
    dotted = F.replace(F.regexp_replace(target, r"^\.+", ""), F.lit("."), F.lit("/"))
    up = F.concat_ws("/", F.when(dots > 1, F.array_join(F.array_repeat(F.lit(".."), dots - 1), "/")), F.nullif(dotted, F.lit("")))
    module = lambda base: F.array(F.concat(base, F.lit(".py")), F.concat(base, F.lit("/__init__.py")))
    roots = [F.concat(F.lit(r + "/" if r else ""), dotted) for r in rules.python_roots] + [F.concat_ws("/", F.nullif(here, F.lit("")), dotted)]
    py_paths = F.when(relative, module(resolve_relative(here, up))).otherwise(F.flatten(F.array(*[module(r) for r in roots])))
    first = F.regexp_extract(target, r"^([^.]+)", 1)
    py_status = F.when(~relative & first.isin(*PYTHON_STDLIB, *rules.python_packages), "external")

    psr = None
    for prefix in sorted(rules.psr4, key=len, reverse=True):
        rest = F.replace(F.substring(target, F.lit(len(prefix) + 1), F.length(target)), F.lit("\\"), F.lit("/"))
        to = F.array(*[F.concat(F.lit(d.rstrip("/") + "/" if d.rstrip("/") else ""), rest, F.lit(".php")) for d in rules.psr4[prefix]])
        fits = F.startswith(target, F.lit(prefix))
        psr = F.when(fits, to) if psr is None else psr.when(fits, to)
    php_paths = psr if psr is not None else F.lit(None).cast("array<string>")
    bare = F.regexp_replace(target, r"^\\", "")
    php_status = F.when(_among(F.regexp_extract(target, r"^\\?([^\\]+)", 1), rules.php_vendors) | bare.isin(*PHP_CLASSES), "external")

    own = F.lit(rules.go_module or "\0")
    inside = (target == own) | F.startswith(target, F.concat(own, F.lit("/")))
    go_status = F.when(~inside & (~target.contains("/") | ~F.element_at(F.split(target, "/"), 1).contains(".") | target.contains(".")), "external")

    status = (
        F.when(target.startswith("dynamic:"), "unresolved")
        .when(js, F.when(relative & joined.isNull(), "unsupported").when(js_paths.isNull(), F.coalesce(js_status, F.lit("unresolved"))))
        .when(py, F.when(relative & resolve_relative(here, up).isNull(), "unsupported").otherwise(py_status))
        .when(php, F.when(php_paths.isNull(), F.coalesce(php_status, F.lit("unresolved"))))
        .when(go, go_status)
        .otherwise("unsupported")
    )
    paths = F.when(js, js_paths).when(py, py_paths).when(php, php_paths)
    folder = F.when(go & inside, F.regexp_replace(F.substring(target, F.lit(len(rules.go_module or "") + 1), F.length(target)), "^/", ""))
    return imports.withColumn("decided", status).withColumn("paths", F.when(status.isNull(), paths)).withColumn("go_folder", F.when(status.isNull(), folder))


def resolve(imports: DataFrame, files: DataFrame, rules: Rules) -> DataFrame:
    """Every import with its status (resolved, external, unresolved, ambiguous, unsupported) and the files it names.

    An import with one existing candidate is resolved, with several ambiguous;
    of Python's and PHP's the first in order is taken. A Go import names all
    files of its folder but tests.
    """
    # Written once: numbers given to rows must not change when the plan runs again.
    rows = materialize(candidates(imports, rules).withColumn("__id", F.monotonically_increasing_id()), "resolve")
    tried = rows.filter("paths is not null").select("__id", "language", F.posexplode(F.array_distinct("paths")).alias("rank", "path"))
    found = tried.join(files.select("path").distinct(), "path", "left_semi")
    every = found.groupBy("__id").agg(F.array_sort(F.collect_list(F.struct("rank", "path"))).alias("f"))
    first = F.transform("f", lambda x: x["path"])
    packages = files.select("path", _folder(F.col("path")).alias("go_folder")).filter("path like '%.go' and path not like '%\\_test.go'")
    go = rows.filter("go_folder is not null").select("__id", "go_folder").join(packages, "go_folder").groupBy("__id").agg(F.array_sort(F.collect_set("path")).alias("g"))
    joined = rows.join(every.select("__id", first.alias("f")), "__id", "left").join(go, "__id", "left")
    ordered = F.col("language").isin("python", "php")
    targets = F.coalesce("g", F.when(ordered, F.slice("f", 1, 1)).otherwise(F.col("f")), F.array().cast("array<string>"))
    status = F.coalesce("decided", F.when(F.size(targets) == 0, "unresolved").when((F.size(targets) > 1) & F.col("g").isNull(), "ambiguous").otherwise("resolved"))
    return joined.select(*imports.columns, status.alias("status"), targets.alias("files"))


def target_domain(resolved: DataFrame, files: DataFrame) -> DataFrame:
    """Adds the one domain that a resolved import's files lie in; null when none or several.

    ``files`` has path and domain.
    """
    rows = materialize(resolved.withColumn("__id", F.monotonically_increasing_id()), "resolve")
    owners = rows.filter("status = 'resolved'").select("__id", F.explode("files").alias("path")).join(files.select("path", "domain"), "path")
    one = owners.groupBy("__id").agg(F.min("domain").alias("lo"), F.max("domain").alias("hi")).filter("lo = hi").select("__id", F.col("lo").alias("target_domain"))
    return rows.join(one, "__id", "left").drop("__id")


def rules_table(spark: SparkSession, rules: Rules) -> DataFrame:
    """A digest of the consulted rules, to tell answers of other revisions apart."""
    return spark.createDataFrame([(repr(rules),)], "rules string").select(F.sha2("rules", 256).alias("config_revision"))
