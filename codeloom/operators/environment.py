"""The environment that repositories run in: layers, nodes, rules across layers, open questions.

Every repository is read in one pass. A file of a known name becomes a few marks
where it lies, so that one shuffle by (repository, unit) moves marks, no texts; a
unit is a repository or a service below it. Layers are then decided by ordered
rules over a unit's marks, nodes are made from layers, and rules across layers
are boolean aggregates of a repository's nodes. Members of a rule are rows, so a
repository of very many services is no large row anywhere.

A null path is no file, a null or malformed content an empty one; of a path given
twice any one content counts. Folders count by the files in them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import platform_tag
from codeloom.operators.topology import merge

LAYERS = ("edge", "gateway", "host", "runtime", "storage", "telemetry")
OPEN = ("AMBIGUOUS", "UNRESOLVED")
# Folders that are services of a repository, or hold them.
BACKENDS, FRONTENDS, NESTS = ("backend", "api"), ("frontend", "web", "client", "ui"), ("apps", "services")
FRONTEND_WORDS = ("web", "ui", "client")
# Marks, platforms and tags of layers, tried in this order; then what stands when none is met.
EDGE = (
    (("file:wrangler.toml", "file:wrangler.json"), "Cloudflare (Workers / Pages / Edge)", "cdn_edge", "wrangler.toml"),
    (("env:CLOUDFLARE_*", "env:TURNSTILE_*"), "Cloudflare (Edge Proxy, WAF & Bot Mitigation)", "cdn_edge", ".env"),
    (("env:CLOUDFRONT_*", "env:AWS_CF_*"), "AWS CloudFront CDN", "cdn_edge", ".env"),
)
GATEWAY = (
    (("litespeed:public/.htaccess",), "LiteSpeed Web Server", "shared_hosting", "public/.htaccess"),
    (("file:public/.htaccess",), "Apache / LiteSpeed Web Server", "shared_hosting", "public/.htaccess"),
    (("litespeed:.htaccess",), "LiteSpeed Web Server", "shared_hosting", ".htaccess"),
    (("file:.htaccess",), "Apache / LiteSpeed Web Server", "shared_hosting", ".htaccess"),
    (("file:nginx.conf", "file:docker/nginx/nginx.conf"), "Nginx Reverse Proxy", "vps", "nginx.conf"),
    (("file:Caddyfile",), "Caddy Web Server", "vps", "Caddyfile"),
)
HOST = (
    (("file:Dockerfile", "file:docker-compose.yml", "file:docker-compose.yaml"), "Containerized Compute (Docker / Dedicated VPS)", "docker", "Dockerfile / docker-compose.yml"),
    (("file:fly.toml",), "Fly.io MicroVMs", "paas", "fly.toml"),
    (("file:vercel.json",), "Vercel Serverless Edge", "serverless", "vercel.json"),
    (("file:render.yaml",), "Render Cloud Platform", "paas", "render.yaml"),
)
TELEMETRY = (
    (("text:SENTRY_DSN", "composer:sentry/sentry-laravel", "own:@sentry/vue", "own:@sentry/browser"), "Sentry Error & Performance Monitoring", None, "Sentry SDK in dependencies / .env"),
    (("text:OTEL_", "own:@opentelemetry/api"), "OpenTelemetry Distributed Tracing", None, "OpenTelemetry SDK"),
    ((), "Application Log Files (Local / Daily)", None, "Standard Framework Logger"),
)
# Stores by their marks. Of the first three one counts; a later label counts when no earlier one has its first word.
MYSQL, POSTGRES, SQLITE, REDIS = "MySQL / MariaDB", "PostgreSQL", "SQLite (Embedded / Local WAL)", "Redis (Cache & Queues)"
ENV_STORES = (
    (("env:DB_CONNECTION=mysql", "env:DB_PORT=3306", "env:MYSQL_*"), MYSQL, ".env"),
    (("env:DB_CONNECTION=pgsql", "env:DB_PORT=5432", "env:POSTGRES_*"), POSTGRES, ".env"),
    (("env:DB_CONNECTION=sqlite",), "SQLite (File-based)", ".env"),
    (("file:database/database.sqlite",), "SQLite (File-based)", "database/database.sqlite"),
)
STORES = (
    (("env:QUEUE_CONNECTION=redis", "env:REDIS_HOST!", "env:REDIS_CLIENT"), REDIS, ".env"),
    (("npm:mysql2", "npm:mysql"), MYSQL, "package.json"),
    (("npm:pg", "npm:postgres"), POSTGRES, "package.json"),
    (("npm:better-sqlite3", "npm:sqlite3", "npm:@libsql/client"), SQLITE, "package.json"),
    (("npm:redis", "npm:ioredis"), REDIS, "package.json"),
    (("go:go-sql-driver/mysql", "go:driver/mysql"), MYSQL, "go.mod"),
    (("go:lib/pq", "go:jackc/pgx", "go:driver/postgres"), POSTGRES, "go.mod"),
    (("go:mattn/go-sqlite3", "go:modernc.org/sqlite", "go:driver/sqlite"), SQLITE, "go.mod"),
    (("go:go-redis",), REDIS, "go.mod"),
)
BUN_CONNECTION = "src/core/database/connection.ts"
BUN_ENTRIES = ("src/index.ts", "src/db.ts", "src/database.ts")
ORM = ("npm:@prisma/client", "npm:drizzle-orm")
SCHEMAS = (('"sqlite"', SQLITE), ('"postgresql"', POSTGRES), ('"mysql"', MYSQL))
PLAIN_ORM = "SQL Database (Prisma / Drizzle ORM)"
UNKNOWN = {
    "edge": ("Direct Ingress / Unresolved Edge", "AMBIGUOUS"),
    "gateway": ("Standard Ingress / Unknown Web Server", "AMBIGUOUS"),
    "host": ("Virtual Server / Unknown Host", "UNRESOLVED"),
    "runtime": ("Generic Runtime", "UNRESOLVED"),
    "storage": ("Relational Database / Storage", "AMBIGUOUS"),
}
SHARED_HOST = "Shared Hosting (Hostinger / cPanel) or Unmanaged VPS"
LITESPEED = ("Litespeed", "LSCache", "<IfModule LiteSpeed>")
INERTIA = ("own:@inertiajs/vue3", "own:@inertiajs/inertia-vue3", "dev:@inertiajs/vue3")
#: What to ask where a layer is open.
QUESTIONS = {
    "edge": "Does traffic pass a proxy or firewall at the edge, or reach the server directly?",
    "gateway": "Which web server takes the requests?",
    "host": "On what kind of host will this run: shared, a virtual server, containers or a platform?",
    "runtime": "Which language and runtime run this application?",
    "storage": "Which databases and caches does this use?",
}
SHARED_QUESTION = "Is this a shared host, or a server of its own?"
# Names of a repository's nodes without and with services, and of rules across layers.
NODES = {"edge": "Perimeter Edge WAF", "gateway": "Web Ingress", "host": "Primary Host", "runtime": "Application Runtime", "storage": "Database & Cache", "telemetry": "Observability Pipeline"}
NODES_OF_MANY = {"edge": "Perimeter Edge WAF", "host": "Compute Host", "storage": "Primary Storage", "telemetry": "Telemetry Pipeline"}
PROXY = "Perimeter Bot Protection & Trusted Proxy Invariant"
WORKERS = "Shared Hosting Background Execution Invariant"
CACHE = "LiteSpeed Cache vs Inertia Dynamic State Invariant"
COOKIES = "Cross-Domain Cookie & CORS Security Invariant"
MIGRATION = "Distributed Database Migration Concurrency Invariant"
SCHEDULER = "Distributed Scheduler & Cron Invariant"

_RULES = (*EDGE, *GATEWAY, *HOST, *TELEMETRY, *ENV_STORES, *STORES)
_MARKS = tuple(dict.fromkeys(m for rule in _RULES for m in rule[0])) + ORM + INERTIA + ("npm:@types/bun",)
_ENV = ".env", ".env.example"
_PARSED = (*_ENV, "composer.json", "package.json", "go.mod", "prisma/schema.prisma")
#: Repositories a task takes: their texts repeat, so the bytes of a shuffle, by which Spark joins its parts, tell little of their rows.
REPOSITORIES = 25_000
#: Paths in a unit that any rule reads.
PATHS = tuple(dict.fromkeys([m.removeprefix("file:") for m in _MARKS if m.startswith("file:")] + [*_PARSED, BUN_CONNECTION, *BUN_ENTRIES]))
_JSON = "dependencies map<string,string>, devDependencies map<string,string>, require map<string,string>, engines map<string,string>"


def _named(kind: str) -> list[str]:
    return [m.removeprefix(kind) for m in _MARKS if m.startswith(kind)]


def _strings(values) -> Column:
    values = list(values)
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def services(paths: DataFrame) -> DataFrame:
    """Each file of (repo, path, ...) in its service: columns unit, service, kind and within; null outside services."""
    parts = F.split("path", "/")
    top, sub = F.get(parts, F.lit(0)), F.get(parts, F.lit(1))
    nested = top.isin(*NESTS) & (F.size(parts) > 2)
    own = top.isin(*BACKENDS, *FRONTENDS) & (F.size(parts) > 1)
    unit = F.when(nested, F.concat_ws("/", top, sub)).when(own, top)
    wordy = reduce(lambda a, b: a | b, [F.contains(F.lower(sub), F.lit(w)) for w in FRONTEND_WORDS])
    kind = F.when(nested, F.when(wordy, "frontend").otherwise("service")).when(own, F.when(top.isin(*FRONTENDS), "frontend").otherwise("backend"))
    return paths.select("*", unit.alias("unit"), F.when(nested, F.concat_ws("-", top, sub)).when(own, top).alias("service"), kind.alias("kind"), F.when(unit.isNotNull(), F.substring(F.col("path"), F.length(unit) + 2, F.length("path"))).alias("within"))


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+\z", "")


def _pairs(content: Column) -> Column:
    """(key, value) of the lines of an environment file; comments and lines without a sign of equality are none."""
    lines = F.filter(F.transform(F.split(content, "\r?\n"), _stripped), lambda s: ~s.startswith("#") & F.contains(s, F.lit("=")))

    def pair(line: Column) -> Column:
        at = F.instr(line, "=")
        value = _stripped(F.substring(line, at + 1, F.length(line)))
        quoted = (F.length(value) > 1) & ((value.startswith('"') & value.endswith('"')) | (value.startswith("'") & value.endswith("'")))
        return F.struct(_stripped(F.substring(line, F.lit(1), at - 1)).alias("key"), F.when(quoted, F.substring(value, F.lit(2), F.length(value) - 2)).otherwise(value).alias("value"))

    return F.transform(lines, pair)


def marked(files: DataFrame) -> DataFrame:
    """(repo, unit, service, kind, marks, values) of every unit: a repository (unit ``''``) or a service of it.

    ``files`` has repo, path and content; only contents of :data:`PATHS` are
    looked at, and where they lie. ``values`` has the versions that runtimes
    state and the environment's values, of which ``.env`` has the last word.
    """
    rows = services(files.filter("path is not null").select("repo", "path", "content"))
    spot = F.array(F.struct(F.lit("").alias("unit"), F.lit("").alias("service"), F.lit("repository").alias("kind"), F.col("path").alias("within")), F.struct("unit", "service", "kind", "within"))
    rows = rows.select("repo", F.explode(F.filter(spot, lambda s: s["unit"].isNotNull())).alias("s"), "content").select("repo", "s.*", "content")
    known = F.col("within").isin(*PATHS)
    rows = rows.select("repo", "unit", "service", "kind", F.when(known, F.col("within")).alias("at"), F.when(known, F.coalesce("content", F.lit(""))).alias("content"))
    at, content = F.col("at"), F.col("content")

    def when(test: Column, marks: Column) -> Column:
        return F.when(test, marks).otherwise(_strings(()))

    def holding(prefix: str, names) -> Column:
        """Marks of those ``names`` that the content holds."""
        return F.transform(F.filter(_strings(names), lambda n: F.contains(content, n)), lambda n: F.concat(F.lit(prefix), n))

    env, json = at.isin(*_ENV), at.isin("composer.json", "package.json")
    rows = rows.withColumn("pairs", F.when(env, _pairs(content))).withColumn("json", F.when(json, F.from_json("content", _JSON)))
    keys = F.coalesce(F.transform("pairs", lambda p: p["key"]), _strings(()))
    starts = [m.removesuffix("*") for m in _named("env:") if m.endswith("*")]
    met = F.transform(F.filter(_strings(starts), lambda s: F.exists(keys, lambda k: k.startswith(s))), lambda s: F.concat(F.lit("env:"), s, F.lit("*")))

    def listed(field: str, prefix: str, names) -> Column:
        """Marks of those ``names`` that a manifest's map gives a version."""
        versions = F.col("json")[field]
        return F.transform(F.filter(_strings(names), lambda n: F.coalesce(versions[n] != "", F.lit(False))), lambda n: F.concat(F.lit(prefix), n))

    npm = list(dict.fromkeys(_named("npm:")))
    package = at == "package.json"
    marks = F.concat(
        when(at.isNotNull(), F.array(F.concat(F.lit("file:"), at))),
        when(at.isin("public/.htaccess", ".htaccess") & reduce(lambda a, b: a | b, [F.contains(content, F.lit(w)) for w in LITESPEED]), F.array(F.concat(F.lit("litespeed:"), at))),
        when(env, met),
        when(env & (content != ""), F.concat(F.array(F.concat(F.lit("full:"), at)), F.transform(holding("text:", _named("text:")), lambda m: F.concat(at, F.lit("|"), m)))),
        when(package, F.concat(listed("dependencies", "npm:", npm), listed("devDependencies", "npm:", npm), listed("dependencies", "own:", _named("own:")), listed("devDependencies", "dev:", _named("dev:")))),
        when(at == "composer.json", listed("require", "composer:", ["sentry/sentry-laravel", "laravel/framework"])),
        when(at == "go.mod", holding("go:", _named("go:"))),
        when(at == "prisma/schema.prisma", holding("prisma:", [s for s, _ in SCHEMAS])),
        when(at.isin(BUN_CONNECTION, *BUN_ENTRIES) & F.contains(content, F.lit("bun:sqlite")), F.array(F.concat(F.lit("bun:"), at))),
    )
    names = ["DB_CONNECTION", "DB_PORT", "QUEUE_CONNECTION", "REDIS_HOST", "REDIS_CLIENT"]

    def last(name: str) -> Column:
        """Of lines with one key the last counts, and those of ``.env`` before the example's."""
        value = F.try_element_at(F.transform(F.filter("pairs", lambda p: p["key"] == name), lambda p: p["value"]), F.lit(-1))
        return F.max_by(value, F.when(value.isNotNull(), at == ".env")).alias(name)

    found = [last(name) for name in names]
    versions = [F.max(F.when(at == "composer.json", F.col("json.require")["php"])).alias("php"), F.max(F.when(package, F.col("json.engines")["node"])).alias("node"), F.max(F.when(package, F.col("json.engines")["bun"])).alias("bun")]
    # A file without marks adds nothing to a list; collecting sets keeps one copy of each mark before the shuffle.
    unit = rows.select("*", marks.alias("marks")).groupBy("repo", "unit", "service", "kind").agg(F.array_distinct(F.flatten(F.collect_set(F.when(F.size("marks") > 0, F.col("marks"))))).alias("marks"), *found, *versions)
    valued = F.filter(F.array(*[F.concat(F.lit(f"env:{n}="), F.lower(n)) for n in names[:3]], F.when(F.col("REDIS_HOST") != "", "env:REDIS_HOST!"), F.when(F.col("REDIS_CLIENT").isNotNull(), "env:REDIS_CLIENT")), lambda m: m.isNotNull())
    marks = F.col("marks")
    example = F.array_contains(marks, "full:.env.example")
    text = F.transform(F.filter(marks, lambda m: m.startswith(".env.example|") | (m.startswith(".env|") & ~example)), lambda m: F.element_at(F.split(m, r"\|"), -1))
    return unit.select("repo", "unit", "service", "kind", F.concat(marks, valued, text).alias("marks"), F.nullif("php", F.lit("")).alias("php"), F.nullif("node", F.lit("")).alias("node"), F.nullif("bun", F.lit("")).alias("bun"))


def _has(*names: str) -> Column:
    return F.arrays_overlap("marks", _strings(names)) if names else F.lit(True)


def _layer(layer: str, platform: Column, tag: Column | str | None, status: str, found: Column, question: str | None) -> Column:
    tag = tag if isinstance(tag, Column) else F.lit(tag).cast("string")
    return F.struct(F.lit(layer).alias("layer"), platform.alias("platform"), tag.alias("tag"), F.lit(status).alias("status"), found.alias("detected_from"), F.lit(question).cast("string").alias("question"))


def _ruled(layer: str, rules, otherwise: Column | None = None) -> Column:
    if otherwise is None and layer in UNKNOWN:
        platform, status = UNKNOWN[layer]
        otherwise = _layer(layer, F.lit(platform), None if layer == "runtime" else "unspecified", status, _strings(()), QUESTIONS[layer])
    for names, platform, tag, source in reversed(rules):
        platform = platform if isinstance(platform, Column) else F.lit(platform)
        source = source if isinstance(source, Column) else _strings([source])
        own = _layer(layer, platform, tag, "DETECTED", source, None)
        otherwise = own if otherwise is None else F.when(_has(*names), own).otherwise(otherwise)
    return otherwise


def _stored() -> Column:
    """The layer of stores: labels in their order, one for each first word, and all that showed them."""
    store = lambda label, source: F.struct(F.lit(label).alias("label"), F.lit(source).alias("source"))
    first = reduce(lambda rest, rule: F.when(_has(*rule[0]), store(*rule[1:])).otherwise(rest), reversed(ENV_STORES), F.lit(None))
    bun = F.when(_has(f"bun:{BUN_CONNECTION}"), store(SQLITE, f"{BUN_CONNECTION} (bun:sqlite)"))
    entry = reduce(lambda rest, path: F.when(_has(f"bun:{path}"), store(SQLITE, path)).otherwise(rest), reversed(BUN_ENTRIES), F.lit(None))
    bun = bun.when(_has("npm:@types/bun") | F.col("bun").isNotNull(), entry)
    met = F.filter(F.array(first, *[F.when(_has(*names), store(label, source)) for names, label, source in STORES], bun), lambda s: s.isNotNull())
    plain = reduce(lambda rest, s: F.when(_has(f"prisma:{s[0]}"), store(s[1], "prisma/schema.prisma")).otherwise(rest), reversed(SCHEMAS), store(PLAIN_ORM, "package.json"))
    met = F.when((F.size(met) == 0) & _has(*ORM), F.array(plain)).otherwise(met)
    word = lambda s: F.split_part(s["label"], F.lit(" "), F.lit(1))
    labels = F.transform(F.array_distinct(F.transform(met, word)), lambda w: F.get(F.filter(met, lambda s: word(s) == w), F.lit(0))["label"])
    known = _layer("storage", F.array_join(labels, " + "), "managed_db", "DETECTED", F.array_distinct(F.transform(met, lambda s: s["source"])), None)
    return F.when(F.size(met) > 0, known).otherwise(_ruled("storage", ()))


def layers(units: DataFrame) -> DataFrame:
    """(repo, unit, service, kind, layer, platform, tag, status, detected_from, question) from :func:`marked`'s units.

    A repository has all six layers, a service its gateway and runtime.
    """
    inertia = _has("file:package.json") & _has(*INERTIA)
    php = F.concat(F.lit("PHP "), F.coalesce("php", F.lit(">=8.1")), F.lit(" (FPM / FastCGI)"), F.when(_has("composer:laravel/framework"), " + Laravel").otherwise(""), F.when(inertia, " + Inertia/Vue").otherwise(""))
    node = F.concat(F.lit("Node.js ("), F.coalesce("node", F.lit(">=18")), F.lit(") / Bun"))
    runtime = ((("file:composer.json",), php, None, F.when(inertia, _strings(["composer.json", "package.json"])).otherwise(_strings(["composer.json"]))), (("file:go.mod",), "Golang (Compiled Native Binary)", None, "go.mod"), (("file:package.json",), node, None, "package.json"))
    found = units.withColumn("gateway", _ruled("gateway", GATEWAY))
    shared = _layer("host", F.lit(SHARED_HOST), "shared_hosting", "AMBIGUOUS", F.col("gateway.detected_from"), SHARED_QUESTION)
    by_gateway = F.when(F.exists("gateway.detected_from", lambda f: F.contains(f, F.lit(".htaccess"))), shared).otherwise(_ruled("host", ()))
    own = F.array(F.col("gateway"), _ruled("runtime", runtime))
    every = F.concat(own, F.array(_ruled("edge", EDGE), _ruled("host", HOST, by_gateway), _stored(), _ruled("telemetry", TELEMETRY)))
    return found.select("repo", "unit", "service", "kind", F.inline(F.when(F.col("unit") == "", every).otherwise(own)))


def of_repositories(found: DataFrame, saved: DataFrame | None = None) -> DataFrame:
    """(repo, layer, platform, tag, status, detected_from, question) of repositories; a verified layer of ``saved`` stands."""
    own = found.filter("unit = ''").drop("unit", "service", "kind")
    return own if saved is None else merge(saved.select(*own.columns).join(own.select("repo", "layer"), ["repo", "layer"], "left_semi"), own, ["repo", "layer"])


NODE = ("repo", "id", "layer", "name", "platform", "tag", "role", "status", "detected_from", "connected_to", "address", "question")


def nodes(found: DataFrame, own: DataFrame, saved: DataFrame | None = None) -> DataFrame:
    """(:data:`NODE`) of every repository, from all units' layers, and repositories' layers.

    A repository without services has a node a layer. One with services has a
    runtime for each, a gateway for each that shows its own, and nodes of its
    other layers. Verified nodes of ``saved`` stand, and those found nowhere stay.
    """
    none, empty = F.lit(None).cast("string"), _strings(())
    many = found.filter("unit <> ''").select("repo").distinct().withColumn("many", F.lit(True)).hint("merge")
    layer, tag = F.col("layer"), F.coalesce("tag", F.lit("unspecified"))
    pick = lambda table: F.element_at(F.create_map(*[F.lit(v) for kv in table.items() for v in kv]), layer)
    rows = own.join(many, "repo", "left").withColumn("name", F.when(F.col("many"), F.try_element_at(F.create_map(*[F.lit(v) for kv in NODES_OF_MANY.items() for v in kv]), layer)).otherwise(pick(NODES)))
    to = F.when(layer == "gateway", _strings(["runtime:primary"])).when(layer == "runtime", _strings(["storage:primary"])).otherwise(empty)
    tag_of = F.when(layer == "telemetry", "unspecified").otherwise(tag)
    single = rows.filter("name is not null").select("repo", F.concat(layer, F.lit(":primary")).alias("id"), "layer", "name", "platform", tag_of.alias("tag"), none.alias("role"), "status", "detected_from", to.alias("connected_to"), none.alias("address"), F.when(layer != "telemetry", F.col("question")).alias("question"))
    front, runtime = F.col("kind") == "frontend", layer == "runtime"
    wired = F.when(~runtime, F.array(F.concat(F.lit("runtime:"), "service"))).when(F.col("kind") == "backend", _strings(["storage:primary"])).otherwise(_strings(["runtime:backend"]))
    role = F.when(runtime, F.when(front, "frontend_spa").otherwise("web_api"))
    below = found.filter((F.col("unit") != "") & (runtime | (F.col("status") == "DETECTED")))
    below = below.select("repo", F.concat_ws(":", "layer", "service").alias("id"), "layer", F.concat(F.upper("service"), F.when(runtime, " Engine").otherwise(" Ingress")).alias("name"), "platform", tag.alias("tag"), role.alias("role"), "status", F.when(runtime, F.array("unit")).otherwise(F.col("detected_from")).alias("detected_from"), wired.alias("connected_to"), none.alias("address"), "question")
    every = single.unionByName(below)
    return every if saved is None else merge(saved.select(*NODE), every, ["repo", "id"]).select(*NODE)


def to_save(saved: DataFrame, found: DataFrame, keys: list[str], refresh: bool = False) -> DataFrame:
    """Rows of ``found`` to write: those not yet saved; with ``refresh`` also those whose saved one is not verified."""
    kept = saved.filter("status = 'VERIFIED'") if refresh else saved
    return found.join(kept.select(*keys).distinct(), keys, "left_anti")


def _wide(own: DataFrame) -> DataFrame:
    """A row a repository: platform and tag of each layer."""
    at = lambda name, layer: F.max(F.when(F.col("layer") == layer, F.col(name)))
    return own.groupBy("repo").agg(*[at(c, layer).alias(f"{layer}_{c}") for layer in LAYERS for c in ("platform", "tag")])


def _counted(nodes_: DataFrame) -> DataFrame:
    """A row a repository: what its nodes show, as booleans and counts."""
    layer, id_, role, platform = F.col("layer"), F.col("id"), F.col("role"), F.lower("platform")
    dotted = F.when(F.contains("address", F.lit(".")), F.col("address"))
    any_ = lambda test: F.coalesce(F.bool_or(test), F.lit(False))
    return nodes_.groupBy("repo").agg(
        any_((F.col("tag") == "cdn_edge") | F.contains(platform, F.lit("cloudflare"))).alias("proxied"),
        any_((F.col("tag") == "shared_hosting") | (platform_tag(F.col("platform")) == "shared_hosting")).alias("shared"),
        any_(F.coalesce(role == "frontend_spa", F.lit(False)) | F.contains(id_, F.lit("frontend"))).alias("front"),
        any_(F.coalesce(role == "web_api", F.lit(False)) | F.contains(id_, F.lit("backend"))).alias("back"),
        # One address more than the least: as many as the rule asks, without a set of them.
        F.coalesce(F.min(dotted) < F.max(dotted), F.lit(False)).alias("apart"),
        F.count(dotted).alias("addresses"),
        F.count("*").alias("n_nodes"),
        F.count_if(layer == "host").alias("hosts"),
        F.count_if((layer == "runtime") & ~F.coalesce(role == "frontend_spa", F.lit(False))).alias("backends"),
    )


def interplays(own: DataFrame, nodes_: DataFrame) -> DataFrame:
    """(repo, rule, id): rules across layers that hold in a repository, with each node they concern; null where no node is."""
    flags = _wide(own).join(_counted(nodes_), "repo", "left")
    of = lambda c: F.lower(F.coalesce(c, F.lit("")))
    edge, gateway = of("edge_platform"), of("gateway_platform")
    cdn = (F.col("edge_tag") == "cdn_edge") | (platform_tag(F.col("edge_platform")) == "cdn_edge") | F.contains(edge, F.lit("cloudflare")) | F.col("proxied")
    shared = (F.col("host_tag") == "shared_hosting") | (platform_tag(F.col("host_platform")) == "shared_hosting") | F.col("shared")
    cached = ((F.col("gateway_tag") == "shared_hosting") | F.contains(gateway, F.lit("litespeed")) | F.contains(gateway, F.lit("apache"))) & F.contains(of("runtime_platform"), F.lit("inertia"))
    hosts, backends = F.col("hosts") > 1, F.col("backends") > 1
    rules = ((PROXY, cdn, ["edge", "runtime"]), (WORKERS, shared, ["host", "runtime"]), (CACHE, cached, ["gateway", "runtime"]), (COOKIES, F.col("apart") | (F.col("front") & F.col("back")), ["runtime", "gateway"]), (MIGRATION, hosts | backends, []), (SCHEDULER, hosts, ["host"]))
    met = F.filter(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(rule).alias("rule"), _strings(on).alias("on"))) for rule, test, on in rules]), lambda r: r.isNotNull())
    held = flags.select("repo", hosts.alias("hosts"), backends.alias("backends"), F.inline(met)).alias("h")
    node = F.col("n.layer")
    computing = ((node == "host") & F.col("hosts")) | ((node == "runtime") & F.col("backends") & ~F.coalesce(F.col("n.role") == "frontend_spa", F.lit(False)))
    concerns = (F.col("h.repo") == F.col("n.repo")) & F.when(F.col("rule") == MIGRATION, computing).otherwise(F.array_contains("on", node))
    return held.join(nodes_.select("repo", "id", "layer", "role").alias("n"), concerns, "left").select("h.repo", "rule", "n.id")


def pending(own: DataFrame, nodes_: DataFrame) -> DataFrame:
    """(repo, place, question): open questions of nodes, then those of layers that no node of the repository asks."""
    is_open = F.col("status").isin(*OPEN) & (F.coalesce("question", F.lit("")) != "")
    asked = nodes_.filter(is_open).select("repo", F.col("id").alias("place"), "question")
    # Questions repeat, so a side whose bytes let Spark broadcast it may be very many rows: these joins are by sorting.
    rest = own.filter(is_open).join(asked.select("repo", "question").distinct().hint("merge"), ["repo", "question"], "left_anti")
    return asked.unionByName(rest.select("repo", F.col("layer").alias("place"), "question"))


def dealt(rows: DataFrame, repositories: int) -> DataFrame:
    """``rows`` dealt by repo over tasks in keeping with the number of repositories, at least as many as a shuffle has."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, -(-repositories // REPOSITORIES)), "repo")


def summary(own: DataFrame, nodes_: DataFrame, services_: DataFrame, most: int = 6) -> DataFrame:
    """(repo, distributed, n_nodes, n_pending, overall_status, summary) of each repository; ``services_`` has the repo of each service."""
    # A repository has a row for each of its six layers; all that joins its wide row is dealt alike.
    by_repo = dealt(own, own.filter(F.col("layer") == LAYERS[0]).count())
    asked = pending(own, nodes_).groupBy("repo").agg(F.count("*").alias("asked"))
    rows = _wide(by_repo).join(_counted(nodes_).hint("merge"), "repo", "left").join(asked.hint("merge"), "repo", "left").join(services_.select("repo").distinct().withColumn("many", F.lit(True)).hint("merge"), "repo", "left")
    count = F.coalesce("n_nodes", F.lit(0))
    spread = F.coalesce((count > most) | (F.col("hosts") > 1) | (F.col("addresses") > 0), F.lit(False)) | F.coalesce("many", F.lit(False))
    n = F.coalesce("asked", F.lit(0))
    status = F.when(n == 0, "RESOLVED").otherwise("NEEDS_CLARIFICATION")
    mode = F.when(spread, F.concat(F.lit("Distributed Multi-Node ("), count.cast("string"), F.lit(" nodes)"))).otherwise("Monolithic Single-Node")
    # Fixed value: the format of the summary.
    way = F.concat_ws(" ➔ ", *[F.concat(F.lit(f"[{layer.capitalize()}: "), f"{layer}_platform", F.lit("]")) for layer in LAYERS[:-1]])
    text = F.concat(F.lit("Architecture Plane: ["), mode, F.lit("]. Pipeline: "), way, F.lit(". Status: "), status, F.lit("."))
    return rows.select("repo", spread.alias("distributed"), count.alias("n_nodes"), n.alias("n_pending"), status.alias("overall_status"), text.alias("summary"))
