"""Layers, nodes, rules and questions of repositories of every kind."""

import pytest

from codeloom.operators import environment as env

REPOS = {
    "bare": {"README.md": "x"},
    "laravel": {
        "composer.json": '{"require": {"php": "^8.2", "laravel/framework": "^11"}}',
        "package.json": '{"dependencies": {"@inertiajs/vue3": "1"}}',
        "public/.htaccess": "<IfModule LiteSpeed>",
        ".htaccess": "plain",
        ".env.example": "DB_CONNECTION=pgsql\nREDIS_HOST=example\nSENTRY_DSN=\n",
        ".env": "# DB_PORT=3306\r\nDB_CONNECTION = 'MySQL'\r\nTURNSTILE_KEY=\"k\"\r\nREDIS_HOST=\r\n",
    },
    "node": {"package.json": '{"dependencies": {"pg": "8", "ioredis": "5", "@opentelemetry/api": "1"}, "devDependencies": {"sqlite3": "5", "postgres": "3"}, "engines": {"node": ">=20"}}', "Dockerfile": "", "nginx.conf": "", "wrangler.json": ""},
    "go": {"go.mod": "require github.com/jackc/pgx/v5\nrequire gorm.io/driver/sqlite", "fly.toml": None, "Caddyfile": "", "database/database.sqlite": ""},
    "broken": {"package.json": "{not json", "composer.json": None},
    "bun": {"package.json": '{"engines": {"bun": "1"}, "dependencies": {"drizzle-orm": "1"}}', "src/db.ts": "import x from 'bun:sqlite'", "src/index.ts": "no"},
    "prisma": {"package.json": '{"dependencies": {"@prisma/client": "5"}}', "prisma/schema.prisma": 'provider = "postgresql"'},
    "orm": {"package.json": '{"dependencies": {"drizzle-orm": "5"}}'},
    "many": {"backend/composer.json": "{}", "backend/.htaccess": "LSCache", "frontend/package.json": "{}", "apps/web-shop/nginx.conf": "", "apps/readme.md": "", "services/pay/go.mod": "", "web": "a file"},
}
LAYERS = {
    ("bare", "edge"): ("Direct Ingress / Unresolved Edge", "unspecified", "AMBIGUOUS", []),
    ("bare", "runtime"): ("Generic Runtime", None, "UNRESOLVED", []),
    ("bare", "telemetry"): ("Application Log Files (Local / Daily)", None, "DETECTED", ["Standard Framework Logger"]),
    ("laravel", "edge"): ("Cloudflare (Edge Proxy, WAF & Bot Mitigation)", "cdn_edge", "DETECTED", [".env"]),
    ("laravel", "gateway"): ("LiteSpeed Web Server", "shared_hosting", "DETECTED", ["public/.htaccess"]),
    ("laravel", "host"): (env.SHARED_HOST, "shared_hosting", "AMBIGUOUS", ["public/.htaccess"]),
    ("laravel", "runtime"): ("PHP ^8.2 (FPM / FastCGI) + Laravel + Inertia/Vue", None, "DETECTED", ["composer.json", "package.json"]),
    ("laravel", "storage"): ("MySQL / MariaDB", "managed_db", "DETECTED", [".env"]),
    ("laravel", "telemetry"): ("Sentry Error & Performance Monitoring", None, "DETECTED", ["Sentry SDK in dependencies / .env"]),
    ("node", "edge"): ("Cloudflare (Workers / Pages / Edge)", "cdn_edge", "DETECTED", ["wrangler.toml"]),
    ("node", "gateway"): ("Nginx Reverse Proxy", "vps", "DETECTED", ["nginx.conf"]),
    ("node", "host"): ("Containerized Compute (Docker / Dedicated VPS)", "docker", "DETECTED", ["Dockerfile / docker-compose.yml"]),
    ("node", "runtime"): ("Node.js (>=20) / Bun", None, "DETECTED", ["package.json"]),
    ("node", "storage"): ("PostgreSQL + SQLite (Embedded / Local WAL) + Redis (Cache & Queues)", "managed_db", "DETECTED", ["package.json"]),
    ("node", "telemetry"): ("OpenTelemetry Distributed Tracing", None, "DETECTED", ["OpenTelemetry SDK"]),
    ("go", "runtime"): ("Golang (Compiled Native Binary)", None, "DETECTED", ["go.mod"]),
    ("go", "host"): ("Fly.io MicroVMs", "paas", "DETECTED", ["fly.toml"]),
    ("go", "storage"): ("SQLite (File-based) + PostgreSQL", "managed_db", "DETECTED", ["database/database.sqlite", "go.mod"]),
    ("broken", "runtime"): ("PHP >=8.1 (FPM / FastCGI)", None, "DETECTED", ["composer.json"]),
    ("broken", "storage"): ("Relational Database / Storage", "unspecified", "AMBIGUOUS", []),
    ("bun", "storage"): ("SQLite (Embedded / Local WAL)", "managed_db", "DETECTED", ["src/db.ts"]),
    ("prisma", "storage"): ("PostgreSQL", "managed_db", "DETECTED", ["prisma/schema.prisma"]),
    ("orm", "storage"): ("SQL Database (Prisma / Drizzle ORM)", "managed_db", "DETECTED", ["package.json"]),
    ("many", "gateway"): ("Standard Ingress / Unknown Web Server", "unspecified", "AMBIGUOUS", []),
}
SAVED = "repo string, layer string, platform string, tag string, status string, detected_from array<string>, question string"
SAVED_NODES = "repo string, id string, layer string, name string, platform string, tag string, role string, status string, detected_from array<string>, connected_to array<string>, address string, question string"


@pytest.fixture(scope="module")
def found(spark):
    rows = [(r, p, c, 7) for r, files in REPOS.items() for p, c in files.items()] + [("bare", None, "x", 7), ("bare", "README.md", "x", 7)]
    return env.layers(env.marked(spark.createDataFrame(rows, "repo string, path string, content string, marks int"))).cache()


def test_layers_of_repositories(found):
    got = {(r.repo, r.layer): (r.platform, r.tag, r.status, r.detected_from) for r in env.of_repositories(found).collect()}
    assert len(got) == 6 * len(REPOS)
    assert {k: got[k] for k in LAYERS} == LAYERS


def test_nodes(found):
    rows = env.nodes(found, env.of_repositories(found)).collect()
    bare = {r.id: (r.name, r.connected_to, r.tag) for r in rows if r.repo == "bare"}
    assert sorted(bare) == sorted(f"{layer}:primary" for layer in env.LAYERS)
    assert bare["gateway:primary"] == ("Web Ingress", ["runtime:primary"], "unspecified") and bare["runtime:primary"][1] == ["storage:primary"]
    many = {r.id: (r.name, r.role, r.status, r.detected_from, r.connected_to) for r in rows if r.repo == "many"}
    assert sorted(many) == sorted(
        ["runtime:backend", "gateway:backend", "runtime:frontend", "runtime:apps-web-shop", "gateway:apps-web-shop", "runtime:services-pay", "edge:primary", "host:primary", "storage:primary", "telemetry:primary"]
    )
    assert many["runtime:backend"] == ("BACKEND Engine", "web_api", "DETECTED", ["backend"], ["storage:primary"])
    assert many["gateway:backend"] == ("BACKEND Ingress", None, "DETECTED", [".htaccess"], ["runtime:backend"])
    assert many["runtime:apps-web-shop"] == ("APPS-WEB-SHOP Engine", "frontend_spa", "UNRESOLVED", ["apps/web-shop"], ["runtime:backend"])
    assert many["runtime:services-pay"][1] == "web_api" and many["runtime:services-pay"][4] == ["runtime:backend"]


def test_rules_across_layers(found):
    own = env.of_repositories(found)
    got = {}
    for r in env.interplays(own, env.nodes(found, own)).collect():
        got.setdefault((r.repo, r.rule), set()).add(r.id)
    assert set(r for k, r in got if k == "laravel") == {env.PROXY, env.WORKERS, env.CACHE}
    assert got["laravel", env.PROXY] == {"edge:primary", "runtime:primary"}
    assert [r for k, r in got if k in ("bare", "go")] == [] and set(r for k, r in got if k == "node") == {env.PROXY}
    assert set(r for k, r in got if k == "many") == {env.WORKERS, env.COOKIES, env.MIGRATION}
    assert got["many", env.MIGRATION] == {"runtime:backend", "runtime:services-pay"}


def test_questions_and_summary(spark, found):
    own = env.of_repositories(found)
    nodes = env.nodes(found, own)
    asked = {(r.repo, r.place) for r in env.pending(own, nodes).collect()}
    assert {p for r, p in asked if r == "bare"} == {f"{layer}:primary" for layer in env.QUESTIONS}
    # The gateway has no node among many; the runtime's question is asked by a service's node.
    assert {p for r, p in asked if r == "many"} == {"edge:primary", "host:primary", "storage:primary", "runtime:apps-web-shop", "gateway"}
    services = found.filter("unit <> ''").select("repo")
    rows = {r.repo: r for r in env.summary(own, nodes, services).collect()}
    assert (rows["bare"].distributed, rows["bare"].n_nodes, rows["bare"].n_pending) == (False, 6, 5)
    assert (rows["many"].distributed, rows["many"].n_nodes, rows["many"].overall_status) == (True, 10, "NEEDS_CLARIFICATION")
    assert rows["node"].overall_status == "RESOLVED"
    assert rows["node"].summary == (
        "Architecture Plane: [Monolithic Single-Node]. Pipeline: [Edge: Cloudflare (Workers / Pages / Edge)] ➔ [Gateway: Nginx Reverse Proxy] ➔ [Host: Containerized Compute (Docker / Dedicated VPS)] ➔ "
        "[Runtime: Node.js (>=20) / Bun] ➔ [Storage: PostgreSQL + SQLite (Embedded / Local WAL) + Redis (Cache & Queues)]. Status: RESOLVED."
    )


def test_verified_rows_stand(spark, found):
    saved = spark.createDataFrame([("bare", "edge", "Cloudflare WAF", "cdn_edge", "VERIFIED", ["Manual Test"], None), ("bare", "host", "Old", "vps", "DETECTED", [], None), ("gone", "edge", "x", "x", "VERIFIED", [], None)], SAVED)
    own = env.of_repositories(found, saved)
    got = {r.layer: r.platform for r in own.filter("repo = 'bare'").collect()}
    assert got["edge"] == "Cloudflare WAF" and got["host"] == "Virtual Server / Unknown Host" and own.filter("repo = 'gone'").isEmpty()
    workers = [("bare", f"host:worker-{i}", "host", "Worker", "Ubuntu VPS 24.04", "vps", None, "VERIFIED", [], [], a, None) for i, a in ((1, "a.example.com"), (2, "b.example.com"))]
    nodes = env.nodes(found, own, spark.createDataFrame(workers, SAVED_NODES))
    rules = {}
    for r in env.interplays(own, nodes).filter("repo = 'bare'").collect():
        rules.setdefault(r.rule, set()).add(r.id)
    hosts = {"host:primary", "host:worker-1", "host:worker-2"}
    assert rules[env.SCHEDULER] == rules[env.MIGRATION] == hosts and env.PROXY in rules and rules[env.COOKIES] == {"gateway:primary", "runtime:primary"}
    row = env.summary(own, nodes, found.filter("unit <> ''").select("repo")).filter("repo = 'bare'").first()
    assert row.distributed and row.n_nodes == 8
    keys = ["repo", "layer"]
    assert {r.layer for r in env.to_save(saved, own, keys).filter("repo = 'bare'").collect()} == {"gateway", "runtime", "storage", "telemetry"}
    assert {r.layer for r in env.to_save(saved, own, keys, refresh=True).filter("repo = 'bare'").collect()} == {"gateway", "host", "runtime", "storage", "telemetry"}


def test_empty(spark, found):
    none = env.layers(env.marked(spark.createDataFrame([], "repo string, path string, content string")))
    own = env.of_repositories(none)
    nodes = env.nodes(none, own)
    assert own.isEmpty() and nodes.isEmpty() and env.interplays(own, nodes).isEmpty() and env.summary(own, nodes, none).isEmpty()


def test_tasks_keep_with_the_number_of_repositories(spark, monkeypatch):
    monkeypatch.setattr(env, "REPOSITORIES", 2)
    found = env.layers(env.marked(spark.createDataFrame([(i, "Dockerfile", "x") for i in range(19)], "repo int, path string, content string"))).localCheckpoint()
    own = env.of_repositories(found)
    rows = env.summary(own, env.nodes(found, own), found.filter("unit <> ''").select("repo"))
    assert "Broadcast" not in rows._jdf.queryExecution().executedPlan().toString()
    assert rows.rdd.getNumPartitions() == 10 and sorted(r.repo for r in rows.collect()) == list(range(19))
