"""Domains of repositories of every tier, all discovered together."""

import pytest

from codeloom.operators import discovery

REPOS = {
    "mono": ("typescript", "react", True, ["apps/Web/a.ts", "apps/api/b.ts", "packages/web/c.ts", "libs/util/x.md", "package.json"]),
    "ddd": ("php", "laravel", False, ["app/Domain/Billing/a.php", "app/Domain/Orders/b.php", "app/Domain/docs/readme.md", "app/kernel.php", "domains/Billing/x.php"]),
    "layers": ("typescript", "mcp-server", False, ["src/core/a.ts", "src/cli/b.ts", "src/types/c.ts", "src/util/d.ts", "src/index.ts", "src/docs/readme.md", "lib/x.ts"]),
    "flat": ("python", None, False, ["src/main.py", "app/deep/x.py"]),
    "laravel": ("php", "laravel", False, ["app/readme.md", "routes/web.php", "resources/views/a.blade.php", "database/x.php"]),
    "go": ("go", None, False, ["pkg/a.go", "internal/Store/a.go", "internal/http/b.go", "cmd/server/main.go", "cmd/tool/main.go", "go.mod"]),
    "cmd": ("go", None, False, ["internal/a.go", "cmd/main.go"]),
    "tops": ("python", None, False, ["Shop/a.py", "bank/deep/b.py", "docs/x.md", "run.py"]),
    "empty": ("python", None, False, ["docs/x.md"]),
}
WANT = {
    "mono": {"apps-web": ("apps/Web", ["packages-web", "util"], []), "api": ("apps/api", ["packages-web", "util"], []), "packages-web": ("packages/web", [], ["api", "apps-web"]), "util": ("libs/util", [], ["api", "apps-web"])},
    "ddd": {"billing": ("domains/Billing", ["common", "root", "shared"], []), "orders": ("app/Domain/Orders", ["common", "root", "shared"], []), "root": ("app", ["billing", "orders"], [])},
    "layers": {"core": ("src/core", ["types"], ["cli"]), "cli": ("src/cli", ["core", "types"], []), "types": ("src/types", [], ["cli", "core"]), "util": ("src/util", ["core", "types"], []), "root": ("src", ["cli", "core", "types", "util"], [])},
    "flat": {"app": ("src", [], [])},
    "laravel": {"app": ("app", [], []), "routes": ("routes", [], []), "views": ("resources/views", [], []), "database": ("database", [], [])},
    "go": {"pkg": ("pkg", [], ["cmd", "internal"]), "store": ("internal/Store", ["pkg"], ["cmd"]), "http": ("internal/http", ["pkg"], ["cmd"]), "cmd-server": ("cmd/server", ["http", "pkg", "store"], []), "cmd-tool": ("cmd/tool", ["cmd-server", "http", "pkg", "store"], [])},
    "cmd": {"internal": ("internal", [], ["cmd"]), "cmd": ("cmd", ["internal"], [])},
    "tops": {"shop": ("Shop", [], []), "bank": ("bank", [], []), "root": (".", ["bank", "shop"], [])},
    "empty": {},
}
STYLES = {"mono": "monorepo-workspaces", "ddd": "modular-ddd", "layers": "cli-adapter", "flat": "layered-monolith", "laravel": "layered-monolith", "go": "clean-architecture", "cmd": "clean-architecture", "tops": "generic"}


@pytest.fixture(scope="module")
def tables(spark):
    files = [(r, p, not p.endswith((".md", ".json", ".mod"))) for r, (*_, paths) in REPOS.items() for p in paths]
    repos = [(r, *facts[:3]) for r, facts in REPOS.items()]
    return spark.createDataFrame(files, "repo string, path string, is_source boolean"), spark.createDataFrame(repos, "repo string, language string, framework string, is_monorepo boolean")


def test_every_tier(tables):
    found = {}
    for r in discovery.discover(*tables).collect():
        assert r.style == STYLES[r.repo] and r.name not in found.setdefault(r.repo, {})
        found[r.repo][r.name] = (r.root, r.allowed, r.forbidden)
    assert found == {r: d for r, d in WANT.items() if d}


def test_archetypes(spark, tables):
    files = spark.createDataFrame([("a", p, True) for p in ("src/core/Http/x.ts", "src/core/.cache/y.ts", "src/flat/z.ts", "top.ts")], "repo string, path string, is_source boolean")
    domains = spark.createDataFrame([("a", "core", "src/core"), ("a", "flat", "src/flat"), ("a", "root", ".")], "repo string, name string, root string")
    got = {(r.name, r.archetype, r.pattern) for r in discovery.archetypes(discovery.folders(files), domains).collect()}
    assert got == {("core", "http", "Http/**"), ("flat", "source", "**/*.*"), ("root", "src", "src/**")}


def test_nothing(tables):
    files, repos = tables
    assert discovery.discover(files.limit(0), repos.limit(0)).collect() == []
