"""Language, framework and kind of repositories."""

from codeloom.operators.projects import classify

REPOS = {
    "laravel": ({"artisan": "", "composer.json": "{}", "resources/js/app.js": "", "package.json": '{"dependencies": {"next": "1"}}'}, ("php", "laravel", False, "fullstack")),
    "api": ({"artisan": ""}, ("php", "laravel", False, "backend")),
    "symfony": ({"composer.json": '{"require-dev": {"symfony/symfony": "6"}}', "go.mod": ""}, ("php", "symfony", False, "backend")),
    "php": ({"composer.json": "{broken"}, ("php", "generic-php", False, "backend")),
    "gin": ({"go.mod": "require GitHub.com/gin-gonic/gin v1", "requirements.txt": "flask"}, ("go", "gin", False, "backend")),
    "django": ({"pyproject.toml": "fastapi", "manage.py": ""}, ("python", "django", False, "backend")),
    "fastapi": ({"requirements.txt": "Flask", "Pipfile": "FastAPI"}, ("python", "fastapi", False, "backend")),
    "next": ({"package.json": '{"dependencies": {"vue": "3"}, "devDependencies": {"next": "15"}}'}, ("typescript", "nextjs", False, "fullstack")),
    "undone": ({"package.json": '{"dependencies": {"next": "3", "express": "4"}, "devDependencies": {"next": ""}}'}, ("typescript", "express", False, "backend")),
    "vue": ({"package.json": '{"dependencies": {"vue": "3"}}'}, ("typescript", "vue", False, "frontend")),
    "tool": ({"package.json": '{"dependencies": {"@modelcontextprotocol/sdk": "1"}, "workspaces": []}'}, ("typescript", "mcp-server", False, "cli-mcp")),
    "node": ({"tsconfig.json": None, "apps/a.ts": "", "src/package.json": '{"dependencies": {"vue": "3"}}'}, ("typescript", "generic-node", False, "generic")),
    "spaces": ({"package.json": '{"workspaces": ["a/*"]}'}, ("typescript", "generic-node", True, "monorepo")),
    "folders": ({"apps/a.ts": "", "libs/b.ts": ""}, ("generic", "generic", True, "monorepo")),
    "turbo": ({"turbo.json": "", "go.mod": "x"}, ("go", "generic-go", True, "monorepo")),
    "none": ({"README.md": None}, ("generic", "generic", False, "generic")),
}


def test_repositories(spark):
    rows = [(r, p, c, [1]) for r, (files, _) in REPOS.items() for p, c in files.items()] + [("none", None, "x", None), ("vue", "package.json", REPOS["vue"][0]["package.json"], None)]
    got = {r.repo: (r.language, r.framework, r.is_monorepo, r.project_type) for r in classify(spark.createDataFrame(rows, "repo string, path string, content string, marks array<int>")).collect()}
    assert got == {r: want for r, (_, want) in REPOS.items()}


def test_empty(spark):
    assert classify(spark.createDataFrame([], "repo string, path string, content string")).isEmpty()
