"""Language, framework and kind of repositories, by the manifests they hold.

Files become marks where they lie, one shuffle by repository gathers a set of at
most as many marks as rules name, and ordered rules decide. What comes out is
what :func:`codeloom.operators.discovery.discover` asks of repositories.

A null path is no file; a null or malformed manifest names nothing, but is
there. Folders count by the files in them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Manifests of languages, and what makes a framework, each tried in this order.
LANGUAGES = (("php", ("composer.json", "artisan")), ("go", ("go.mod",)), ("python", ("pyproject.toml", "requirements.txt")), ("typescript", ("tsconfig.json", "package.json")))
NODE = (
    ("nextjs", "next"), ("nuxt", "nuxt"), ("astro", "astro"), ("vue", "vue"), ("nestjs", "@nestjs/core"), ("express", "express"),
    ("fastify", "fastify"), ("hono", "hono"), ("elysia", "elysia"), ("mcp-server", "@modelcontextprotocol/sdk"),
)
FRAMEWORKS = {
    "php": (("laravel", ("file:artisan",)), ("symfony", ("file:bin/console", "file:symfony.lock", "composer:symfony/framework-bundle", "composer:symfony/symfony"))),
    "typescript": tuple((name, (f"npm:{package}",)) for name, package in NODE),
    "python": (("django", ("file:manage.py", "file:wsgi.py", "file:asgi.py")), ("fastapi", ("python:fastapi",)), ("django", ("python:django",)), ("flask", ("python:flask",))),
    "go": (("gin", ("go:github.com/gin-gonic/gin",)), ("echo", ("go:github.com/labstack/echo",)), ("chi", ("go:github.com/go-chi/chi",)), ("fiber", ("go:github.com/gofiber/fiber",))),
}
PLAIN = {"php": "generic-php", "typescript": "generic-node", "python": "generic-python", "go": "generic-go"}
WORKSPACES = ("pnpm-workspace.yaml", "lerna.json", "turbo.json", "nx.json")
PYTHON = ("requirements.txt", "pyproject.toml", "Pipfile")
FOLDERS = ("apps", "packages", "libs", "resources/js", "resources/views")
FULLSTACK, FRONTEND, BACKEND, TOOLS = ("nextjs", "nuxt", "astro"), ("vue", "react"), ("nestjs", "express", "fastify"), ("mcp-server", "cli")

_MARKS = [m for rules in FRAMEWORKS.values() for _, marks in rules for m in marks]
_FILES = tuple(dict.fromkeys([*(m for _, ms in LANGUAGES for m in ms), *(m.removeprefix("file:") for m in _MARKS if m.startswith("file:")), *WORKSPACES, *PYTHON]))
_JSON = "dependencies map<string,string>, devDependencies map<string,string>, require map<string,string>, `require-dev` map<string,string>"


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def _has(*marks: str) -> Column:
    return F.arrays_overlap("marks", _strings(marks))


def _marks() -> Column:
    path, text = F.col("path"), F.coalesce("content", F.lit(""))
    named = lambda kind: [m.removeprefix(kind) for m in _MARKS if m.startswith(kind)]
    when = lambda test, marks: F.when(test, marks).otherwise(_strings(()))

    def holding(kind: str) -> Column:
        return F.transform(F.filter(_strings(named(kind)), lambda n: F.contains(F.lower(text), n)), lambda n: F.concat(F.lit(kind), n))

    def listed(kind: str, own: str, dev: str) -> Column:
        """Names that a manifest gives a version; of both its maps the second has the last word."""
        a, b = F.col(f"json.{own}"), F.col(f"json.`{dev}`")
        return F.transform(F.filter(_strings(named(kind)), lambda n: F.coalesce(b[n], a[n], F.lit("")) != ""), lambda n: F.concat(F.lit(kind), n))

    spaces = F.coalesce(F.try_element_at(F.from_json(F.get_json_object(text, "$.workspaces"), "array<string>"), F.lit(1)).isNotNull(), F.lit(False))
    return F.concat(
        when(path.isin(*_FILES), F.array(F.concat(F.lit("file:"), path))),
        F.transform(F.filter(_strings(FOLDERS), lambda f: path.startswith(F.concat(f, F.lit("/")))), lambda f: F.concat(F.lit("folder:"), f)),
        when(path.isin(*PYTHON), holding("python:")),
        when(path == "go.mod", holding("go:")),
        when(path == "package.json", listed("npm:", "dependencies", "devDependencies")),
        when((path == "package.json") & spaces, _strings(["workspaces"])),
        when(path == "composer.json", listed("composer:", "require", "require-dev")),
    )


def classify(files: DataFrame) -> DataFrame:
    """(repo, language, framework, is_monorepo, project_type) of each repository of (repo, path, content)."""
    read = files.filter("path is not null").select("repo", "path", F.when(F.col("path").isin(*_FILES), F.col("content")).alias("content"))
    read = read.withColumn("json", F.when(F.col("path").isin("package.json", "composer.json"), F.from_json("content", _JSON)))
    met = read.select("repo", _marks().alias("marks")).groupBy("repo").agg(F.array_distinct(F.flatten(F.collect_set(F.when(F.size("marks") > 0, F.col("marks"))))).alias("marks"))
    language = reduce(lambda rest, rule: F.when(_has(*(f"file:{m}" for m in rule[1])), rule[0]).otherwise(rest), reversed(LANGUAGES), F.lit("generic"))
    met = met.withColumn("language", language)

    def framework(name: str) -> Column:
        return reduce(lambda rest, rule: F.when(_has(*rule[1]), rule[0]).otherwise(rest), reversed(FRAMEWORKS[name]), F.lit(PLAIN[name]))

    of = reduce(lambda rest, name: F.when(F.col("language") == name, framework(name)).otherwise(rest), FRAMEWORKS, F.lit("generic"))
    mono = _has(*(f"file:{w}" for w in WORKSPACES), "workspaces") | (_has("folder:apps") & _has("folder:packages", "folder:libs"))
    met = met.withColumn("framework", of).withColumn("is_monorepo", mono)
    made = F.col("framework")
    kind = (
        F.when(F.col("is_monorepo"), "monorepo")
        .when(made.isin(*TOOLS), "cli-mcp")
        .when(made.isin(*FULLSTACK) | ((made == "laravel") & _has("folder:resources/js", "folder:resources/views")), "fullstack")
        .when(made.isin(*FRONTEND), "frontend")
        .when(made.isin(*BACKEND) | F.col("language").isin("go", "python", "php"), "backend")
        .otherwise("generic")
    )
    return met.select("repo", "language", "framework", "is_monorepo", kind.alias("project_type"))
