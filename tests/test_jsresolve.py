"""Manifests of JavaScript workspaces, each case a workspace of its own folder tree."""

import json

import pytest
from pyspark.sql import functions as F

from codeloom.operators.jsresolve import _alias, configs, resolve_js


def config(**options):
    extends = options.pop("extends", None)
    return json.dumps(({"extends": extends} if extends else {}) | ({"compilerOptions": options} if options else {}))


def run(spark, files, asks, **options):
    rows = [(p, c) for p, c in files.items()]
    imports = [(s, t) for s, t in asks]
    got = resolve_js(spark.createDataFrame(imports, "source string, target string"), spark.createDataFrame(rows, "path string, content string"), **options).collect()
    return {(r.source, r.target): (r.status, r.reason, r.files) for r in got}


BASE = {"configs/base.json": config(baseUrl=".", paths={"@x/*": ["lib/*"]}), "configs/lib/a.ts": "", "lib/a.ts": "", "lib/foo/util.ts": "", "other/foo/util.ts": "", "src/main.ts": "", "src/blocked/service.ts": ""}
CASES = {
    "inherited": ({"tsconfig.json": config(extends="./configs/base.json")}, "@x/a", ("resolved", ["configs/lib/a.ts"])),
    "own paths replace": ({"tsconfig.json": config(extends="./configs/base.json", paths={"@y/*": ["src/*"]})}, "@x/a", ("unresolved", [])),
    "text behind the star": ({"tsconfig.json": config(paths={"@pkg/*/util": ["lib/*/util"]})}, "@pkg/foo/util", ("resolved", ["lib/foo/util.ts"])),
    "longest text before the star": ({"tsconfig.json": config(paths={"@pkg/*": ["lib/*"], "@pkg/*/util": ["other/*/util"]})}, "@pkg/foo/util", ("resolved", ["lib/foo/util.ts"])),
    "later extends win": ({"configs/second.json": config(paths={"@y/*": ["src/*"]}), "tsconfig.json": config(extends=["./configs/base.json", "./configs/second.json"])}, "@x/a", ("unresolved", [])),
    "of a package": ({"node_modules/@config/base/package.json": '{"tsconfig": "tsconfig.json"}', "node_modules/@config/base/tsconfig.json": config(baseUrl=".", paths={"@x/*": ["lib/*"]}), "node_modules/@config/base/lib/a.ts": "", "tsconfig.json": config(extends="@config/base")}, "@x/a", ("resolved", ["node_modules/@config/base/lib/a.ts"])),
    "missing parent": ({"tsconfig.json": config(extends="./missing.json")}, "@x/a", ("unsupported", [])),
    "circle": ({"tsconfig.json": config(extends="./two.json"), "two.json": config(extends="./tsconfig.json")}, "@x/a", ("unsupported", [])),
    "malformed": ({"tsconfig.json": "{bad"}, "@/a", ("unsupported", [])),
    "comments and commas": ({"tsconfig.json": '{ // c\n "compilerOptions": { /* d */ "baseUrl": "lib", }, }'}, "a", ("resolved", ["lib/a.ts"])),
    "exact before star": ({"tsconfig.json": config(paths={"@x/*": ["lib/*"], "@x/a": ["configs/lib/a"]})}, "@x/a", ("resolved", ["configs/lib/a.ts"])),
    "next substitution": ({"tsconfig.json": config(paths={"@x/*": ["gone/*", "lib/*"]})}, "@x/a", ("resolved", ["lib/a.ts"])),
    "workspace path": ({"tsconfig.json": "{}"}, "@/blocked/service", ("resolved", ["src/blocked/service.ts"])),
}
PACKAGES = {
    "package.json": json.dumps({"workspaces": ["packages/*"], "dependencies": {"zod": "1", "@a/b": "1"}}),
    "packages/stock/package.json": json.dumps({"name": "@w/stock", "main": "src/index.ts"}),
    "packages/stock/src/index.ts": "",
    "packages/core/package.json": json.dumps({"name": "@w/core", "exports": {".": {"import": "./src/index.ts", "require": "./dist/x.cjs"}, "./utils": "./src/utils.ts", "./deep/*": "./src/*.ts", "./deep/inner/*": {"default": "./src/in/*.ts"}}}),
    "packages/core/src/index.ts": "",
    "packages/core/src/utils.ts": "",
    "packages/core/src/one.ts": "",
    "packages/core/src/in/two.ts": "",
    "packages/odd/package.json": json.dumps({"name": "odd", "exports": {".": {"node": "./n.js"}}}),
    "elsewhere/package.json": json.dumps({"name": "hidden", "main": "a.ts"}),
    "elsewhere/a.ts": "",
    "src/main.ts": "",
    "src/ambig.ts": "",
    "src/ambig.js": "",
    "src/helpers.ts": "",
    "tsconfig.json": config(baseUrl=".", paths={"@w/*": ["missing/*"]}),
}
ASKS = {
    "@w/stock": ("resolved", "workspace_package", ["packages/stock/src/index.ts"]),
    "@w/core": ("resolved", "workspace_package", ["packages/core/src/index.ts"]),
    "@w/core/utils": ("resolved", "workspace_package", ["packages/core/src/utils.ts"]),
    "@w/core/deep/one": ("resolved", "workspace_package", ["packages/core/src/one.ts"]),
    "@w/core/deep/inner/two": ("resolved", "workspace_package", ["packages/core/src/in/two.ts"]),
    "odd": ("unsupported", "conditional_package_exports", []),
    "hidden": ("unresolved", "package_not_declared", []),
    "zod": ("external", "package_manifest_dependency", []),
    "@a/b/c": ("external", "package_manifest_dependency", []),
    "unknown": ("unresolved", "package_not_declared", []),
    "node:fs": ("external", "runtime_builtin", []),
    "./helpers.js": ("resolved", "relative_path", ["src/helpers.ts"]),
    "./ambig.js": ("ambiguous", "relative_path", ["src/ambig.js", "src/ambig.ts"]),
    "./none": ("unresolved", "file_not_found", []),
    "../../../etc/passwd": ("unsupported", "outside_workspace", []),
    None: ("unresolved", "no_target", []),
}


def test_packages_and_paths(spark):
    got = run(spark, PACKAGES, [("src/main.ts", t) for t in ASKS] + [("src/main.ts", "zod")])
    assert {t: got["src/main.ts", t] for t in ASKS} == ASKS


@pytest.mark.parametrize("name", ["inherited", "own paths replace", "later extends win", "of a package", "missing parent", "circle"])
def test_effective_options(spark, name):
    """The options alone, many workspaces' worth of cases through one merge."""
    files, target, (status, _) = CASES[name]
    rows = {r.path: r for r in configs(spark.createDataFrame([(p, c) for p, c in (BASE | files).items()], "path string, content string")).collect()}
    root = rows["tsconfig.json"]
    assert (root.problem is None) == (status != "unsupported")
    assert (root.paths is not None and "@x/*" in root.paths) == (status == "resolved")
    if name == "of a package":
        assert root.base == "node_modules/@config/base"


def test_the_alias_that_fits(spark):
    paths = {"@pkg/*": ["lib/*"], "@pkg/*/util": ["other/*/util"], "@only/*/util": ["lib/*/util"], "@pkg/a": ["one", "two"], "*": ["all/*"], "a*b*c": ["x"]}
    asks = ["@pkg/foo/util", "@only/foo/util", "@pkg/a", "zod", "@only/foo", "@only//util", "abc"]
    rows = spark.createDataFrame([(i, t, paths) for i, t in enumerate(asks)], "i int, t string, p map<string,array<string>>")
    got = [(r[0].key, r[0]["values"]) for r in rows.orderBy("i").select(_alias(F.col("t"), F.col("p"))).collect()]
    assert got == [("@pkg/*", ["lib/foo/util"]), ("@only/*/util", ["lib/foo/util"]), ("@pkg/a", ["one", "two"]), ("*", ["all/zod"]), ("*", ["all/@only/foo"]), ("@only/*/util", ["lib//util"]), ("*", ["all/abc"])]


@pytest.mark.parametrize("name", ["inherited", "malformed", "comments and commas", "next substitution", "workspace path"])
def test_aliases(spark, name):
    files, target, want = CASES[name]
    status, reason, found = run(spark, BASE | files, [("src/main.ts", target)])["src/main.ts", target]
    assert (status, found) == want, reason


def test_nearest_configuration(spark):
    files = BASE | {"tsconfig.json": "{}", "src/app/tsconfig.json": config(baseUrl=".", paths={"@x/*": ["deep/*"]}), "src/app/deep/a.ts": "", "src/app/x/m.ts": ""}
    assert run(spark, files, [("src/app/x/m.ts", "@x/a")])["src/app/x/m.ts", "@x/a"][:2] == ("unsupported", "nested_tsconfig_project_selection_unknown")
    got = run(spark, files, [("src/app/x/m.ts", "@x/a"), ("src/main.ts", "@x/a")], nested="nearest")
    assert got["src/app/x/m.ts", "@x/a"] == ("resolved", "tsconfig_paths", ["src/app/deep/a.ts"]) and got["src/main.ts", "@x/a"][0] == "unresolved"
