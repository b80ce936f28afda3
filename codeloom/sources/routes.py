"""Routes of web frameworks as facts of source lines: one row per route, with its handler and middlewares.

Frameworks of JavaScript and PHP are read from nested scopes, by
:mod:`codeloom.sources.braceroutes`; the others are a table of patterns with
named groups, read in one Arrow pass. Prefixes of routers, plugins, blueprints,
groups and classes are facts as well (mounts), and
:func:`codeloom.operators.graph.prefixes` carries them to the routes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.masking import mask
from codeloom.functions.text import join_uri
from codeloom.operators.graph import prefixes
from codeloom.operators.resolve import Rules, resolve
from codeloom.plans.shared import materialize
from codeloom.sources.braceroutes import brace_facts

_VERBS = "get|post|put|patch|delete|options|head"
_Q = r"['\"`](?P<uri>[^'\"`\n]*)['\"`]"
# How each framework writes a route; ``router`` is what it hangs on.
ROUTES = {
    "fastapi": (("python",), rf"^[ \t]*@(?P<router>\w+)\.(?P<verb>{_VERBS})\(\s*{_Q}[^\n]*\n(?:[ \t]*@[^\n]*\n)*[ \t]*(?:async\s+)?def\s+(?P<handler>\w+)"),
    "flask": (("python",), rf"^[ \t]*@(?P<router>\w+)\.route\(\s*{_Q}(?P<args>[^\n]*)\n(?:[ \t]*@[^\n]*\n)*[ \t]*(?:async\s+)?def\s+(?P<handler>\w+)"),
    "django": (("python",), r"\b(?:path|re_path|url)\(\s*r?['\"](?P<uri>[^'\"\n]*)['\"]\s*,\s*(?!include)(?P<handler>[\w.]+)"),
    "nestjs": (("typescript",), rf"@(?P<verb>(?i:{_VERBS}))\(\s*(?:['\"`](?P<uri>[^'\"`\n]*)['\"`])?\s*\)\s*(?:@[^\n]*\s*)*(?:public\s+)?(?:async\s+)?(?P<handler>\w+)\s*\("),
    "go": (("go",), r"\b(?P<router>\w+)\.(?P<verb>GET|POST|PUT|PATCH|DELETE|Get|Post|Put|Patch|Delete|HandleFunc)\(\s*\"(?P<uri>[^\"\n]*)\"\s*,\s*(?P<rest>[^\n]*)\)"),
}
# How routers are mounted below one another: parent, child and path.
MOUNTS = {
    "fastapi": (("python",), r"\b(?P<parent>\w+)\.include_router\(\s*(?P<child>[\w.]+)(?:[^)\n]*prefix\s*=\s*['\"](?P<path>[^'\"\n]*)['\"])?"),
    "flask": (("python",), r"\b(?P<parent>\w+)\.register_blueprint\(\s*(?P<child>[\w.]+)(?:[^)\n]*url_prefix\s*=\s*['\"](?P<path>[^'\"\n]*)['\"])?"),
    "go": (("go",), r"\b(?P<child>\w+)\s*:?=\s*(?P<parent>\w+)\.(?:Group|Route)\(\s*\"(?P<path>[^\"\n]*)\""),
}
# A URL configuration that includes a module's, or a router's; and a router's view sets, with the routes of each.
INCLUDE = r"\b(?:path|re_path|url)\(\s*r?['\"](?P<path>[^'\"\n]*)['\"]\s*,\s*include\(\s*\(?\s*(?:['\"](?P<module>[\w.]+)['\"]|(?P<router>\w+)(?:\.urls)?)"
VIEWSET = r"\b(?P<router>\w+)\.register\(\s*r?['\"](?P<uri>[^'\"\n]*)['\"]\s*,\s*(?:\w+\.)*(?P<cls>\w+)"
VIEWS = (("GET", "", "list"), ("POST", "", "create"), ("GET", "/{id}", "retrieve"), ("PUT", "/{id}", "update"), ("PATCH", "/{id}", "partial_update"), ("DELETE", "/{id}", "destroy"))
URLCONF = "urlpatterns"
# A router's own prefix, where it is made.
OWN_PREFIX = {"python": r"\b(?P<router>\w+)\s*=\s*(?:APIRouter|Blueprint)\([^)\n]*?(?:url_)?prefix\s*=\s*['\"](?P<path>[^'\"\n]*)['\"]"}
#: What a file brings in: a module's own value, or names of it, each perhaps under another name.
IMPORTS = {
    "js": r"\bimport\s+(?P<own>\w+)?\s*,?\s*(?:\{(?P<names>[^}]*)\})?\s*from\s*['\"](?P<module>[^'\"]+)['\"]|\b(?:const|let|var)\s+(?:(?P<own2>\w+)|\{(?P<names2>[^}]*)\})\s*=\s*require\(\s*['\"](?P<module2>[^'\"]+)['\"]\s*\)",
    "python": r"^[ \t]*from\s+(?P<module>[.\w]+)\s+import\s+(?:\((?P<names2>[^)]*)\)|(?P<names>[\w ,\t]+))",
}
SCHEMA = "path string, framework string, kind string, http_method string, uri string, router string, parent string, handler string, middlewares array<string>, line int"


def _words(rest: str) -> list[str]:
    parts = [re.sub(r"\(.*", "", p).strip() for p in re.split(r",(?![^(\[]*[)\]])", rest.rstrip(" );"))]
    return [p for p in parts if re.fullmatch(r"[\w.$]+", p)]


def imports_of(language: str, source: str) -> Iterator[tuple[str, str, str]]:
    """Names that a source brings in: the name here, the module, and the name there (empty for the module itself)."""
    kind = "python" if language == "python" else "js" if language in ("typescript", "javascript") else None
    for m in re.finditer(IMPORTS[kind], source, re.M) if kind else ():
        g = m.groupdict()
        module = g.get("module") or g.get("module2")
        if own := g.get("own") or g.get("own2"):
            yield own, module, ""
        for part in re.split(r"[,\n]", g.get("names") or g.get("names2") or ""):
            words = part.replace(":", " as ").split()
            if words:
                yield words[-1], module, words[0]
                if kind == "python":  # the name may be a module of the package
                    yield words[-1], module + ("" if module.endswith(".") else ".") + words[0], ""


def facts_of(path: str, language: str, source: str) -> Iterator[tuple]:
    """Routes, mounts and router prefixes of one file."""
    blank = mask(source, ("#",) if language == "python" else ("//", "/*"))
    line = lambda at: blank.count("\n", 0, at) + 1
    for framework, (languages, pattern) in ROUTES.items():
        if language not in languages:
            continue
        for m in re.finditer(pattern, blank, re.M):
            g = m.groupdict()
            verbs = [(g.get("verb") or "GET").upper()]
            if named := re.search(r"methods\s*[=:]\s*[\[{(]([^\])}]*)", g.get("args") or ""):
                verbs = re.findall(r"\w+", named[1].upper())
            chain = _words(g.get("rest") or "")
            handler = g.get("handler") or (chain[-1] if chain else "")
            prefix = ""
            if framework == "nestjs":
                above = list(re.finditer(r"@Controller\(\s*(?:['\"`]([^'\"`\n]*)['\"`])?", blank[: m.start()]))
                if not above:
                    continue
                prefix = above[-1][1] or ""
            router = URLCONF if framework == "django" else g.get("router") or ""
            for verb in verbs:
                yield path, framework, "route", {"ANY": "GET", "HANDLEFUNC": "GET"}.get(verb, verb), f"{prefix}/{g.get('uri') or ''}" if prefix else g.get("uri") or "", router, None, handler, chain[:-1], line(m.start())
    for m in re.finditer(INCLUDE, blank) if language == "python" else ():
        # A module's configuration is its ``urlpatterns``, imported under a name of its own.
        child = m["router"] or f"include:{m['module'].replace('.', '/')}"
        yield path, "django", "mount", None, m["path"].removeprefix("^"), child, URLCONF, None, [], line(m.start())
        if m["module"]:
            yield path, language, "import", None, m["module"], child, None, URLCONF, [], 0
    for m in re.finditer(VIEWSET, blank) if language == "python" else ():
        for verb, suffix, action in VIEWS:
            yield path, "django", "route", verb, m["uri"] + suffix, m["router"], None, f"{m['cls']}@{action}", [], line(m.start())
    for framework, (languages, pattern) in MOUNTS.items():
        for m in re.finditer(pattern, blank, re.M) if language in languages else ():
            yield path, framework, "mount", None, m["path"] or "", m["child"], m["parent"], None, [], line(m.start())
    for here, module, there in imports_of(language, blank):
        yield path, language, "import", None, module, here, None, there, [], 0
    for m in re.finditer(OWN_PREFIX.get(language, r"(?!)"), blank):
        yield path, "python", "prefix", None, m["path"], m["router"], None, None, [], line(m.start())


def route_facts(files: DataFrame) -> DataFrame:
    """Facts of every row of (path, language, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for batch in batches:
            rows = [f for p, g, c in zip(batch["path"], batch["language"], batch["content"], strict=True) if c and g for f in facts_of(p, g, c)]
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "language", "content").mapInPandas(run, SCHEMA)


def _mounts(facts: DataFrame, files: DataFrame, routers: DataFrame) -> DataFrame:
    """parent_key, child_key, uri of every mount: the child is the router that the file imports under its name, else its own, else the only one of that name."""
    mounts = facts.filter("kind = 'mount'").select("path", "parent", "uri", F.col("router").alias("child"), F.split("router", r"\.").alias("parts")).distinct()
    mounts = mounts.select("path", "parent", "uri", "child", F.col("parts")[0].alias("here"), F.get("parts", F.lit(1)).alias("attr"))
    brought = facts.filter("kind = 'import'").select(F.col("path").alias("source"), F.col("framework").alias("language"), F.col("uri").alias("target"), F.col("router").alias("here"), F.col("handler").alias("there")).distinct()
    resolved = resolve(brought, files, Rules()).filter("status = 'resolved'").select(F.col("source").alias("path"), "language", "here", "there", F.col("files")[0].alias("file"))
    only = routers.groupBy(F.col("path").alias("file")).agg(F.min("router").alias("only"), F.count("*").alias("n")).filter("n = 1").select("file", "only")
    # A module's own value is what it exports as its default.
    known = routers.select(F.col("path").alias("file"), F.col("router").alias("wanted"), F.col("router").alias("means"))
    aliases = facts.filter("kind = 'alias'").select(F.col("path").alias("file"), F.lit("default").alias("wanted"), F.col("router").alias("means"))
    known = known.unionByName(aliases).groupBy("file", "wanted").agg(F.min("means").alias("means"))
    wanted = F.coalesce("attr", F.nullif("there", F.lit("")), F.when(F.col("language") != "python", "default"), "child")
    imported = mounts.join(resolved, ["path", "here"]).withColumn("wanted", wanted).join(known, ["file", "wanted"], "left").join(only, "file", "left")
    imported = imported.withColumn("means", F.coalesce("means", "only")).filter("means is not null").select("path", "child", F.concat_ws("#", "file", "means").alias("k"))
    imported = imported.groupBy("path", "child").agg(F.min("k").alias("by_import"))
    own = routers.select("path", F.col("router").alias("child"), F.concat_ws("#", "path", "router").alias("by_file"))
    alone = routers.groupBy(F.col("router").alias("child")).agg(F.min(F.concat_ws("#", "path", "router")).alias("by_name"), F.count("*").alias("n")).filter("n = 1").drop("n")
    found = mounts.join(imported, ["path", "child"], "left").join(own, ["path", "child"], "left").join(alone, "child", "left")
    key = F.coalesce("by_import", "by_file", "by_name")
    return found.filter(key.isNotNull()).select(F.concat_ws("#", "path", "parent").alias("parent"), key.alias("child"), "uri")


def routes(files: DataFrame, rounds: int = 10) -> DataFrame:
    """Routes with their whole URIs: http_method, route_uri, handler, framework, path, line, middlewares.

    A router is one of a file and a name. Prefixes go from routers that nobody
    mounts down the mounts, for at most ``rounds`` levels.
    """
    facts = materialize(route_facts(files).unionByName(brace_facts(files)), "routes")
    made = facts.filter("kind in ('route', 'prefix')").select("path", "router")
    parents = facts.filter("kind = 'mount'").select("path", F.col("parent").alias("router"))
    # A group of a router is a router of its file.
    groups = facts.filter("kind = 'mount' and framework = 'go'").select("path", "router")
    routers = made.unionByName(parents).unionByName(groups).filter("router <> ''").distinct()
    mounts = materialize(_mounts(facts, files, routers), "mounts")
    keyed = F.concat_ws("#", "path", "router")
    own = facts.filter("kind = 'prefix'").groupBy(keyed.alias("router")).agg(F.min("uri").alias("own"))
    tops = routers.select(keyed.alias("router")).join(mounts.select(F.col("child").alias("router")), "router", "left_anti")
    below = mounts.join(own.withColumnRenamed("router", "child"), "child", "left").select("parent", "child", F.concat_ws("/", "uri", "own").alias("path"))
    tops = tops.join(own, "router", "left").select("router", F.coalesce("own", F.lit("")).alias("prefix"))
    reached = prefixes(below, tops, rounds).withColumnRenamed("router", "router_key")
    rows = facts.filter("kind = 'route'").withColumn("router_key", keyed).join(reached, "router_key", "left")
    uri = join_uri(F.coalesce("prefix", F.lit("")), F.regexp_replace(F.regexp_replace("uri", r"^\^", ""), r"\$\z", ""))
    return rows.select("http_method", uri.alias("route_uri"), "handler", "framework", "path", "line", "middlewares").distinct()


def chains(found: DataFrame) -> DataFrame:
    """Each route's chain: ingress, its middlewares as validation, its controller."""
    node = lambda stage, symbol: F.struct(F.lit(stage).alias("stage"), symbol.alias("symbol"))
    start = F.array(node("ingress", F.concat_ws(" ", "http_method", "route_uri")))
    middle = F.transform("middlewares", lambda m: F.struct(F.lit("validation").alias("stage"), m.alias("symbol")))
    return found.withColumn("chain", F.concat(start, middle, F.array(node("controller", F.col("handler")))))
