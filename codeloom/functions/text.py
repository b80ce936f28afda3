"""Scalar functions of the catalog as native column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The archetype heuristics, tried in this order; a mark is looked for anywhere, one with ``$`` at the end.
ARCHETYPE_RULES = (
    ("controller", ("controller",)),
    ("controller", ("views.py$",)),
    ("service", ("service",)),
    ("repository", ("repo",)),
    ("model", ("model", "entities", "entity")),
    ("action", ("action",)),
    ("job", ("job", "queue")),
    ("event", ("event",)),
    ("listener", ("listener",)),
    ("middleware", ("middleware",)),
    ("request", ("request", "serializer", "schema")),
    ("resource", ("resource",)),
    ("view", (".blade.php", "views/", "templates/")),
    ("route", ("route",)),
    ("util", ("util", "helper")),
)
# The rank of a chain's stages; any other stage ranks 99.
STAGE_RANK = {"ingress": 1, "validation": 2, "controller": 3, "orchestrator": 3, "use_case": 4, "service": 4, "domain": 5, "entity": 5, "egress": 6, "repository": 6}
# Verbs that a method's name implies.
VERB_RULES = (("POST", "create|store|save|add"), ("PUT", "update|edit|patch"), ("DELETE", "delete|remove|destroy"))
# Words of a question that say nothing.
STOP_WORDS = ("ubah", "di", "dan", "yang", "the", "for", "and")
# Canonical platform tags by substring, tried in this order.
PLATFORM_RULES = (
    ("shared_hosting", ("shared", "hostinger", "cpanel", "litespeed")),
    ("docker", ("docker", "compose", "container")),
    ("kubernetes", ("k8s", "kubernetes", "helm")),
    ("vps", ("vps", "dedicated", "digitalocean", "linode", "ubuntu")),
    ("cdn_edge", ("cloudflare", "cloudfront", "fastly", "akamai")),
    ("serverless", ("vercel", "serverless", "lambda")),
    ("paas", ("fly.io", "render", "railway", "heroku")),
    ("managed_db", ("rds", "managed", "supabase", "planetscale")),
)
# The stage that a path suggests, tried in this order.
STAGE_RULES = (
    ("validation", ("validation", "dto"), "validation|middleware|dto|request|schema"),
    ("controller", ("controller",), "controller|handler"),
    ("use_case", ("service", "use_case"), "use-?cases?|interactor|application|workflow"),
    ("entity", ("model", "entity"), "domain|entities|entity|aggregate"),
    ("repository", ("repository",), "repositories|repository|database|persistence|egress|adapter"),
)
# Languages by extension, tried in this order; the last three have no extractor.
LANGUAGES = (
    ("blade", (".blade.php",)),
    ("typescript", (".ts", ".tsx", ".mts", ".cts")),
    ("javascript", (".js", ".jsx", ".mjs", ".cjs")),
    ("php", (".php",)),
    ("python", (".py",)),
    ("go", (".go",)),
    ("rust", (".rs",)),
    ("java", (".java",)),
    ("csharp", (".cs",)),
    ("ruby", (".rb",)),
    ("frontend", (".vue", ".astro", ".svelte")),
    ("kotlin", (".kt",)),
    ("scala", (".scala",)),
    ("zig", (".zig",)),
)
# Folders that hold no source; names that begin with a dot are left out as well.
IGNORED_FOLDERS = tuple("node_modules vendor bower_components jspm_packages dist build out output target obj bin scripts venv env virtualenv __pycache__ coverage opencode tmp temp".split())



def archetype(path: Column) -> Column:
    """The archetype that a path's spelling suggests; ``unknown`` when none."""
    low, out = F.lower(path), None
    for name, marks in ARCHETYPE_RULES:
        test = F.lit(False)
        for mark in marks:
            test = test | (F.endswith(low, F.lit(mark[:-1])) if mark.endswith("$") else F.contains(low, F.lit(mark)))
        if name == "controller":  # a Python file in a folder of views handles requests
            test = test | (F.contains(low, F.lit("views/")) & F.endswith(low, F.lit(".py")))
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("unknown")


def glob_regex(pattern: str, basename_fallback: bool = True) -> str:
    """A glob as a case-insensitive regular expression over whole paths.

    ``**/`` is any number of folders, ``**`` anything, ``*`` and ``?`` stay in
    one; a pattern without a slash also fits a bare file name.
    """
    out, at = "", 0
    while at < len(pattern):
        for mark, meaning in (("**/", "(?:.*/)?"), ("**", ".*"), ("*", "[^/]*"), ("?", "[^/]")):
            if pattern.startswith(mark, at):
                out += meaning
                at += len(mark)
                break
        else:
            out += re.escape(pattern[at])
            at += 1
    folder = "(?:.*/)?" if basename_fallback and "/" not in pattern else ""
    return f"(?is)^{folder}{out}\\z"


def touchpoint_regex(pattern: str) -> str:
    """A touchpoint: exact, ``p/**`` at any depth, ``p/*`` one level down, else a glob without fallback."""
    if pattern.endswith("/**"):
        return f"(?s)^{re.escape(pattern[:-3])}/.*\\z"
    if pattern.endswith("/*") and "*" not in pattern[:-1]:
        return f"(?s)^{re.escape(pattern[:-2])}/[^/]*\\z"
    return glob_regex(pattern, basename_fallback=False)


def stage_rank(stage: Column) -> Column:
    """A stage's place in a chain."""
    ranks = F.create_map(*[x for k, v in STAGE_RANK.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(ranks, stage), F.lit(99))


def http_verb(name: Column) -> Column:
    """The HTTP verb that a method name implies."""
    out = None
    for verb, words in VERB_RULES:
        test = F.lower(name).rlike(words)
        out = F.when(test, verb) if out is None else out.when(test, verb)
    return out.otherwise("GET")


def normalise_uri(uri: Column) -> Column:
    """URI with each ``{x}`` or ``:x`` as ``:param``, so that routes compare."""
    return F.regexp_replace(F.regexp_replace(uri, r"\{[^}]+\}", ":param"), r":[A-Za-z0-9_]+", ":param")


def join_uri(prefix: Column, path: Column) -> Column:
    """A route's prefix and path as one, slashes collapsed, none at the end."""
    joined = F.regexp_replace(F.concat(F.lit("/"), prefix, F.lit("/"), path), "/+", "/")
    return F.when(joined == "/", joined).otherwise(F.regexp_replace(joined, r"/\z", ""))


#: What a handler's name does to a resource: the collection itself, or one item of it.
ACTION_URI = (("store|create", ""), ("show|get|find|update|edit|patch|delete|destroy|remove", "/:id"))


def inferred_uri(path: Column, method: Column) -> Column:
    """The URI that a controller's file and method suggest: the file's name as a plural, then what the method acts on."""
    file = F.element_at(F.split(path, "/"), -1)
    base = F.lower(F.regexp_replace(F.regexp_replace(file, r"(?i)controller\.[^.]+\z", ""), r"\.[^.]+\z", ""))
    resource = F.when(base == "", "/resource").otherwise(F.concat(F.lit("/"), base, F.lit("s")))
    tail = None
    for words, end in ACTION_URI:
        does = F.lower(method).rlike(words)
        tail = F.when(does, end) if tail is None else tail.when(does, end)
    return F.concat(resource, tail.otherwise(F.concat(F.lit("/"), method)))


def tokens(text: Column, least: int = 2) -> Column:
    """Lower-case words of a camelCase or separated name, of at least ``least`` characters."""
    parted = F.regexp_replace(text, r"([a-z0-9])([A-Z])", r"$1 $2")
    return F.filter(F.split(F.lower(parted), r"[\s_\-.:/\\]+"), lambda w: F.length(w) >= least)


def query_tokens(text: Column) -> Column:
    """Words of a question, longer than two characters and no stop words."""
    parted = F.lower(F.regexp_replace(text, r"([a-z])([A-Z])", r"$1 $2"))
    return F.filter(F.split(F.regexp_replace(parted, r"[^a-z0-9_]+", " "), " "), lambda w: (F.length(w) > 2) & ~w.isin(*STOP_WORDS))


def _first(rules, test, otherwise) -> Column:
    out = None
    for name, *what in rules:
        out = F.when(test(*what), name) if out is None else out.when(test(*what), name)
    return out.otherwise(otherwise)


def _any(text: Column, marks: tuple[str, ...], how) -> Column:
    found = F.lit(False)
    for mark in marks:
        found = found | how(text, F.lit(mark))
    return found


def platform_tag(text: Column) -> Column:
    """The canonical tag of a platform's description; ``unspecified`` when none."""
    return _first(PLATFORM_RULES, lambda marks: _any(F.lower(F.coalesce(text, F.lit(""))), marks, F.contains), "unspecified")


def stage_of(path: Column, kind: Column) -> Column:
    """The stage of a file in an execution chain, by its archetype or path."""
    return _first(STAGE_RULES, lambda kinds, pattern: kind.isin(*kinds) | F.lower(path).rlike(pattern), "service")


def language(path: Column) -> Column:
    """The language of a path's extension; null when it is no source file."""
    return _first(LANGUAGES, lambda ends: _any(F.lower(path), ends, F.endswith), None)


def is_ignored(path: Column, patterns: tuple[str, ...] = ()) -> Column:
    """Whether a path is left out of the scan: by a folder's name, a dot, or a pattern."""
    clean = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^\./", "")
    parts = F.split(clean, "/")
    out = F.exists(parts, lambda p: p.isin(*IGNORED_FOLDERS) | (F.startswith(p, F.lit(".")) & ~p.isin(".", "..")))
    for raw in patterns:
        p = re.sub(r"^\./", "", raw.replace("\\", "/")).strip()
        if not p:
            continue
        if p in ("*", "**"):
            return F.lit(True)
        folder = p[:-3] if p.endswith("/**") else p[:-2] if p.endswith("/*") else p
        out = out | (clean == p) | F.startswith(clean, F.lit(folder + "/")) | F.array_contains(parts, p)
        if folder != p:
            out = out | (clean == folder)
        if p.startswith("*."):
            out = out | F.endswith(clean, F.lit(p[1:]))
    return out


def normalise_path(path: Column) -> Column:
    """A path lower-cased with ``/`` separators, without ``./``, extension or ``/index``."""
    p = F.regexp_replace(F.lower(F.replace(path, F.lit("\\"), F.lit("/"))), r"^(\./)+", "")
    return F.regexp_replace(F.regexp_replace(p, r"\.[a-z0-9]+\z", ""), r"/index\z", "")


def resolve_relative(folder: Column, target: Column) -> Column:
    """A relative import joined to its folder, ``.`` and ``..`` taken out; null when it leaves the root."""
    parts = F.filter(F.split(F.concat_ws("/", folder, target), "/"), lambda s: (s != "") & (s != "."))
    start = F.struct(F.array().cast("array<string>").alias("at"), F.lit(False).alias("out"))
    walked = F.aggregate(
        parts,
        start,
        lambda acc, s: F.when(
            s == "..", F.struct(F.slice(acc["at"], 1, F.greatest(F.size(acc["at"]) - 1, F.lit(0))).alias("at"), (acc["out"] | (F.size(acc["at"]) == 0)).alias("out"))
        ).otherwise(F.struct(F.concat(acc["at"], F.array(s)).alias("at"), acc["out"].alias("out"))),
    )
    return F.when(~walked["out"], F.array_join(walked["at"], "/"))


def name_matches(name: Column, query: str) -> Column:
    """Whether a symbol's name is asked for: separators are alike; a bare query fits the last part."""
    alike = lambda c: F.regexp_replace(c, r"->|\.|#", "::")
    wanted = re.sub(r"->|\.|#", "::", query)
    whole = F.lower(alike(name))
    if "::" in wanted:
        return (whole == wanted.lower()) | F.endswith(whole, F.lit("::" + wanted.lower()))
    return F.element_at(F.split(whole, "::"), -1) == wanted.lower()


def container(name: Column) -> Column:
    """The part of a qualified name before its last separator; null for a bare one."""
    return F.nullif(F.regexp_extract(name, r"^(.*)(?:::|->|\.|#)[^:.#>]+\z", 1), F.lit(""))


def table_name(model: Column) -> Column:
    """A model's table: snake case, English plural."""
    snake = F.lower(F.regexp_replace(model, r"([a-z0-9])([A-Z])", r"$1_$2"))
    return (
        F.when(snake.rlike(r"[^aeiou]y\z"), F.regexp_replace(snake, r"y\z", "ies"))
        .when(snake.rlike(r"(?:s|x|z|ch|sh)\z"), F.concat(snake, F.lit("es")))
        .otherwise(F.concat(snake, F.lit("s")))
    )
