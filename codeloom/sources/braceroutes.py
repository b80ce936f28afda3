"""Routes of JavaScript and PHP frameworks as facts of nested scopes.

Plugins, groups, router variables and classes are scopes: a route belongs to
the innermost scope that binds its receiver, a mount carries a prefix from the
scope it stands in to the scope it names. Facts have the columns of
:data:`codeloom.sources.routes.SCHEMA`; prefixes are carried there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.plans.shared import materialize
from codeloom.sources import scopes

# Verbs of routes, calls that mount, and the actions of a resource route as (verb, suffix, action).
VERBS = ("get", "post", "put", "patch", "delete", "options", "head", "all", "any")
MOUNTS = ("use", "register", "route", "group", "mount")
RESOURCE = (("GET", "", "index"), ("POST", "", "store"), ("GET", "/{id}", "show"), ("PUT", "/{id}", "update"), ("DELETE", "/{id}", "destroy"), ("GET", "/create", "create"), ("GET", "/{id}/edit", "edit"))
# Option keys that name hooks of a route.
HOOKS = ("preHandler", "onRequest", "preValidation", "beforeHandle", "middleware")
#: A receiver that serves, and one that asks another server.
SERVES, ASKS = r"(?i)app|router|server|api|fastify|route|elysia|hono", r"(?i)client|axios|fetch|agent|request|http"
#: Sources without any of these hold no route.
HINTS = (".get(", ".post(", ".put(", ".patch(", ".delete(", ".options(", ".head(", ".all(", ".get<", ".post<", ".put<", ".patch<", ".delete<", ".route(", ".register(", ".use(", ".group(", "Route", "basePath(", "Elysia(")


def _last(word: Column, mark: str = r"\\") -> Column:
    return F.element_at(F.split(word, mark), -1)


def _named_scopes(found: DataFrame, called: DataFrame, args: DataFrame) -> DataFrame:
    """Scopes that a name or a mount reaches: path, key, start, end."""
    token = F.col("token")
    declared = found.filter((token == "function") & scopes.is_word(F.col("next1")) & (F.col("next2") == "(") & F.col("body").isNotNull())
    functions = declared.select("path", F.col("next1").alias("key"), F.col("at").alias("start"), F.col("body.end").alias("end"))
    exported = found.filter((token == "default") & (F.col("prev1") == "export") & F.array_contains(F.array("next1", "next2"), "function") & F.col("body").isNotNull())
    named = F.when((F.col("next1") == "function") & (F.col("next2") != "("), F.col("next2")).when((F.col("next1") == "async") & (F.col("next3") != "("), F.col("next3")).otherwise("default")
    defaults = exported.select("path", named.alias("key"), F.col("at").alias("start"), F.col("body.end").alias("end"))
    # A declared name reaches to the end of its statement; only those with a function inside bind anything.
    values = found.filter(token.isin("const", "let", "var") & scopes.is_word(F.col("next1")) & F.col("next2").isin("=", ":"))
    values = values.select("path", F.col("next1").alias("key"), F.col("at").alias("start"), F.coalesce("stop", F.lit(scopes.END)).alias("end"))
    inline = called.filter(F.col("method").isin(*MOUNTS)).join(args.filter("kind = 'function'"), ["path", "open"]).select("path", F.concat(F.lit("@"), F.col("start").cast("string")).alias("key"), (F.col("start") - 1).alias("start"), (F.col("stop") + 1).alias("end"))
    return functions.unionByName(defaults).unionByName(values).unionByName(inline).distinct()


def _bound(found: DataFrame, named: DataFrame) -> DataFrame:
    """Parameters of functions by the named scope they belong to: path, name, key, start, end."""
    token = F.col("token")
    heads = found.filter((token == "(") & F.col("end").isNotNull()).select("path", F.col("at").alias("parent"), F.col("end").alias("shut"))
    behind = found.filter((token == ")") & F.col("next1").isin("=>", "{", ":")).select("path", F.col("at").alias("shut"))
    params = found.filter(scopes.is_word(token) & F.col("prev1").isin("(", ",")).select("path", "parent", "at", "token").join(heads.join(behind, ["path", "shut"]), ["path", "parent"]).select("path", "at", F.col("token").alias("name"))
    bare = found.filter(scopes.is_word(token) & (F.col("next1") == "=>")).select("path", "at", F.col("token").alias("name"))
    return scopes.innermost(params.unionByName(bare).distinct(), named, ["path"], "at", ["key", "end"]).filter("key is not null").select("path", "name", "key", F.col("at").alias("start"), "end")


def _receivers(called: DataFrame, bound: DataFrame) -> DataFrame:
    """Adds ``router``: the scope that binds the receiver of a call's chain, else the variable itself, and ``is_bound``."""
    root = F.col("root.token")
    made = F.col("root.prev1") == "new"
    plain = F.regexp_extract(F.regexp_replace(root, r"<.*", ""), r"^(.*?)(?:(?:\.|\?\.)[$\w]+)?\z", 1)
    variable = F.when(made & (F.col("root.prev2") == "="), F.col("root.prev3")).when(made, "default").otherwise(plain)
    rows = called.withColumn("name_of", variable).withColumn("made", made)
    found = scopes.innermost(rows, bound.select("path", F.col("name").alias("name_of"), "key", "start", "end"), ["path", "name_of"], "at", ["key"])
    return found.withColumn("is_bound", F.col("key").isNotNull()).withColumn("router", F.coalesce("key", "name_of")).drop("key")


def _js(found: DataFrame, files: DataFrame) -> DataFrame:
    own = found.filter("language <> 'php'")
    called = scopes.calls(own)
    # ``new X(..)`` keeps its arguments, ``.get`` and the like their own.
    wanted = called.filter(F.col("method").isin(*VERBS, *MOUNTS, "basePath", "Elysia", "Hono", "addSchema"))
    args = materialize(scopes.arguments(own, wanted), "arguments")
    props = scopes.properties(own)
    options = args.filter("kind = 'object'").select("path", "open", "arg", F.col("start").alias("object")).join(props, ["path", "object"]).select("path", "open", "arg", "key", "value", "mark_at")
    by_key = options.groupBy("path", "open").agg(*[F.min(F.when(F.col("key") == k, F.col("value"))).alias(f"o_{k}") for k in ("prefix", "url", "path", "handler", "method")], F.min(F.when(F.col("key") == "method", F.col("mark_at") + 1)).alias("methods_at"))
    by_key = by_key.withColumnRenamed("o_path", "o_uri")
    # Words of arrays among options and arguments: methods, hooks.
    named = _named_scopes(own, wanted, args)
    bound = _bound(own, named)
    words = own.filter(scopes.is_word(F.col("token")) | scopes.is_string(F.col("token"))).select("path", F.col("parent").alias("list_at"), "at", F.coalesce(scopes.unquoted(F.col("token")), F.col("token")).alias("word"))
    hooks = options.filter(F.col("key").isin(*HOOKS)).select("path", "open", "arg", (F.col("mark_at") + 1).alias("list_at"), "value")
    hook_words = hooks.filter(scopes.is_word(F.col("value"))).select("path", "open", "arg", F.col("list_at").alias("at"), F.col("value").alias("word")).unionByName(hooks.filter("value = '['").join(words, ["path", "list_at"]).select("path", "open", "arg", "at", "word"))
    listed = args.filter("kind = 'array'").select("path", "open", "arg", F.col("start").alias("list_at")).join(words, ["path", "list_at"]).select("path", "open", "arg", "at", "word")
    simple = args.filter(F.col("kind").isin("name", "call") & ~F.col("word").isin("async", "function")).select("path", "open", "arg", F.col("start").alias("at"), "word")
    takes = args.groupBy("path", "open").agg(F.max("arg").alias("last"), F.max(F.when(F.col("kind").isin("name", "call", "function"), F.col("arg"))).alias("handled"), F.min(F.when(F.col("arg") == 0, F.struct("kind", "first", "word"))).alias("a0"), F.count("*").alias("n"), F.max(F.when(F.col("kind") == "function", F.struct("arg", "start"))).alias("inline"))
    rows = _receivers(wanted, bound).join(takes, ["path", "open"], "left").join(by_key, ["path", "open"], "left")
    rows = materialize(rows, "brace-calls")
    text = lambda c: scopes.unquoted(F.col(c))
    a0 = scopes.unquoted(F.col("a0.first"))
    serves = F.when(F.col("is_bound"), a0.rlike(r"^(?:[/*:]|\z)") | F.col("name_of").rlike(SERVES)).otherwise((F.col("name_of").rlike(SERVES) | F.col("made") | F.col("is_made")) & (~F.col("name_of").rlike(ASKS) | F.col("is_made")))
    # Variables made by a framework's own constructor serve whatever their name.
    makers = own.filter(F.col("token").rlike(r"^(?:\w+\.)?(?:express|Router|fastify|Fastify|Hono|Elysia)(?:<.*)?\z") & (F.col("next1") == "("))
    makers = makers.select("path", F.when(F.col("prev1") == "new", F.when(F.col("prev2") == "=", F.col("prev3"))).when(F.col("prev1") == "=", F.col("prev2")).alias("name_of")).filter("name_of is not null").distinct().withColumn("is_made", F.lit(True))
    rows = rows.join(makers, ["path", "name_of"], "left").withColumn("is_made", F.coalesce("is_made", F.lit(False)))
    # A chain on route('/x') gives its verbs that URI.
    chain_uri = rows.filter("method = 'route' and n = 1 and a0.kind = 'string'").groupBy("path", F.col("root.at").alias("root_at")).agg(F.min(a0).alias("chain_uri"))
    verbs = rows.filter(F.col("method").isin(*VERBS)).withColumn("root_at", F.col("root.at")).join(chain_uri, ["path", "root_at"], "left")
    of_chain = (F.col("a0.kind") != "string") & F.col("chain_uri").isNotNull()
    uri = F.when(of_chain, F.col("chain_uri")).when(F.col("a0.kind") == "string", a0)
    least = F.when(of_chain, 0).otherwise(1)
    handled = (F.col("handled") >= least) | F.col("o_handler").isNotNull()
    plain = verbs.filter(uri.isNotNull() & handled & serves).select("path", "open", "line", "router", F.upper("method").alias("verb"), uri.alias("uri"), "handled", "o_handler", least.alias("least"))
    # route({method, url, handler}): one or several verbs.
    several = rows.filter("method = 'route' and a0.kind = 'object' and coalesce(o_url, o_uri) is not null").join(own.select("path", F.col("at").alias("methods_at"), F.col("at").alias("list_at"), F.col("token").alias("listed")), ["path", "methods_at"], "left")
    several = several.join(words.groupBy("path", "list_at").agg(F.collect_set("word").alias("verbs")), ["path", "list_at"], "left")
    each = F.when(F.col("o_method") == "[", F.col("verbs")).otherwise(F.array(F.coalesce(text("o_method"), F.lit("GET"))))
    full = several.select("path", "open", "line", "router", F.explode(each).alias("verb"), F.coalesce(text("o_url"), text("o_uri")).alias("uri"), F.lit(None).cast("bigint").alias("handled"), "o_handler", F.lit(0).alias("least"))
    both = plain.unionByName(full.withColumn("verb", F.upper("verb")))
    given = simple.unionByName(listed).unionByName(hook_words.withColumn("arg", F.lit(0).cast("bigint"))).withColumn("hook", F.lit(False)).select("path", "open", "arg", "at", "word")
    met = both.select("path", "open", "handled", "least").distinct().join(given, ["path", "open"]).join(hook_words.select("path", "open", "at", F.lit(True).alias("is_hook")), ["path", "open", "at"], "left")
    before = met.filter(((F.col("arg") >= F.col("least")) & (F.col("arg") < F.col("handled"))) | F.col("is_hook")).groupBy("path", "open").agg(F.transform(F.array_sort(F.collect_set(F.struct("at", "word"))), lambda x: x["word"]).alias("middlewares"))
    last = both.select("path", "open", F.col("handled").alias("arg")).distinct().join(args, ["path", "open", "arg"]).select("path", "open", F.when(F.col("kind") == "function", "closure").otherwise(F.col("word")).alias("handler"))
    word = lambda c: F.when(F.col(c).isin("async", "function", "("), "closure").otherwise(F.col(c))
    routed = both.join(before, ["path", "open"], "left").join(last, ["path", "open"], "left")
    empty = F.array().cast("array<string>")
    verb = F.when(F.col("verb").isin("ALL", "ANY"), "GET").otherwise(F.col("verb"))
    routes = routed.select("path", F.lit("route").alias("kind"), verb.alias("http_method"), "uri", "router", F.lit(None).cast("string").alias("parent"), F.coalesce("handler", word("o_handler"), F.lit("closure")).alias("handler"), F.coalesce("middlewares", empty).alias("middlewares"), "line")

    # Mounts: what a scope is given to, and under which prefix.
    mounting = rows.filter(F.col("method").isin(*MOUNTS) & F.col("a0").isNotNull() & ~((F.col("method") == "route") & (F.col("n") == 1)))
    prefix = F.coalesce(F.when(F.col("a0.kind") == "string", a0), text("o_prefix"), F.lit(""))
    # fp(plugin) and the like pass their own argument on.
    wrapped = scopes.arguments(own, called.filter(F.col("name").isin("fp", "fastifyPlugin"))).filter("arg = 0 and kind in ('name', 'function')").select("path", F.col("open").alias("wrap_open"), F.when(F.col("kind") == "name", F.col("word")).alias("wrapped"))
    passed = called.filter(F.col("name").isin("fp", "fastifyPlugin")).select("path", F.col("at").alias("start"), F.col("open").alias("wrap_open")).join(wrapped, ["path", "wrap_open"]).select("path", "start", "wrapped")
    children = mounting.select("path", "open", "line", "router", "method", "inline", prefix.alias("uri"), F.col("a0.kind").alias("k0")).join(args.filter(F.col("kind").isin("name", "call")), ["path", "open"], "left").join(passed, ["path", "start"], "left")
    # Of several children the last one counts: what stands before it are middlewares.
    name = F.coalesce("wrapped", F.when(F.col("kind") == "name", F.col("word")))
    picked = children.groupBy("path", "open", "line", "router", "uri", "inline").agg(F.max(F.when(name.isNotNull(), F.struct("arg", name.alias("name")))).alias("child"))
    child = F.coalesce(F.when(F.col("inline").isNotNull(), F.concat(F.lit("@"), F.col("inline.start").cast("string"))), F.col("child.name"))
    mounts = picked.filter(child.isNotNull()).select("path", F.lit("mount").alias("kind"), F.lit(None).cast("string").alias("http_method"), "uri", child.alias("router"), F.col("router").alias("parent"), F.lit(None).cast("string").alias("handler"), empty.alias("middlewares"), "line")

    # A router's own prefix: basePath('/x'), new Elysia({prefix}).
    own_prefix = rows.filter(((F.col("method") == "basePath") & (F.col("a0.kind") == "string")) | (F.col("name").isin("Elysia") & F.col("o_prefix").isNotNull()))
    prefixes = own_prefix.select("path", F.lit("prefix").alias("kind"), F.lit(None).cast("string").alias("http_method"), F.when(F.col("method") == "basePath", a0).otherwise(text("o_prefix")).alias("uri"), "router", F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("handler"), empty.alias("middlewares"), "line")
    # What a module exports as its own value.
    token, scoped = F.col("token"), lambda v: v.rlike(r"^[$\w]+\z") & ~v.isin("async", "function", "class", "new")
    default = F.when((F.col("next1") == "function") & (F.col("next2") != "("), F.col("next2")).when((F.col("next1") == "async") & (F.col("next2") == "function") & (F.col("next3") != "("), F.col("next3")).when(scoped(F.col("next1")), F.col("next1"))
    exported = own.filter((token == "default") & (F.col("prev1") == "export") & default.isNotNull()).select("path", default.alias("router"))
    exported = exported.unionByName(own.filter((token == "module.exports") & (F.col("next1") == "=") & scoped(F.col("next2"))).select("path", F.col("next2").alias("router")))
    aliases = exported.select("path", F.lit("alias").alias("kind"), F.lit(None).cast("string").alias("http_method"), F.lit("").alias("uri"), "router", F.lit("default").alias("parent"), F.lit(None).cast("string").alias("handler"), empty.alias("middlewares"), F.lit(0).alias("line"))
    lower = F.lower("content")
    kinds = files.select("path", F.when(F.contains(lower, F.lit("elysia")), "elysia").when(F.contains(lower, F.lit("hono")), "hono").when(F.contains(lower, F.lit("fastify")), "fastify").otherwise("express").alias("framework"))
    every = routes.unionByName(mounts).unionByName(prefixes).unionByName(aliases)
    return every.join(kinds, "path")


def _php(found: DataFrame) -> DataFrame:
    own = found.filter("language = 'php'")
    called = scopes.calls(own).filter(F.col("root.token").rlike(r"^\\?(?:[\w\\]+\\)?Route(?:::|\z)"))
    args = materialize(scopes.arguments(own, called), "arguments")
    groups = called.filter("method = 'group'").join(args.filter("kind = 'function'"), ["path", "open"])
    spans = groups.select("path", F.concat(F.lit("@"), F.col("start").cast("string")).alias("key"), (F.col("start") - 1).alias("start"), (F.col("stop") + 1).alias("end"))
    first = args.filter("arg = 0").select("path", "open", scopes.unquoted(F.col("first")).alias("text"), F.col("kind").alias("k0"), F.col("start").alias("object"))
    asked = called.join(first, ["path", "open"], "left").withColumn("root_at", F.col("root.at"))
    asked = scopes.innermost(asked, spans, ["path"], "at", ["key"]).withColumn("router", F.coalesce("key", F.lit("Route")))
    asked = materialize(asked, "php-calls")
    # Prefixes of a chain, and of an array given to group.
    said = asked.filter("method = 'prefix' and k0 = 'string'").groupBy("path", "root_at").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "/").alias("chain_prefix"))
    keyed = asked.filter("method = 'group' and k0 = 'array'").join(scopes.properties(own).filter("key = 'prefix'"), ["path", "object"]).select("path", "open", scopes.unquoted(F.col("value")).alias("array_prefix"))
    guards = asked.filter("method = 'middleware'").select("path", "root_at", "open")
    strings = own.filter(scopes.is_string(F.col("token"))).select("path", "parent", "at", scopes.unquoted(F.col("token")).alias("word"))
    lists = guards.join(args.filter("kind = 'array'").select("path", "open", F.col("start").alias("parent")), ["path", "open"]).select("path", "root_at", "parent")
    worn = guards.select("path", "root_at", F.col("open").alias("parent")).unionByName(lists).join(strings, ["path", "parent"]).groupBy("path", "root_at").agg(F.transform(F.array_sort(F.collect_set(F.struct("at", "word"))), lambda x: x["word"]).alias("middlewares"))
    asked = asked.join(said, ["path", "root_at"], "left").join(worn, ["path", "root_at"], "left")
    inline = groups.select("path", "open", F.concat(F.lit("@"), F.col("start").cast("string")).alias("child"))
    none, empty = F.lit(None).cast("string"), F.array().cast("array<string>")
    mounts = asked.filter("method = 'group'").join(inline, ["path", "open"]).join(keyed, ["path", "open"], "left").select("path", F.lit("mount").alias("kind"), none.alias("http_method"), F.concat_ws("/", "chain_prefix", "array_prefix").alias("uri"), F.col("child").alias("router"), F.col("router").alias("parent"), none.alias("handler"), empty.alias("middlewares"), "line")
    second = args.filter("arg = 1").select("path", "open", F.col("kind").alias("k1"), F.col("first").alias("f1"), F.col("word").alias("w1"), F.col("start").alias("list_at"))
    inside = own.select("path", F.col("parent").alias("list_at"), "at", "token").groupBy("path", "list_at").agg(F.min(F.when(F.col("token").endswith("::class"), F.struct("at", "token"))).alias("c"), F.min(F.when(scopes.is_string(F.col("token")), F.struct("at", "token"))).alias("m"))
    taking = asked.join(second, ["path", "open"]).join(inside, ["path", "list_at"], "left")
    cls = lambda c: _last(F.regexp_replace(c, r"::class\z", ""))
    pair = F.concat_ws("@", cls(F.col("c.token")), scopes.unquoted(F.col("m.token")))
    handler = F.when(F.col("k1") == "array", pair).when(F.col("k1") == "string", scopes.unquoted(F.col("f1"))).when(F.col("w1").endswith("::class"), F.concat(cls(F.col("w1")), F.lit("@__invoke"))).otherwise("closure")
    uri = F.concat_ws("/", "chain_prefix", "text")
    verb = F.when(F.col("method") == "any", "GET").otherwise(F.upper("method"))
    plain = taking.filter(F.col("method").isin(*VERBS) & (F.col("k0") == "string")).select("path", F.lit("route").alias("kind"), verb.alias("http_method"), uri.alias("uri"), "router", none.alias("parent"), handler.alias("handler"), F.coalesce("middlewares", empty).alias("middlewares"), "line")
    actions = F.array(*[F.struct(F.lit(v).alias("v"), F.lit(s).alias("s"), F.lit(a).alias("a")) for v, s, a in RESOURCE])
    kept = F.when(F.col("method") == "apiResource", F.slice(actions, 1, 5)).otherwise(actions)
    full = taking.filter(F.col("method").isin("resource", "apiResource") & (F.col("k0") == "string")).withColumn("x", F.explode(kept))
    full = full.select("path", F.lit("route").alias("kind"), F.col("x.v").alias("http_method"), F.concat(uri, F.col("x.s")).alias("uri"), "router", none.alias("parent"), F.concat_ws("@", cls(F.col("w1")), "x.a").alias("handler"), F.coalesce("middlewares", empty).alias("middlewares"), "line")
    laravel = plain.unionByName(full).unionByName(mounts).withColumn("framework", F.lit("laravel"))
    return laravel.unionByName(_attributes(own))


def _attributes(own: DataFrame) -> DataFrame:
    """Routes written as attributes of methods, and of classes for all their methods."""
    none, empty = F.lit(None).cast("string"), F.array().cast("array<string>")
    around = own.filter("token = '#['").select("path", F.col("at").alias("parent"), "target")
    routes = scopes.calls(own).filter(F.col("name").rlike(r"^(?:[\w\\]+\\)?Route\z")).join(around, ["path", "parent"]).filter("target is not null")
    args = scopes.arguments(own, routes).filter("arg = 0 and kind = 'string'").select("path", "open", scopes.unquoted(F.col("first")).alias("text"))
    props = scopes.properties(own).select("path", F.col("object").alias("open"), "key", "value", (F.col("mark_at") + 1).alias("list_at"))
    path = props.filter("key = 'path'").groupBy("path", "open").agg(F.min(scopes.unquoted(F.col("value"))).alias("named"))
    strings = own.filter(scopes.is_string(F.col("token"))).select("path", F.col("parent").alias("list_at"), scopes.unquoted(F.col("token")).alias("verb"))
    methods = props.filter("key = 'methods'").join(strings, ["path", "list_at"]).groupBy("path", "open").agg(F.collect_set(F.upper("verb")).alias("verbs"))
    rows = routes.join(args, ["path", "open"], "left").join(path, ["path", "open"], "left").join(methods, ["path", "open"], "left").withColumn("uri", F.coalesce("text", "named", F.lit("")))
    rows = materialize(rows.select("path", "at", "line", "uri", "verbs", "target"), "attributes")
    classes = rows.filter("target.token = 'class'").select("path", "line", "uri", F.concat(F.lit("@"), F.col("target.at").cast("string")).alias("key"), F.col("target.at").alias("start"), F.coalesce(F.col("target.body.end"), F.lit(scopes.END)).alias("end"))
    mounts = classes.select("path", F.lit("mount").alias("kind"), none.alias("http_method"), "uri", F.col("key").alias("router"), F.lit("Route").alias("parent"), none.alias("handler"), empty.alias("middlewares"), "line")
    found = scopes.innermost(rows.filter("target.token = 'function'"), classes.select("path", "key", "start", "end"), ["path"], "at", ["key"])
    own_verbs = F.coalesce("verbs", F.array(F.lit("GET")))
    kept = found.select("path", F.lit("route").alias("kind"), F.explode(own_verbs).alias("http_method"), "uri", F.coalesce("key", F.lit("Route")).alias("router"), none.alias("parent"), F.col("target.next1").alias("handler"), empty.alias("middlewares"), "line")
    return kept.unionByName(mounts).withColumn("framework", F.lit("symfony"))


def brace_facts(files: DataFrame) -> DataFrame:
    """Routes, mounts, router prefixes and aliases of (path, language, content)."""
    hinted = F.exists(F.array(*[F.lit(h) for h in HINTS]), lambda h: F.contains(F.col("content"), h))
    texts = files.filter(F.col("language").isin(*scopes.BRACE_LANGUAGES) & hinted).select("path", "language", "content")
    found = scopes.tokens(texts)
    return _js(found, texts).unionByName(_php(found))
