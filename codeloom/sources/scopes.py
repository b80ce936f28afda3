"""Scopes, calls and properties of brace languages, by windows over a file's tokens.

A file becomes rows of tokens; comments go, strings stay whole. Brackets are
paired by a window over each level, so every scope is an interval of token
numbers, and the scope around a place is the innermost interval that holds it.
Files meet in no join or window with one another, so the work is spread by file.

Cases: null or empty sources have no tokens; a bracket that never closes goes
to the end of the file; regular expression literals are read as tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.plans.shared import materialize

BRACE_LANGUAGES = ("typescript", "javascript", "php")
_COMMENT = r"//[^\n]*+|/\*(?s:.*?)(?:\*/|\z)"
_STRING = "|".join(rf"{q}[^{q}\\]*+(?:\\(?s:.)[^{q}\\]*+)*+{q}" for q in "'\"`")
#: A dotted name, with type arguments where a call follows.
_WORD = r"[@$\w\\]++(?:(?:\.|->|::|\?\.)[$\w]++)*+(?:<[^()<>;]*+>(?=\s*\())?"
_MARK = r"=>|->|::|\?\.|#\[|[(){}\[\],;=:.]|\n"
TOKEN = {"php": f"{_COMMENT}|#(?!\\[)[^\\n]*+|{_STRING}|{_WORD}|{_MARK}", "": f"{_COMMENT}|{_STRING}|{_WORD}|{_MARK}"}
OPEN, CLOSE = ("(", "{", "[", "#["), (")", "}", "]")
#: Words that begin a statement, so the one before has ended.
STATEMENT = (";", "const", "let", "var", "export", "function", "class", "return", "import")
END = 1 << 30


def is_word(token: Column) -> Column:
    return token.rlike(r"^[@$\w\\]")


def is_string(token: Column) -> Column:
    return token.rlike("^['\"`]")


def unquoted(token: Column) -> Column:
    """What a string token says; null for another token."""
    return F.when(is_string(token), F.regexp_replace(token, "^['\"`]|['\"`]\\z", ""))


def tokens(files: DataFrame) -> DataFrame:
    """Tokens of (path, language, content): path, language, at, token, line, parent (the bracket around it), arg (commas before it there), chain, root and before (how its chain of calls begins), end (of a bracket), and neighbours."""
    found = F.when(F.col("language") == "php", F.regexp_extract_all("content", F.lit(TOKEN["php"]), F.lit(0))).otherwise(F.regexp_extract_all("content", F.lit(TOKEN[""]), F.lit(0)))
    rows = files.filter(F.col("language").isin(*BRACE_LANGUAGES)).select("path", "language", F.posexplode(found).alias("at", "token"))
    order = Window.partitionBy("path").orderBy("at")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = order.rowsBetween(Window.unboundedPreceding, -1)
    breaks = F.length("token") - F.length(F.replace("token", F.lit("\n"), F.lit("")))
    rows = rows.withColumn("line", F.coalesce(F.sum(breaks).over(ahead), F.lit(0)).cast("int") + 1)
    hidden = F.col("token").rlike(r"^(?://|/\*|\n)") | (F.col("token").rlike(r"^#(?!\[)") & (F.col("language") == "php"))
    opens, closes = F.col("token").isin(*OPEN), F.col("token").isin(*CLOSE)
    rows = rows.filter(~hidden).withColumn("depth", F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(so_far))
    for n in (1, 2, 3, 4):
        rows = rows.withColumn(f"prev{n}", F.coalesce(F.lag("token", n).over(order), F.lit(""))).withColumn(f"next{n}", F.coalesce(F.lead("token", n).over(order), F.lit("")))
    rows = rows.withColumn("at1", F.lead("at").over(order)).withColumn("level", F.when(closes, F.col("depth") + 1).otherwise(F.col("depth"))).withColumn("d", F.when(opens, F.col("depth") - 1).otherwise(F.col("depth")))
    # Brackets of one level open and close in turn.
    turn = Window.partitionBy("path", "level", opens | closes).orderBy("at")
    rows = rows.withColumn("end", F.when(opens, F.coalesce(F.lead("at").over(turn), F.lit(END))))
    marks = rows.filter(opens).select(*[F.col("level").alias("d") if c == "d" else c for c in rows.columns], F.lit(True).alias("marker"))
    level = Window.partitionBy("path", "d").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("marker", F.lit(False)).unionByName(marks).withColumn("parent", F.coalesce(F.last(F.when(F.col("marker"), F.col("at")), ignorenulls=True).over(level), F.lit(-1))).filter(~F.col("marker"))
    inside = Window.partitionBy("path", "parent").orderBy("at")
    until, since = inside.rowsBetween(Window.unboundedPreceding, -1), inside.rowsBetween(1, Window.unboundedFollowing)
    starts = is_word(F.col("token")) & ~F.col("prev1").isin(".", "->", "::", "?.")
    rows = rows.withColumn("arg", F.coalesce(F.sum((F.col("token") == ",").cast("int")).over(until), F.lit(0)))
    rows = rows.withColumn("root", F.last(F.when(starts, F.struct("at", "token", "prev1", "prev2", "prev3")), ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    rows = rows.withColumn("body", F.first(F.when(F.col("token") == "{", F.struct("at", "end")), ignorenulls=True).over(since))
    rows = rows.withColumn("stop", F.first(F.when(F.col("token").isin(*STATEMENT), F.col("at")), ignorenulls=True).over(since))
    rows = rows.withColumn("target", F.first(F.when(F.col("token").isin("class", "function"), F.struct("at", "token", "next1", F.col("body").alias("body"))), ignorenulls=True).over(since))
    return materialize(rows.drop("marker", "depth", "d", "level"), "tokens")


def calls(found: DataFrame) -> DataFrame:
    """Calls among tokens: path, language, at, line, parent, root, name, receiver (null behind a dot), method, open."""
    name = F.regexp_replace("token", r"<.*", "")
    chained = F.col("prev1").isin(".", "->", "::", "?.")
    cut = r"^(.*)(?:\.|->|::)[$\w]+\z"
    receiver = F.when(~chained, F.nullif(F.regexp_extract(name, cut, 1), F.lit("")))
    return found.filter(is_word(F.col("token")) & (F.col("next1") == "(")).select(
        "path", "language", "at", "line", "parent", "root", name.alias("name"), receiver.alias("receiver"), F.regexp_extract(name, r"([$\w]+)\z", 1).alias("method"), F.col("at1").alias("open"), F.col("arg").alias("in_arg")
    )


def arguments(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """Arguments of calls (path, open): path, open, arg, start, stop, first, second, n, kind (string, name, object, array, call, function, other) and word."""
    inner = found.join(wanted.select("path", F.col("open").alias("parent")), ["path", "parent"]).filter("token <> ','")
    each = inner.groupBy("path", "parent", "arg").agg(
        F.min(F.struct("at", "token", "next1", "end")).alias("f"), F.count("*").alias("n"), F.max((F.col("token") == "=>").cast("int")).alias("arrow"), F.max(F.when(F.col("token") == "(", F.col("end"))).alias("last_end"), F.max("at").alias("last")
    )
    first = F.col("f.token")
    kind = (
        F.when(first.isin("function", "async", "fn") | (F.col("arrow") == 1) & ~first.startswith("[") & ~is_string(first), "function")
        .when(is_string(first), "string")
        .when(first == "{", "object")
        .when(first == "[", "array")
        .when(is_word(first) & (F.col("n") == 1), "name")
        .when(is_word(first) & (F.col("f.next1") == "("), "call")
        .otherwise("other")
    )
    return each.filter(~first.isin(*CLOSE)).select("path", F.col("parent").alias("open"), "arg", F.col("f.at").alias("start"), F.greatest("last", F.coalesce("last_end", "last")).alias("stop"), first.alias("first"), "n", kind.alias("kind"), F.regexp_replace(first, r"<.*", "").alias("word"), F.col("f.end").alias("end"))


def properties(found: DataFrame) -> DataFrame:
    """Keys and values of objects, named arguments and PHP arrays: path, object (its bracket), key, value (the first token), value_at."""
    keyed = (F.col("next1").isin(":", "=>")) & (is_word(F.col("token")) | is_string(F.col("token"))) & (F.col("parent") >= 0)
    return found.filter(keyed).select("path", F.col("parent").alias("object"), F.coalesce(unquoted(F.col("token")), F.col("token")).alias("key"), F.col("next2").alias("value"), (F.col("at1")).alias("mark_at"), F.col("at").alias("key_at"))


def innermost(places: DataFrame, scopes: DataFrame, keys: list[str], place: str, more: list[str]) -> DataFrame:
    """Each place (``keys`` and the column ``place``) with the columns ``more`` of the innermost of ``scopes`` (start, end) around it; null where none is.

    An equi-join on ``keys``, which begin with the file, so a file's places meet
    that file's scopes alone.
    """
    own = places.select(*keys, place).distinct()
    met = own.join(scopes, keys).filter((F.col("start") < F.col(place)) & (F.col(place) < F.col("end")))
    best = met.groupBy(*keys, place).agg(F.max(F.struct("start", *more)).alias("best"))
    return places.join(best.select(*keys, place, *[F.col(f"best.{c}").alias(c) for c in more]), [*keys, place], "left")


def fold_prefixes(scopes: DataFrame, prefix: str = "prefix") -> DataFrame:
    """``uri`` of each scope (path, scope, start, end, prefix): the prefixes of the scopes around it, outermost first, then its own.

    Scopes beside each other never meet; a scope's chain is what holds its
    start, so nothing is iterated.
    """
    inner = scopes.select("path", "scope", F.col("start").alias("at"), F.col("end").alias("until"))
    outer = scopes.select("path", "start", "end", F.coalesce(F.col(prefix), F.lit("")).alias("p"))
    # The scope itself is one of those around it.
    held = inner.join(outer, "path").filter((F.col("start") <= F.col("at")) & (F.col("until") <= F.col("end")))
    chain = held.groupBy("path", "scope", "at").agg(F.array_sort(F.collect_list(F.struct("start", (-F.col("end")).alias("back"), "p"))).alias("c"), F.count("*").alias("depth"))
    uri = F.regexp_replace(F.concat(F.lit("/"), F.array_join(F.transform("c", lambda x: x["p"]), "/")), "/+", "/")
    return chain.select("path", "scope", F.when(uri == "/", uri).otherwise(F.regexp_replace(uri, r"/\z", "")).alias("uri"), F.col("depth").cast("int").alias("depth"))
