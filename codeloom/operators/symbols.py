"""Symbol queries: parsing what was asked, type hints, outbound calls and their targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.behaviour import calls

#: Marks between a container and its member, and what a member behind each is.
MARKS = (("::", "method"), ("->", "method"), (".", None))
# Type names that name no symbol.
PRIMITIVES = ("string", "int", "float", "bool", "boolean", "number", "array", "object", "mixed", "void", "null", "any", "unknown", "never", "self", "static", "callable", "iterable", "str", "dict", "list", "none")


def _plain_name(name: str, more: str = "") -> bool:
    return bool(name) and all(c.isascii() and (c.isalnum() or c in "_" + more) for c in name)


def parse_query(text: str) -> dict[str, str | None]:
    """container, member and kind of a question about a symbol: an error message, a call, or a bare name.

    A message is known by its own words: what follows ``method`` names a member
    of a class, and ``has no attribute`` stands between an object and a member.
    """
    asked = text.strip()
    words = [w.strip("'\"`,;") for w in asked.split()]
    lowered = [w.lower() for w in words]
    for i in range(len(words) - 1):
        if lowered[i] == "method" and "::" in words[i + 1]:
            container, _, member = words[i + 1].removesuffix("()").rpartition("::")
            return {"container": container, "member": member, "kind": "method"}
        if lowered[i : i + 3] == ["has", "no", "attribute"] and i + 3 < len(words) and i:
            owner = words[i - 2] if lowered[i - 1] == "object" and i > 1 else words[i - 1]
            return {"container": owner, "member": words[i + 3], "kind": None}
    called = asked.endswith("()")
    name = asked.removesuffix("()")
    for mark, kind in MARKS:
        container, found, member = name.rpartition(mark)
        if found and _plain_name(member) and _plain_name(container, "" if mark == "." else "\\/."):
            return {"container": container, "member": member, "kind": kind}
    return {"container": None, "member": name if called and _plain_name(name) else asked, "kind": "function" if called and _plain_name(name) else None}


def type_hints(signature: Column) -> Column:
    """Class names among a signature's parameter types, each once."""
    inside = F.regexp_extract(signature, r"\((.*)\)", 1)
    before = F.regexp_extract_all(inside, F.lit(r"(?:^|,)\s*\??([A-Z][\w\\]*)\s+[&.]*\$"), F.lit(1))
    after = F.regexp_extract_all(inside, F.lit(r":\s*([A-Za-z_][\w.]*)"), F.lit(1))
    return F.array_distinct(F.filter(F.concat(before, after), lambda t: ~F.lower(t).isin(*PRIMITIVES)))


def outbound_calls(body: Column) -> Column:
    """Calls that a body makes on classes and on its own object's properties, as ``Class::method``; a property stands for the class of its name.

    Comments and strings are left out, and so is ``this.db``; of a class with a namespace the last part counts.
    """
    strings = "|".join(rf"{q}[^{q}\\]*+(?:\\(?s:.)[^{q}\\]*+)*+(?:{q}|\z)" for q in "'\"`")
    code = F.regexp_replace(body, rf"{strings}|/\*(?s:.*?)(?:\*/|\z)|//[^\n]*", " '' ")

    def target(c: Column) -> Column:
        prop = F.regexp_extract(c["on"], r"^(?:\$this->|this\.)(\w+)$", 1)
        named = F.regexp_extract(c["on"], r"^\\?(?:\w+\\)*([A-Z]\w*)$", 1)
        owner = F.when((c["mark"] == "::") & (named != ""), named)
        owner = owner.when((prop != "") & ~((c["on"] == "this.db") & (c["mark"] == ".")), F.concat(F.upper(F.substring(prop, 1, 1)), F.substring(prop, 2, 1 << 20)))
        return F.concat(owner, F.lit("::"), c["name"])

    return F.array_distinct(F.filter(F.transform(calls(code), target), lambda t: t.isNotNull()))


def resolve_calls(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """Each call (caller, member) with its target.

    A member may be ``Class::method``: the one symbol of that class's last name
    and that method comes first. Else the one symbol whose last part is the
    member's; else null and how many there are.
    """
    last = lambda name, at: F.get(F.reverse(F.split(name, r"::|\.|#|\\")), F.lit(at))
    named = symbols.select(F.col("name").alias("target")).distinct().select("target", last("target", 0).alias("part"), last("target", 1).alias("owner"))
    by_part = named.groupBy("part").agg(F.count("*").alias("n"), F.min("target").alias("t"))
    by_both = named.filter("owner is not null").groupBy("part", "owner").agg(F.count("*").alias("n_own"), F.min("target").alias("t_own"))
    asked = calls.select("caller", "member", last("member", 0).alias("part"), last("member", 1).alias("owner"))
    met = asked.join(by_part, "part", "left").join(by_both, ["part", "owner"], "left")
    target = F.when(F.col("n_own") == 1, F.col("t_own")).when(F.col("n") == 1, F.col("t"))
    return met.select("caller", "member", target.alias("target"), F.coalesce(F.when(F.col("n_own") == 1, F.lit(1)), "n", F.lit(0)).cast("bigint").alias("n_candidates"))


def inspect(symbols: DataFrame, files: DataFrame, name: str, indexed: DataFrame) -> DataFrame:
    """Symbols of a name with a status: ambiguous, unavailable (no file), stale (other content) or current.

    ``symbols`` has path and indexed content_hash by way of ``indexed``; ``files`` is the workspace now.
    """
    rows = symbols.filter(F.col("name") == name).join(indexed.select("path", F.col("content_hash").alias("was")), "path", "left").join(files.select("path", F.col("content_hash").alias("now")), "path", "left")
    several = F.count("*").over(Window.partitionBy("name")) > 1
    status = F.when(several, "ambiguous").when(F.col("now").isNull(), "unavailable").when(F.col("now") != F.col("was"), "stale").otherwise("current")
    return rows.withColumn("status", status).drop("was", "now").withColumn("too_long", F.col("line_count") > 300)
