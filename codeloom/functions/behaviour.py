"""Behavioural facts of method bodies: guards, transactions, events, jobs and mutations, natively.

A body is read as its calls: who is called on, by what mark, the name, what
the first argument begins with, and all arguments. Tables of names decide what a call says.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A call: receiver, mark, name; ahead of it, whether an object is made, a quote, the first argument's beginning, and the arguments up to a second level of brackets.
CALL = r"(?:([\\$\w]+(?:(?:->|::|\.)\w+)*)(->|::|\.))?(@?\w+)\s*\((?=\s*(new\s+)?(['\"]?)([\w\\:./-]*))(?=((?:[^()]++|\([^()]*+\))*+))"
PARTS = ("on", "mark", "name", "made", "quote", "first", "all")
#: An assignment to a property of a variable.
ASSIGNED = r"\$(\w+)->(\w+)\s*=(?![=>])"
#: Who sends events by name, and who takes jobs by name.
EMITTERS, QUEUES = ("eventEmitter", "$emit"), ("queue", "queueService")
#: How a job is sent.
DISPATCHES = ("dispatch", "dispatchSync", "dispatchNow", "dispatchIf", "dispatchUnless", "dispatchAfterResponse")
#: Parts of a class name that make it a job.
JOB_WORDS = ("Job", "Queue", "Task", "Process")


def without_comments(code: Column) -> Column:
    """The code without block comments and lines that are a comment whole."""
    return F.regexp_replace(F.regexp_replace(code, r"(?s)/\*.*?(?:\*/|\z)", " "), r"(?m)^[ \t]*(?://|#(?!\[)|\*)[^\n]*$", "")


def calls(code: Column) -> Column:
    """The calls of a code in order, as structs of :data:`PARTS`; an absent part is empty."""
    each = F.arrays_zip(*[F.regexp_extract_all(code, F.lit(CALL), F.lit(i + 1)).alias(p) for i, p in enumerate(PARTS)])
    return F.transform(each, lambda c: F.struct(*[F.coalesce(c[p], F.lit("")).alias(p) for p in PARTS]))


def _last(name: Column) -> Column:
    """The part of a name behind its last mark."""
    return F.regexp_extract(name, r"(\$?\w+)$", 1)


def facts(body: Column) -> Column:
    """A struct of guards, has_transaction, events, jobs and mutations (each distinct, first seen first); comments are left out."""
    code = without_comments(body)
    found = calls(code)

    def named(*rules) -> Column:
        """For each call the first name, or names, that a rule gives."""
        none = F.array().cast("array<string>")
        each = F.flatten(F.transform(found, lambda c: F.coalesce(*[r(c) for r in rules], none)))
        return F.array_distinct(F.filter(each, lambda n: n.isNotNull() & (n != "")))

    def one(rule):
        """A rule that gives one name."""
        return lambda c: F.when(rule(c).isNotNull(), F.array(rule(c)))

    def classes(c):
        """The classes among a call's arguments, whether made there or named."""
        flat = F.split(F.regexp_replace(c["all"], r"\([^()]*\)", ""), ",")
        return F.transform(flat, lambda a: F.regexp_extract(a, r"^\s*(?:new\s+)?([\w.\\]+)", 1))

    quoted = lambda c: c["quote"] != ""
    makes = lambda c: (c["made"] != "") & (c["quote"] == "")
    guards = named(
        one(lambda c: F.when((c["name"] == "authorize") & quoted(c) & _last(c["on"]).isin("$this", "Gate"), c["first"])),
        lambda c: F.when(c["name"] == "@UseGuards", classes(c)),
        one(lambda c: F.when(c["name"].isin("abort_if", "abort_unless"), "abort_guard")),
    )
    events = named(
        one(lambda c: F.when(c["name"].isin("event", "broadcast") & makes(c), c["first"])),
        one(lambda c: F.when((c["name"] == "dispatch") & (c["mark"] == "::") & (_last(c["on"]) == "Event") & ~quoted(c), F.regexp_extract(c["first"], r"^\w+", 0))),
        one(lambda c: F.when((c["name"] == "emit") & quoted(c) & _last(c["on"]).isin(*EMITTERS), c["first"])),
    )
    jobs = named(
        one(lambda c: F.when(c["name"].isin(*DISPATCHES) & (c["mark"] == "::") & F.exists(F.array(*map(F.lit, JOB_WORDS)), lambda w: F.contains(_last(c["on"]), w)), _last(c["on"]))),
        one(lambda c: F.when(c["name"].isin(*DISPATCHES) & ((c["mark"] != "::") | (_last(c["on"]) == "Bus")) & makes(c), c["first"])),
        one(lambda c: F.when((c["name"] == "add") & quoted(c) & _last(c["on"]).isin(*QUEUES), c["first"])),
    )
    starts = lambda c: ((c["on"] == "DB") & (c["mark"] == "::") & c["name"].isin("transaction", "beginTransaction")) | ((c["mark"] == ".") & (c["name"] == "transaction"))
    pairs = F.arrays_zip(F.regexp_extract_all(code, F.lit(ASSIGNED), F.lit(1)).alias("o"), F.regexp_extract_all(code, F.lit(ASSIGNED), F.lit(2)).alias("p"))
    assigned = F.transform(F.filter(pairs, lambda p: ~p["o"].isin("this", "request")), lambda p: F.concat_ws(".", p["o"], p["p"]))
    changed = named(one(lambda c: F.when((c["mark"] == "->") & c["name"].isin("update", "delete") & c["on"].rlike(r"^\$\w+$"), F.concat(F.substring(c["on"], 2, 1 << 20), F.lit("."), c["name"], F.lit("()")))))
    return F.struct(guards.alias("guards"), F.exists(found, starts).alias("has_transaction"), events.alias("events"), jobs.alias("jobs"), F.array_distinct(F.concat(assigned, changed)).alias("mutations"))
