"""Personal data: fixed patterns, and identifiers that bootstrapped contexts reveal.

The base finds emails, IP addresses, payment cards and phone numbers by regular
expressions and checks. Its finds are seeds: the two words before a seed are a
lexical pattern for the seed's kind. Patterns and the identifiers that follow
them, words with digits or an ``@`` and groups of digits, form a graph. Scores
go round it. For a kind, an instance speaks for a pattern by its own score (a
seed of the kind: one), and against it when it is a seed of another kind or has
a shape that the kind cannot have; what is merely unknown says nothing. A
pattern's score is the part of the weight that speaks for it, and it needs the
weight of some seeds; an instance's score is the chance that not all its
patterns are wrong. So what a pattern reveals helps the next patterns. An
instance that is no seed is reported, behind such a pattern, when they are all
but sure of it.

Cases: a null text is empty and has no spans; a text without a digit or ``@``
has none; words of more than some 250 characters are in no pattern; repeated
values count once in a pattern, repeated rows each give a row; ties between kinds go to the first listed; an empty table gives none; extra
columns are ignored. Positions are code points, ends exclusive. Everything runs
as DataFrame expressions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm._tables import spare, table
from codeloom.plans.shared import materialize, remove_table
from codeloom.plans.skew import salted_lookup

KINDS = ("email", "ip", "card", "phone")
SPAN = "array<struct<kind:int,s:int,e:int,value:string,left:string>>"
#: A pattern equal to the one asked for, but that starts no match inside a run of the same characters, so long runs cost no more than their length.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: Chains of digits of any other length than 16 to 19 are no match that could pass.
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}(?![\x20-]?[0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTET = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
#: Matches whose lengths are summed one by one.
SUM_BLOCK = 64
#: What may be an identifier: groups of digits parted by single spaces, or a word with a digit or ``@``.
IDENTIFIER = r"(?<!\S)(?:[(]?[0-9][0-9()./-]*+(?:\x20[(]?[0-9][0-9()./-]*+)++|(?=\S*[0-9@])\S++)"
#: The shapes that an identifier of each kind may have, and how many digits.
SHAPES = ((r"^\S+@\S+$", 0, 1 << 30), (r"^[0-9a-f]+(?:[.:]+[0-9a-f]+){3,}$", 4, 32), (r"^[0-9][0-9\x20-]+$", 12, 19), (r"^\+?[0-9][0-9\x20()./-]+$", 6, 15))
#: Characters before an identifier in which its two words are looked for.
CONTEXT = 256


@dataclass(frozen=True)
class Settings:
    """Rounds over the graph, and what a discovery needs."""

    rounds: int = 3
    #: The weight of seeds behind a pattern, its score, and the score of what it reveals.
    seeds: int = 10
    precision: float = 0.9
    accept: float = 0.9


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0), lambda a, x: a + x)


def _matches(text: Column, pattern: str) -> Column:
    """Matches of a pattern, leftmost first, as (s, e, value).

    The lengths of the text between matches give the positions. Sums before a
    match are taken by blocks, so a text with many matches costs little more
    than its length.
    """
    ahead = lambda sums, n: F.transform(F.sequence(F.lit(0), n - 1), lambda b: _sum(F.slice(sums, 1, b)))

    def place(both: Column) -> Column:
        n = F.size(both["found"])
        steps = F.zip_with(F.slice(both["gaps"], 1, n), both["found"], lambda g, v: F.length(g) + F.length(v))

        def of(steps: Column) -> Column:
            blocks = F.ceil(n / SUM_BLOCK).cast("int")
            sums = F.transform(F.sequence(F.lit(0), blocks - 1), lambda b: _sum(F.slice(steps, b * SUM_BLOCK + 1, F.lit(SUM_BLOCK))))
            return _let(_let(sums, lambda x: ahead(x, blocks)), lambda before: F.transform(both["found"], lambda v, i: at(steps, before, v, i)))

        def at(steps: Column, before: Column, value: Column, i: Column) -> Column:
            block = F.floor(i / SUM_BLOCK).cast("int")
            start = F.get(before, block) + _sum(F.slice(steps, block * SUM_BLOCK + 1, i % SUM_BLOCK)) + F.length(F.get(both["gaps"], i))
            return _let(start, lambda s: F.struct(s.alias("s"), (s + F.length(value)).alias("e"), value.alias("value")))

        return F.when(n > 0, _let(steps, of)).otherwise(F.array().cast("array<struct<s:int,e:int,value:string>>"))

    both = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    return _let(both, place)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(value: Column) -> Column:
    def total(d: Column) -> Column:
        doubled = lambda i: F.substring(d, -(2 * i), F.lit(1)).cast("int") * 2
        odd = F.aggregate(F.sequence(F.lit(0), F.floor((F.length(d) - 1) / 2).cast("int")), F.lit(0), lambda a, i: a + F.substring(d, -(2 * i + 1), F.lit(1)).cast("int"))
        even = F.aggregate(F.sequence(F.lit(1), F.floor(F.length(d) / 2).cast("int")), F.lit(0), lambda a, i: a + doubled(i) - F.when(doubled(i) > 9, 9).otherwise(0))
        return (odd + even) % 10 == 0

    return _let(_digits(value), total)


def base_spans(text: Column) -> Column:
    """All base matches that pass their checks, by kind and then start."""
    tests = (
        (EMAIL, text.contains("@"), lambda m: F.lit(True)),
        (IP, text.rlike(r"[0-9]\.[0-9]"), lambda m: m["value"].rlike(rf"^(?:{OCTET}\.){{3}}{OCTET}\z")),
        (CARD, text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}"), lambda m: _luhn(m["value"])),
        (PHONE, text.rlike(r"\+[0-9]"), lambda m: F.length(_digits(m["value"])).between(8, 15)),
    )
    none = F.array().cast(SPAN)
    spans = []
    for kind, (pattern, likely, passes) in enumerate(tests):
        spans.append(F.when(likely, _spans(text, kind, F.filter(_matches(text, pattern), passes))).otherwise(none))
    return F.when(text.rlike("[0-9@]"), F.concat(*spans)).otherwise(none)


def _left(text: Column, s: Column) -> Column:
    """The two words before a place, lower-cased, digits alike; empty unless there are two letters in them."""
    before = F.substring(text, F.greatest(s - (CONTEXT - 1), F.lit(1)), F.least(s, F.lit(CONTEXT)))
    # What is cut off at the left is no whole word.
    before = F.when(s > CONTEXT, F.regexp_replace(before, r"^\S*", "")).otherwise(before)
    two = F.regexp_replace(F.lower(F.regexp_extract(before, r"(\S+\s+\S+)[\s\"'(\[<]*$", 1)), r"[0-9]", "0")
    return F.when(two.rlike(r"\p{L}{2}"), F.regexp_replace(two, r"\s+", " ")).otherwise("")


def _spans(text: Column, kind: int | None, matches: Column) -> Column:
    return F.transform(matches, lambda m: _span(text, F.lit(kind).cast("int"), m))


def _span(text: Column, kind: Column, m: Column) -> Column:
    return F.struct(kind.alias("kind"), m["s"].alias("s"), m["e"].alias("e"), F.lower(m["value"]).alias("value"), _left(text, m["s"]).alias("left"))


def identifiers(text: Column, base: Column) -> Column:
    """Identifier-like words that no base span touches, without the punctuation around them."""

    def trimmed(m: Column) -> Column:
        core = F.regexp_extract(m["value"], r"^[^\p{L}\p{N}]*(.*?)[^\p{L}\p{N}]*\z", 1)
        lead = F.length(F.regexp_extract(m["value"], r"^[^\p{L}\p{N}]*", 0))
        return F.struct((m["s"] + lead).alias("s"), (m["s"] + lead + F.length(core)).alias("e"), core.alias("value"))

    free = F.filter(F.transform(_matches(text, IDENTIFIER), trimmed), lambda m: (F.length(m["value"]) >= 4) & ~F.exists(base, lambda b: (b["s"] < m["e"]) & (m["s"] < b["e"])))
    return F.when(text.rlike("[0-9@]"), _spans(text, None, free)).otherwise(F.array().cast(SPAN))


def read_spans(docs: DataFrame, *keep: str) -> DataFrame:
    """row, the kept columns, base spans and identifiers of every row with ``text``; one pass over the text."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), *keep, F.coalesce("text", F.lit("")).alias("__text"))
    found = rows.withColumn("base", base_spans(F.col("__text")))
    return found.select("row", *keep, "base", identifiers(F.col("__text"), F.col("base")).alias("others"))


def _fits(value: Column, kind: int) -> Column:
    """Whether a value could be an identifier of a kind."""
    pattern, least, most = SHAPES[kind]
    return value.rlike(pattern) & F.length(_digits(value)).between(least, most)


def discover(read: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(row, kind, s, e) of the identifiers that patterns reveal."""
    kinds = range(len(KINDS))
    seen = read.filter(F.size("base") + F.size("others") > 0).select("row", F.inline(F.concat("base", "others"))).filter("left <> ''")
    edges = materialize(seen.groupBy("left", "value").agg(F.min("kind").alias("seed")), "pii-edges")
    # For each kind an instance's score, null where the instance cannot be of the kind.
    own = edges.groupBy("value").agg(F.min("seed").alias("own"))
    start = [F.when(F.col("own") == k, F.lit(1.0)).when(F.col("own").isNull() & _fits(F.col("value"), k), F.lit(0.0)).alias(f"s{k}") for k in kinds]
    scores = materialize(own.select("value", "own", *start), "pii-scores")
    patterns, held = None, []
    for _ in range(settings.rounds):
        # One row for each value: a value behind many patterns is spread.
        graph = salted_lookup(edges.select("left", "value"), scores, ["value"], F.col("left"), "inner")
        sums = graph.groupBy("left").agg(*[F.coalesce(F.sum(f"s{k}"), F.lit(0.0)).alias(f"for{k}") for k in kinds], *[F.sum(F.col(f"s{k}").isNull().cast("int")).alias(f"no{k}") for k in kinds])
        rate = lambda k: F.col(f"for{k}") / (F.col(f"for{k}") + F.col(f"no{k}"))
        good = [F.when((F.col(f"for{k}") >= settings.seeds) & (rate(k) >= settings.precision), F.least(rate(k), F.lit(0.99))).alias(f"p{k}") for k in kinds]
        patterns = materialize(sums.select("left", *good).filter(" or ".join(f"p{k} is not null" for k in kinds)), "pii-patterns")
        doubt = salted_lookup(edges.select("left", "value"), patterns, ["left"], F.col("value"), "inner").groupBy("value").agg(*[F.sum(F.log1p(-F.col(f"p{k}"))).alias(f"d{k}") for k in kinds])
        better = [F.when(F.col(f"s{k}").isNotNull() & F.col("own").isNull(), 1 - F.exp(F.coalesce(f"d{k}", F.lit(0.0)))).otherwise(F.col(f"s{k}")).alias(f"s{k}") for k in kinds]
        held.append(scores)
        scores = materialize(scores.join(doubt, "value", "left").select("value", "own", *better), "pii-scores")
    best = F.array_max(F.array(*[F.struct(F.coalesce(f"s{k}", F.lit(0.0)).alias("score"), F.lit(-k).alias("kind")) for k in kinds]))
    found = scores.filter("own is null").select("value", best.alias("b")).filter(F.col("b.score") >= settings.accept).select("value", (-F.col("b.kind")).alias("found"))
    revealed = salted_lookup(seen.filter("kind is null").drop("kind"), found, ["value"], F.col("row"), "inner")
    behind = patterns.select("left", F.explode(F.filter(F.array(*[F.when(F.col(f"p{k}").isNotNull(), k) for k in kinds]), lambda k: k.isNotNull())).alias("found"))
    remove_table(*held)
    return salted_lookup(revealed, behind, ["left", "found"], F.col("row"), "inner").select("row", F.col("found").alias("kind"), "s", "e").distinct()


def _shown(spans: Column) -> Column:
    """kind:start:end by kind and start, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda m: F.concat_ws(":", F.get(names, m["kind"]), m["s"].cast("string"), m["e"].cast("string"))), ",")


def all_spans(docs: DataFrame, *keep: str, settings: Settings = Settings()) -> DataFrame:
    """row, the kept columns, ``base`` and ``spans`` (base and discovered) of every row."""
    read = materialize(read_spans(docs, *keep), "pii-read")
    more = discover(read, settings).groupBy("row").agg(F.collect_list(F.struct("kind", "s", "e")).alias("more"))
    plain = F.transform("base", lambda m: F.struct(m["kind"].alias("kind"), m["s"].alias("s"), m["e"].alias("e")))
    joined = read.drop("others").join(more, "row", "left")
    return joined.select("row", *keep, plain.alias("base"), F.array_sort(F.concat(plain, F.coalesce("more", F.array().cast("array<struct<kind:int,s:int,e:int>>")))).alias("spans"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole document."""
    found = all_spans(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id")
    n = lambda k: F.size(F.filter("base", lambda m: m["kind"] == k)).cast("bigint").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", *[n(k) for k in range(len(KINDS))], F.sha2(_shown(F.col("base")), 256).alias("base_sha256"), _shown(F.col("spans")).alias("spans"))


def redact(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of spans that overlap the first stays, the longer first."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    ordered = F.array_sort(F.transform(spans, lambda m: F.struct(m["s"].alias("s"), (-m["e"]).alias("ne"), m["kind"].alias("kind"))))
    done = F.aggregate(
        ordered,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda acc, m: F.when(m["s"] < acc["at"], acc).otherwise(
            F.struct((-m["ne"]).alias("at"), F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, m["s"] - acc["at"]), F.get(names, m["kind"]))).alias("out"))
        ),
        lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, done).otherwise(text)


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: replace personal data in every text; every row stays.

    Base spans are replaced where the text is read. Only texts with a discovered
    identifier need the join, by a digest of the text.
    """
    keyed = docs.select(F.xxhash64("text").alias("key"), "text")
    read = materialize(read_spans(keyed, "key").filter(F.size("base") + F.size("others") > 0), "pii-read")
    key, extra = spare(docs, "key"), spare(docs, "more")
    more = discover(read).join(read.select("row", F.col("key").alias(key)), "row").groupBy(key).agg(F.collect_set(F.struct("kind", "s", "e")).alias(extra))
    joined = salted_lookup(docs.withColumn(key, F.xxhash64("text")), more, [key], F.monotonically_increasing_id())
    plain = F.transform(base_spans(F.col("text")), lambda m: F.struct(m["kind"].alias("kind"), m["s"].alias("s"), m["e"].alias("e")))
    spans = F.concat(plain, F.coalesce(extra, F.array().cast("array<struct<kind:int,s:int,e:int>>")))
    fixed = F.when(F.col("text").isNull(), F.lit(None).cast("string")).when(F.col("text").rlike("[0-9@]"), _let(spans, lambda s: redact(F.col("text"), s))).otherwise(F.col("text"))
    size = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("bigint")) if "n_chars" in docs.columns else None
    out = joined.withColumn("text", fixed)
    return (out.withColumn("n_chars", size) if size is not None else out).select(*docs.columns)
