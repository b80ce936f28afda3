"""Source divergence audit: how each source of a language differs from the language and from its other sources.

A task counts the terms of its documents by (language, source); the counts
meet in one shuffle, and a term's rows of all sources of a language, its
*postings*, in a second, which also tells whether the language keeps the term.

Terms of a group are found by upper bounds. They lie in buckets by their
count; a bucket's largest group probability and least language probability
bound every value inside. Buckets are visited in descending order of their
bounds, in doubling steps, until every unseen bound is strictly below the
group's k-th value; only visited buckets are evaluated.

Pairs come from postings: terms that both sources have are met in a join by
term, terms of one source alone by a histogram of its probabilities, terms of
neither by their number. So no source is expanded to the whole vocabulary.

All arithmetic is on integers; counts meet 10^9 as decimals of 38 digits.

Cases: null text, language and source are ''; a group without a kept term has
no ``term`` rows, and its ``pair`` rows compare the probability of a count of 0;
a language without kept terms has pairs of value 0; a source alone in its
language has no pair; equal values are ranked by the item's UTF-8; repeated
rows count again, as rows of their own; an empty table gives none; extra
columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.llm._tables import bound_batches, table
from codeloom.plans.shared import materialize

#: A run of letters or of code points beyond ASCII, as UTF-8 bytes.
TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
NOT_TERM = re.compile(rb"[^A-Za-z\x80-\xff]")
MIN_DOCS, TOP = 10, 10
SCALE = 1_000_000_000
#: Entries a task counts before it hands them on, and bytes of text read at a time.
HELD, BLOCK = 1 << 18, 1 << 20
#: Buckets a doubling of the count is divided into, and copies of a small row that a language's pairs are spread over.
FINE, SALTS = 4, 16

COUNTS = "lang string, source string, term string, n bigint, docs bigint"


def blocks(text: bytes) -> Iterator[bytes]:
    """The text in blocks that cut no term."""
    at = 0
    while len(text) - at > BLOCK:
        cut = NOT_TERM.search(text, at + BLOCK)
        end = cut.end() if cut else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def local_counts(docs: DataFrame) -> DataFrame:
    """``COUNTS`` of (lang, source, text), one row a term, group and task; the empty term stands for the group itself."""
    most = HELD

    def rows(groups: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, seen) in groups.items():
            terms = [b"", *n]
            for at in range(0, len(terms), 1 << 14):
                own = terms[at : at + (1 << 14)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(own)), pa.array([source] * len(own)), pa.array(own, pa.binary()).cast(pa.string()), pa.array([n[t] for t in own], pa.int64()), pa.array([seen[t] for t in own], pa.int64())],
                    [c.split()[0] for c in COUNTS.split(", ")],
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, held = {}, 0
        for batch in batches:
            for lang, source, text in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                n, seen = groups.setdefault((lang, source), (Counter(), Counter()))
                before, met = len(n), set()
                for block in blocks(text):
                    found = TERM.findall(block.lower())
                    n.update(found)
                    met.update(found)
                seen.update(met)
                held += len(n) - before
            if held > most:
                yield from rows(groups)
                groups, held = {}, 0
        yield from rows(groups)

    texts = [F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")]
    return docs.select(*texts, F.coalesce("text", F.lit("")).cast("binary").alias("text")).mapInArrow(run, COUNTS)


def probability(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10^9 * (n + 2) / (total + 2 * kept))."""
    top, below = (n + 2).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)"), total + 2 * kept
    # A language that keeps nothing has no term to ask for.
    return F.when(below > 0, F.call_function("div", top, below.cast("decimal(20,0)")).cast("bigint") + 1).otherwise(F.lit(1).cast("bigint"))


def divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); it grows with p and falls with q where p > q."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def postings(docs: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """(lang, source, term, n, p, q) of kept terms that occur in a group, and (lang, source, v, p0) of every group."""
    counts = materialize(local_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")), "divergence-counts")
    term = Window.partitionBy("lang", "term")
    kept = counts.filter("term <> ''").select("lang", "source", "term", "n", F.sum("n").over(term).alias("lang_n"), F.sum("docs").over(term).alias("lang_docs"))
    kept = kept.filter(F.col("lang_docs") >= min_docs).drop("lang_docs")
    kept = materialize(kept, "divergence-kept")
    of_lang = kept.groupBy("lang", "term").agg(F.max("lang_n").alias("n")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("lang_total"))
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = counts.filter("term = ''").select("lang", "source").join(of_lang, "lang", "left").join(own, ["lang", "source"], "left").na.fill(0)
    groups = materialize(groups.withColumn("p0", probability(F.lit(0).cast("bigint"), F.col("total"), F.col("v"))), "divergence-groups")
    # One row a group: joined by its size, broadcast only where Spark finds it small.
    joined = kept.join(groups, ["lang", "source"])
    found = joined.select("lang", "source", "term", "n", probability(F.col("n"), F.col("total"), F.col("v")).alias("p"), probability(F.col("lang_n"), F.col("lang_total"), F.col("v")).alias("q"))
    return materialize(found, "divergence-postings"), groups.select("lang", "source", "v", "p0")


def _others(rows: DataFrame, groups: DataFrame, spread: Column) -> DataFrame:
    """Each row with every other group of its language, a language being dealt over ``SALTS`` tasks."""
    left = rows.withColumn("salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int"))
    right = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("item_p0"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    return left.join(right, ["lang", "salt"]).filter("source <> item")


def pairs(found: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of every two sources of a language, both ways round."""
    value = lambda c: c.cast("bigint").alias("value")
    p, p0, q0 = F.col("p"), F.col("p0"), F.col("item_p0")
    neither = _others(groups, groups, F.col("source")).select("lang", "source", "item", value(F.col("v") * divergence(p0, q0)))
    # Terms of the source alone, as if the other had none of them: by probability, of which a source has few.
    histogram = found.groupBy("lang", "source", "p").agg(F.count("*").alias("m")).join(groups, ["lang", "source"])
    one = _others(histogram, groups, F.struct("source", "p")).select("lang", "source", "item", value(F.col("m") * (divergence(p, q0) - divergence(p0, q0))))
    # Terms of both: what the line above took for absent is put right.
    a = found.join(groups, ["lang", "source"]).select("lang", "term", "source", "p", "p0")
    b = a.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("item_p0"))
    q = F.col("q")
    both = a.join(b, ["lang", "term"]).filter("source < item").select("lang", "source", "item", value(divergence(p, q) - divergence(p, q0) - divergence(p0, q) + divergence(p0, q0)))
    half = lambda rows: rows.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    one, both = half(one), half(both)
    turned = lambda rows: rows.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    return half(neither.unionByName(one).unionByName(turned(one)).unionByName(both).unionByName(turned(both)))


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order))


def top_terms(found: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, source, item, value, rank) of the terms by which a group exceeds its language most."""
    spark = found.sparkSession
    group = ["lang", "source"]
    found = found.withColumn("bucket", F.floor(F.log2("n") * FINE).cast("int"))
    extremes = found.groupBy(*group, "bucket").agg(F.max("p").alias("high"), F.min("q").alias("low")).filter("high > low")
    bound = divergence(F.col("high"), F.col("low"))
    order = Window.partitionBy(*group).orderBy(F.desc("bound"), "bucket")
    buckets = materialize(extremes.select(*group, "bucket", bound.alias("bound")).withColumn("place", F.row_number().over(order)), "divergence-bounds")
    best = spark.createDataFrame([], "lang string, source string, item string, value bigint, rank int")
    seen = 0
    while True:
        kth = best.filter(F.col("rank") == top).select(*group, F.col("value").alias("kth"))
        unseen = buckets.filter(F.col("place") > seen).join(kth, group, "left").filter(F.col("kth").isNull() | (F.col("bound") >= F.col("kth")))
        now = materialize(unseen.filter(F.col("place") <= 2 * seen + 1).select(*group, "bucket"), "divergence-visit")
        if now.isEmpty():
            return best
        # Bounds fall with the place, so a group whose next bucket is too low has no later one.
        met = found.join(now, [*group, "bucket"]).filter("p > q").select(*group, F.col("term").alias("item"), divergence(F.col("p"), F.col("q")).alias("value"))
        best = materialize(_ranked(best.drop("rank").unionByName(met)).filter(F.col("rank") <= top), "divergence-best")
        seen = 2 * seen + 1


def audit(docs: DataFrame) -> DataFrame:
    """``lang, source, part, item, value, rank`` of (text, lang, source)."""
    bound_batches(docs.sparkSession)
    found, groups = postings(docs)
    part = lambda rows, name: rows.select("lang", "source", F.lit(name).alias("part"), "item", "value", "rank")
    return part(_ranked(pairs(found, groups)), "pair").unionByName(part(top_terms(found), "term"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit every source of ``documents``."""
    return audit(table(spark, sf_dir, "documents", "text", "lang", "source"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
tokens AS (SELECT lang, source, id, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
counts AS (SELECT lang, source, term, count(*) AS n FROM tokens GROUP BY ALL),
kept AS (SELECT lang, term, count(*) AS lang_n, count(*) OVER (PARTITION BY lang) AS v, sum(count(*)) OVER (PARTITION BY lang) AS lang_total FROM tokens GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
filled AS (SELECT lang, source, term, coalesce(n, 0) AS n, lang_n, lang_total, v, sum(coalesce(n, 0)) OVER (PARTITION BY lang, source) AS total
  FROM g JOIN kept USING (lang) LEFT JOIN counts USING (lang, source, term)),
p AS (SELECT lang, source, term, n, (1 + (1000000000::HUGEINT * (n + 2)) // (total + 2 * v))::BIGINT AS p, (1 + (1000000000::HUGEINT * (lang_n + 2)) // (lang_total + 2 * v))::BIGINT AS q FROM filled),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
found AS (
  SELECT lang, x.source AS source, 'pair' AS part, y.source AS item, coalesce(value, 0)::BIGINT AS value FROM g x JOIN g y USING (lang) LEFT JOIN sums s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source WHERE x.source <> y.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM found) WHERE part = 'pair' OR rank <= 10
"""
