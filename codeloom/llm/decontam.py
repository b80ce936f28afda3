"""Benchmark decontamination by template windows.

A text becomes a template: numbers, names and units turn into typed
placeholders that remember their value, all else into lower-case words. Windows
of ``Settings.window`` template tokens of documents and benchmark items meet by
hash. On each alignment of a document with an item the slots must be
consistent: equal values in the item have equal values in the document. An item
is found in a document when enough of its windows meet consistently, so a
question with other numbers or names is found too.

A capital inside a sentence makes a name. At the start of a sentence it may be
one: windows that hold such a word come twice, with the word and with a name.

A window needs ``Settings.literals`` tokens that are no placeholder. An item of
fewer tokens than a window is one window of its own length. An item without a
window of enough literals is one template as a whole, when it has from
``short_tokens`` to ``short_most`` tokens and one of them is a literal: its
slots must then meet in number, type and order. Any other is found where all
its tokens stand, values included.

Cases: null and empty texts, and items without a single word, have no windows
and find nothing; an item that occurs several times in a text counts
once; equal items are each found; repeated rows each give their rows; an empty
table on either side gives none; extra columns are ignored. Everything runs as
DataFrame expressions.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm._tables import spare, table
from codeloom.plans.shared import materialize
from codeloom.plans.skew import salted_lookup

#: Placeholders, from the private use area; a text's own are taken out first.
NAME, NUMBER, UNIT, INNER = "\ue000", "\ue001", "\ue002", "\ue003"
#: Marks a word that may be a name, since it starts a sentence with a capital.
START = "\ue004"
#: Units of measure and money, in lower case.
UNITS = "mm cm dm m km in ft yd mi mg g kg t lb lbs oz ml cl l gal ms s sec min h hr hrs hours minutes seconds days weeks months years meters metres kilometers kilometres miles feet inches grams kilograms pounds liters litres percent degrees dollars cents euros usd eur gbp kb mb gb tb hz khz mhz ghz w kw kwh v mph kmh".split()
#: Bits of a window filter, at most 128 KB of the plan, and probes of each window. Beyond some 100,000 distinct windows
#: more others pass, which costs their join and no result.
LEAST_BITS, MOST_BITS, PROBES = 1 << 12, 1 << 20, 3


@dataclass(frozen=True)
class Settings:
    """What counts as found."""

    window: int = 8
    literals: int = 4
    #: Tokens of an item that is one template whole.
    short_tokens: int = 4
    short_most: int = 16
    #: The part of an item's windows that must meet.
    coverage: float = 0.3


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, evaluated once a row however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def valued_template(text: Column, names: bool = True, starts: bool = False) -> Column:
    """The template tokens of a text, each placeholder followed by its value; without ``names`` these stay words, with ``starts`` possible names are marked."""
    step = lambda t, pattern, to: F.regexp_replace(t, F.lit(pattern), F.lit(to))
    # Marks that stand in or between words say nothing of where a sentence starts.
    t = step(text, r"[^\p{L}\p{N}\s.,:;!?/-]+", " ")
    # Each pattern asks first for what is rare, so that most places fail at their first character.
    t = step(t, r"[.,:/-](?=[0-9])(?<=[0-9].)", INNER)
    number = rf"(?=[0-9])(?<![\p{{L}}\p{{N}}{INNER}])([0-9][0-9{INNER}]*)"
    t = step(t, rf"{number}\s{{0,4}}(?:((?i:{'|'.join(sorted(UNITS, key=len, reverse=True))}))(?![\p{{L}}\p{{N}}]))", f"{NUMBER}$1 {UNIT}$2")
    t = step(t, rf"{number.replace(INNER, NUMBER + INNER, 1)}(?![\p{{L}}\p{{N}}])", f"{NUMBER}$1")
    capital = r"(?=\p{Lu}\p{Ll})"
    if names:
        t = step(t, rf"{capital}(?<=[^\s.!?:]\s{{1,3}})", NAME)
    if starts:
        t = step(t, rf"{capital}(?:^|(?<=[\s.!?:]))", START)
    return F.filter(F.split(F.lower(t), rf"[^\p{{L}}\p{{N}}{NAME}-{START}]+"), lambda w: w != "")


def _is_slot(w: Column) -> Column:
    return (w >= F.lit(NAME)) & (w < F.lit(INNER))


def _plain(w: Column) -> Column:
    """A marked word as a word."""
    return F.when(w.startswith(START), F.substring(w, 2, 1 << 30)).otherwise(w)


def _named(w: Column) -> Column:
    """A marked word as a name."""
    return F.when(w.startswith(START), F.concat(F.lit(NAME), F.substring(w, 2, 1 << 30))).otherwise(w)


def _exact(w: Column) -> Column:
    """A token as it is, without what kind it has."""
    return F.translate(w, NAME + NUMBER + UNIT + START, "")


def _template_hash(token: Column, marked: Column) -> Column:
    """Hash of a template token, without its value; that of a marked word is ``marked``."""
    return F.when(token.startswith(START), marked).when(_is_slot(token), F.xxhash64(F.substring(token, 1, 1))).otherwise(F.xxhash64(token))


#: How the tokens of a text are read, and the hash of each: marked words as words, as names, and all tokens literally.
READINGS: dict[str, tuple[Callable[[Column], Column], Callable[[Column], Column]]] = {
    "plain": (_plain, lambda w: _template_hash(w, F.xxhash64(F.substring(w, 2, 1 << 30)))),
    "named": (_named, lambda w: _template_hash(w, F.xxhash64(F.lit(NAME)))),
    "exact": (_exact, lambda w: F.xxhash64(_exact(w))),
}


def _window_hash(hashes: list[Column], exact: bool) -> Column:
    """Hash of a window's token hashes; windows of literal tokens are told apart."""
    return F.xxhash64(F.lit("="), *hashes) if exact else F.xxhash64(*hashes)


def _bits(h: Column, bits: int) -> list[Column]:
    """The places in the filter of a window's hash."""
    return [(F.shiftrightunsigned(h, 20 * p) if p else h).bitwiseAND(F.lit(bits - 1)) for p in range(PROBES)]


class Sieve:
    """A test that every hash of ``hashes`` (h) passes, and few others; its size is bounded."""

    def __init__(self, hashes: DataFrame, distinct: int):
        self.bits = LEAST_BITS
        while self.bits < min(MOST_BITS, 24 * distinct):
            self.bits *= 2
        places = hashes.select(F.explode(F.array(*_bits(F.col("h"), self.bits))).alias("at"))
        words = places.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits"))
        found = [0] * (self.bits // 64)
        for r in words.collect():
            found[r["word"]] = r["bits"]
        self.held = F.from_json(F.lit(json.dumps(found)), "array<bigint>")

    def passes(self, h: Column, held: Column | None = None) -> Column:
        """Whether a hash passes; ``held`` is :attr:`held` where that is bound to a variable."""
        held = self.held if held is None else held
        tests = [F.getbit(F.get(held, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63)).cast("int")) == 1 for at in _bits(h, self.bits)]
        both = tests[0]
        for t in tests[1:]:
            both = both & t
        return both


def _ends(first: Column, last: Column) -> Column:
    """One number of the first and last token hash of a window, which a filter tests before the window's hash is made."""
    return first.bitwiseXOR(F.shiftrightunsigned(last, 7))


def _windows(marked: Column, size: int, reading: str, keep: tuple[Callable[[Column], Column], Callable[[Column], Column]] | None = None) -> Column:
    """Windows (pos, h, slots, loose, ends) of ``size`` tokens whose ends and hash ``keep`` passes; as names, only those that hold a marked word."""
    read, token_hash = READINGS[reading]

    def of(hashes: Column) -> Column:
        # The hash of an array is that of its elements; a slice for each place would cost far more.
        h = lambda i: _window_hash([F.get(hashes, i + k) for k in range(size)], reading == "exact")
        # Null where fewer tokens follow.
        ends = F.transform(hashes, lambda x, i: _ends(x, F.get(hashes, i + (size - 1))))
        at = F.transform(ends, lambda e, i: F.when(e.isNotNull() if keep is None else keep[0](e), i))
        at = F.filter(at, lambda i: i.isNotNull() if keep is None else i.isNotNull() & keep[1](h(i)))
        if reading == "named":
            at = F.filter(at, lambda i: F.exists(F.slice(marked, i + 1, size), lambda w: w.startswith(START)))
        slots = lambda i: F.transform(F.slice(marked, i + 1, size), read)
        return F.transform(at, lambda i: F.struct(i.alias("pos"), h(i).alias("h"), slots(i).alias("slots"), F.lit(reading == "named").alias("loose"), _ends(F.get(hashes, i), F.get(hashes, i + (size - 1))).alias("ends")))

    return let(F.transform(marked, token_hash), of)


def item_windows(items: DataFrame, settings: Settings) -> DataFrame:
    """item_row, item_id, ipos, size, h, islots, exact, iloose, n_windows, ends of every benchmark item (item_id, text).

    Each item has its windows thrice where it has names: with those inside
    sentences as placeholders, with those at their starts as well, and as words
    for documents whose spelling does not show names.
    """
    numbered = items.filter("text is not null").select(F.monotonically_increasing_id().alias("item_row"), "item_id", "text")
    # Written at each step: many branches read the same few rows, and the driver holds every branch's plan.
    marked = materialize(numbered.select("item_row", "item_id", valued_template(F.col("text"), starts=True).alias("marked"), valued_template(F.col("text"), names=False).alias("worded")), "decontam-marked")
    named = F.exists("marked", lambda w: w.startswith(START))
    variants = ((F.col("marked"), "plain", F.lit(True)), (F.col("marked"), "named", named), (F.col("worded"), "plain", F.lit(True)))
    sized = lambda v, when: marked.withColumn("v", v).filter(when).withColumn("size", F.least(F.size("v"), F.lit(settings.window))).filter("size > 0")

    def windows(v: Column, reading: str, when: Column) -> DataFrame:
        rows, loose = sized(v, when), F.lit(reading == "named").alias("loose")
        long = rows.filter(F.col("size") == settings.window).select("item_row", "item_id", "size", F.inline(_windows(F.col("v"), settings.window, reading)))
        # A short item's one window is the whole item.
        hashes = F.transform("v", READINGS[reading][1])
        whole, ends = _window_hash([hashes], reading == "exact"), _ends(F.element_at(hashes, 1), F.element_at(hashes, -1))
        short = rows.filter(F.col("size") < settings.window).select("item_row", "item_id", "size", F.lit(0).alias("pos"), whole.alias("h"), F.transform("v", READINGS[reading][0]).alias("slots"), loose, ends.alias("ends"))
        return long.unionByName(short)

    def wholes(v: Column, reading: str, when: Column) -> DataFrame:
        rows = marked.withColumn("v", v).filter(when).withColumn("size", F.size("v")).filter(F.col("size").between(settings.short_tokens, settings.short_most))
        hashes = F.transform("v", READINGS[reading][1])
        return rows.select("item_row", "item_id", "size", F.lit(0).alias("pos"), _window_hash([hashes], False).alias("h"), F.transform("v", READINGS[reading][0]).alias("slots"), F.lit(reading == "named").alias("loose"), _ends(F.element_at(hashes, 1), F.element_at(hashes, -1)).alias("ends"))

    literal = F.size(F.filter("slots", lambda w: ~_is_slot(w)))
    several = [windows(*v) for v in variants]
    kept = several[0].unionByName(several[1]).unionByName(several[2]).filter(literal >= F.least(F.lit(settings.literals), F.col("size")))
    kept = materialize(kept.groupBy("item_row", "pos", "h").agg(*[F.min(c).alias(c) for c in ("item_id", "loose", "size", "slots", "ends")]).withColumn("exact", F.lit(False)), "decontam-windows")
    # Items without such a window, whole.
    short = [wholes(*v).join(kept.select("item_row").distinct(), "item_row", "left_anti") for v in variants]
    short = short[0].unionByName(short[1]).unionByName(short[2]).filter(literal >= 1)
    short = short.groupBy("item_row", "pos", "h").agg(*[F.min(c).alias(c) for c in ("item_id", "loose", "size", "slots", "ends")]).withColumn("exact", F.lit(False))
    kept = materialize(kept.unionByName(short), "decontam-windows")
    worded = F.exists("marked", lambda w: ~_is_slot(w))
    bare = windows(F.col("marked"), "exact", worded).join(kept.select("item_row").distinct(), "item_row", "left_anti")
    kept = materialize(kept.unionByName(bare.withColumn("exact", F.lit(True))), "decontam-windows")
    totals = kept.groupBy("item_row").agg(F.countDistinct("pos").alias("n_windows"))
    # Names that a capital inside a sentence makes certain.
    sure = marked.select("item_row", F.array_distinct(F.filter("marked", lambda w: w.startswith(NAME))).alias("sure"))
    return kept.join(totals, "item_row").join(sure, "item_row").select("item_row", "item_id", F.col("pos").alias("ipos"), "size", "h", F.col("slots").alias("islots"), "exact", F.col("loose").alias("iloose"), "n_windows", "ends", "sure")


def find(docs: DataFrame, items: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Rows (row, doc_id, item_id, n_matched, n_windows, coverage, reparameterised) of documents in which an item is found.

    ``docs`` has doc_id and text; ``row`` tells rows with equal ids apart.
    """
    wanted = materialize(item_windows(items, settings), "decontam-items")
    asked = sorted((r["exact"], r["size"]) for r in wanted.select("exact", "size").distinct().collect())
    if not asked:
        return docs.sparkSession.createDataFrame([], "row bigint, doc_id bigint, item_id bigint, n_matched bigint, n_windows bigint, coverage double, reparameterised boolean")
    distinct = wanted.select("h").distinct().count()
    ends, whole = Sieve(wanted.select(F.col("ends").alias("h")), distinct), Sieve(wanted.select("h"), distinct)
    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"))

    def windows(marked: Column) -> Column:
        def sifted(e: Column, w: Column) -> Column:
            keep = (lambda h: ends.passes(h, e), lambda h: whole.passes(h, w))
            return F.concat(*[_windows(marked, size, reading, keep) for exact, size in asked for reading in (("exact",) if exact else ("plain", "named"))])

        return let(ends.held, lambda e: let(whole.held, lambda w: sifted(e, w)))

    near = let(valued_template(F.col("text"), starts=True), windows)
    # Only windows that pass the filter leave the scan.
    met = rows.filter("text is not null").select("row", "doc_id", F.inline(near)).drop("ends")
    pairs = salted_lookup(met, wanted.drop("ends"), ["h"], F.col("row"), "inner", hint="merge").filter(F.size("slots") == F.size("islots"))
    # Two branches read the pairs; written once, they cost one scan of the texts.
    pairs = materialize(pairs.withColumn("shift", F.col("pos") - F.col("ipos")), "decontam-pairs")
    # What starts a sentence may be no name, so its clash spares the windows that do without it; a certain name's clash spares none.
    certain = F.when(F.col("loose") | F.col("iloose"), F.array(F.lit(True))).otherwise(F.array(F.lit(False), F.lit(True)))
    pairs = pairs.withColumn("broad", F.explode(certain))
    slots = pairs.select(
        "row", "item_row", "shift", "broad", "sure", F.explode(F.filter(F.arrays_zip("islots", "slots"), lambda s: _is_slot(s["islots"]))).alias("s")
    ).groupBy("row", "item_row", "shift", "broad", F.col("s.islots").alias("own")).agg(F.min("s.slots").alias("a"), F.max("s.slots").alias("b"), F.max(F.array_contains("sure", F.col("s.islots"))).alias("certain"))
    alignments = slots.groupBy("row", "item_row", "shift", "broad").agg(F.max(F.col("a") != F.col("b")).alias("clash"), F.max(F.col("a") != F.col("own")).alias("changed"), F.max(F.col("certain") & (F.col("a") != F.col("b"))).alias("veto"))
    vetoes = alignments.filter("broad and veto").select("row", "item_row", "shift")
    matched = pairs.groupBy("row", "doc_id", "item_row", "item_id", "exact", "n_windows", "shift", "broad").agg(F.collect_set("ipos").alias("at"))
    fits = matched.join(alignments, ["row", "item_row", "shift", "broad"], "left").filter(~F.coalesce("clash", F.lit(False))).join(vetoes, ["row", "item_row", "shift"], "left_anti")
    # Exact items have all their windows on one alignment.
    union, best = F.size(F.array_distinct(F.flatten(F.collect_list("at")))), F.max(F.size("at"))
    found = fits.groupBy("row", "doc_id", "item_row", "item_id", "exact", "n_windows").agg(
        F.when(F.col("exact"), best).otherwise(union).cast("bigint").alias("n_matched"), F.max(F.coalesce("changed", F.lit(False))).alias("reparameterised")
    )
    cover = F.col("n_matched") / F.col("n_windows")
    return found.filter(cover >= F.when(F.col("exact"), F.lit(1.0)).otherwise(F.lit(settings.coverage))).select("row", "doc_id", "item_id", "n_matched", "n_windows", cover.alias("coverage"), "reparameterised")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item found in a document."""
    return find(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text")).drop("row")


def kept_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: drop the documents in which a benchmark item is found.

    Rows are told apart by a digest of their text, which decides alone, so equal
    texts share their fate whatever their ids.
    """
    keyed = docs.select(F.xxhash64("text").alias("doc_id"), "text")
    key = spare(docs, "text_key")
    found = find(keyed, table(spark, sf_dir, "benchmark", "item_id", "text")).select(F.col("doc_id").alias(key)).distinct()
    return docs.withColumn(key, F.xxhash64("text")).join(found, key, "left_anti").select(*docs.columns)
