"""Where a name is declared: imports and re-exports followed from file to file.

Every asked name moves over the imports that mention it, all at once, a level a
round. Ways are told apart by the places of their imports; the first way in the
order of a depth-first walk wins, so a name stops as soon as no open way comes
before what it has found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.plans.shared import materialize

#: Files on a way, the asking one included.
LONGEST = 5


def words_of(imports: DataFrame) -> DataFrame:
    """``imports`` (src, dst, place, statement, target) as (src, dst, place, word): names in the statement and parts of the target, in lower case."""
    names = F.regexp_extract_all(F.lower(F.coalesce("statement", F.lit(""))), F.lit(r"[\w$]+"), F.lit(0))
    parts = F.split(F.lower(F.regexp_replace(F.coalesce("target", F.lit("")), r"\.[A-Za-z]+\z", "")), r"[/\\.]+")
    return imports.select("src", "dst", "place", F.explode(F.array_distinct(F.concat(names, parts))).alias("word")).filter("word <> ''")


def _short(word: Column) -> Column:
    return F.regexp_replace(word, r"controller\z", "")


def _stems(word: str) -> Column:
    """A row for each stem that meets ``word``: itself, and what is left without a final controller."""
    return F.explode(F.array_distinct(F.array(word, _short(F.col(word))))).alias("stem")


def chase(asks: DataFrame, words: DataFrame, declared: DataFrame, longest: int = LONGEST) -> DataFrame:
    """(ask, file, symbol, hops) of each of ``asks`` (ask, file, name): the first file on its way that declares the name; none when no way does.

    ``words`` has src, dst, place and word, so a barrel with many exports meets
    only those that are asked for; ``declared`` file and name, of which the
    last part counts. Case is ignored, and so is a final ``controller``. A way
    never visits a file twice and is at most ``longest`` files long.
    """
    # A name and its word with or without a final controller have one stem, so an import is met by stem, once for each file it leads to.
    own = words.filter("word <> ''").select(F.col("src").alias("node"), F.col("dst").alias("next"), "place", _stems("word"))
    least = own.groupBy("node", "next", "stem").agg(F.min("place").cast("bigint").alias("place"))
    # What the file at its end declares is told there once, not anew for each way and round.
    last = declared.select(F.col("file").alias("next"), F.lower(F.element_at(F.split("name", r"::|\.|#|\\"), -1)).alias("word"), F.col("name").alias("symbol")).filter("word is not null")
    ends = last.select("next", "word", "symbol", _stems("word")).groupBy("next", "stem")
    told = ends.agg(F.min(F.when(F.col("word") == F.col("stem"), F.col("symbol"))).alias("plain"), F.min(F.when(F.col("word") != F.col("stem"), F.col("symbol"))).alias("full"))
    # Asks, imports and declarations grow together and their files are small, so no side is broadcast by its size on disk.
    steps = materialize(least.join(told.hint("merge"), ["next", "stem"], "left"), "reexports")
    name, path = F.lower("name"), F.array().cast("array<bigint>")
    frontier = asks.select("ask", F.col("file").alias("node"), _short(name).alias("stem"), (_short(name) != name).alias("long"), path.alias("way"), F.array("file").alias("visited"))
    hits = None
    for hop in range(1, longest):
        met = frontier.join(steps.hint("merge"), ["node", "stem"]).filter(~F.array_contains("visited", F.col("next")))
        symbol = F.when(F.col("long"), F.coalesce("full", "plain")).otherwise(F.col("plain"))
        met = met.select("ask", "next", "stem", "long", F.concat("way", F.array("place")).alias("way"), "visited", symbol.alias("symbol"))
        if hop + 1 == longest:
            met = met.filter("symbol is not null").drop("stem", "long", "visited")
        ways = materialize(met, "chase")
        new = ways.filter("symbol is not null").select("ask", "way", F.col("next").alias("file"), "symbol", F.lit(hop).alias("hops"))
        hits = new if hits is None else hits.unionByName(new)
        if hop + 1 == longest or ways.filter("symbol is null").isEmpty():
            break
        best = hits.groupBy("ask").agg(F.min("way").alias("best"))
        open_ = ways.filter("symbol is null").join(best.hint("merge"), "ask", "left").filter(F.col("best").isNull() | (F.col("way") < F.col("best")))
        frontier = open_.select("ask", F.col("next").alias("node"), "stem", "long", "way", F.concat("visited", F.array("next")).alias("visited"))
    return hits.groupBy("ask").agg(F.min(F.struct("way", "file", "symbol", "hops")).alias("hit")).select("ask", "hit.file", "hit.symbol", "hit.hops")
