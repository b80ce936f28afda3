"""Language identification by nearest TF-IDF centroid.

A text is a vector of hashed byte trigrams of its lower-cased letters, weighted
by TF-IDF and normalised. Each language has several centroids, from spherical
k-means over labelled texts, and a text takes the language of the centroid
nearest by cosine. It is rejected when that cosine is below what all but a few
labelled texts of its length reach with centroids that have not seen them: half
of the sample is held against the other half, whole and by its beginnings.

The classifier is fitted on a bounded sample of labelled rows
(``Settings.sample_rows``, spread evenly over the languages, chosen by a hash of
the id); prediction reads every row's whole text.

Cases: a null text, or one without a letter, is ``und`` with score 0 and
rejected; without any labelled row so is every text; a null id is never
learned from and never held out; ties go to the language first in code point
order; repeated rows each give a row; an empty table gives none; extra columns
are ignored.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm._tables import bound_batches, remainder5, table

UNKNOWN = "und"
LETTER = regex.compile(r"\p{L}")
#: ASCII that is no letter reads as a space.
_FOLD = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))


@dataclass(frozen=True)
class Settings:
    """Bounds and sizes of the classifier."""

    dims: int = 1 << 14
    centroids: int = 3
    rounds: int = 8
    #: Labelled rows that the classifier is fitted on, over all languages.
    sample_rows: int = 2400
    #: Languages learned, the most frequent first; a documented bound of the sample, as each has 20 rows at least.
    max_languages: int = 1000
    #: The part of unseen labelled texts of a length that would be rejected.
    usual: float = 0.005


def counts(text: str, dims: int) -> np.ndarray:
    """Counts of the hashed byte trigrams of a whole text."""
    data = np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(_FOLD) + b" ", np.uint8).astype(np.uint32)
    grams = data[:-2] << np.uint32(16) | data[1:-1] << np.uint32(8) | data[2:]
    grams = grams[grams != 0x202020]
    return np.bincount((grams * np.uint32(2654435761)) >> np.uint32(32 - dims.bit_length() + 1), minlength=dims)


@dataclass
class Model:
    """Languages, their centroids (rows of a matrix) and the usual cosines by length."""

    languages: list[str]
    owner: np.ndarray
    centroids: np.ndarray
    idf: np.ndarray
    floor: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float], list[bool]]:
        """Language, score and rejection of each text."""
        names, scores, rejected = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
        own = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if self.languages else []
        for at in range(0, len(own), 64):
            part = own[at : at + 64]
            tf = np.stack([counts(texts[i], len(self.idf)) for i in part]).astype(np.float32)
            cosines = _vectors(tf, self.idf) @ self.centroids.T
            best = cosines.argmax(1)
            sizes = tf.sum(1)
            for i, b, c, n in zip(part, best, cosines.max(1), sizes, strict=True):
                names[i], scores[i] = self.languages[self.owner[b]], float(min(max(c, 0.0), 1.0))
                rejected[i] = bool(c < self.floor[_length(n)])
        return names, scores, rejected


def _length(n: float) -> int:
    return int(min(np.log2(n + 1), 31))


def _vectors(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    weighted = np.log1p(tf)
    weighted *= idf
    weighted /= np.maximum(np.sqrt(np.einsum("ij,ij->i", weighted, weighted))[:, None], 1e-12)
    return weighted


def _means(rows: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Spherical k-means from farthest-first starts; no randomness."""
    first = rows.mean(0)
    chosen = [int((rows @ first).argmax())]
    while len(chosen) < min(k, len(rows)):
        chosen.append(int((rows @ rows[chosen].T).max(1).argmin()))
    centres = rows[chosen]
    for _ in range(rounds):
        nearest = (rows @ centres.T).argmax(1)
        sums = np.stack([rows[nearest == j].sum(0) if (nearest == j).any() else centres[j] for j in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    whole = first / max(float(np.linalg.norm(first)), 1e-12)
    return np.vstack([whole[None], centres])


def fit(labelled: DataFrame, settings: Settings = Settings()) -> Model:
    """Fit on a bounded sample of ``labelled`` (doc_id, text, lang, all non-null)."""
    bound_batches(labelled.sparkSession)
    sizes = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(settings.max_languages).collect()
    dims = settings.dims
    if not sizes:
        return Model([], np.empty(0, int), np.empty((0, dims), np.float32), np.ones(dims, np.float32), np.zeros(32))
    each = max(20, settings.sample_rows // len(sizes))
    part = F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(min(1.0, each / r["count"])))])
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / F.lit(1 << 20)
    sample = labelled.filter(draw < F.try_element_at(part, F.col("lang"))).select("lang", "text")

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                fold = zlib.crc32(text.encode("utf-8", "replace")) & 1
                # The whole text, and its beginnings of 8, 16, 32 ... letters.
                for stop in [len(text), *(1 << k for k in range(3, 31) if 1 << k < len(text))]:
                    found = counts(text[:stop], dims)
                    kept = np.flatnonzero(found)
                    made.append((lang, fold, stop == len(text), kept.astype(np.uint16).tobytes(), found[kept].astype(np.uint32).tobytes()))
            columns = list(zip(*made, strict=True)) if made else [()] * 5
            types = [pa.string(), pa.int32(), pa.bool_(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["lang", "fold", "whole", "at", "n"])

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = fit_rows([r for batch in batches for r in batch.to_pylist()], settings)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    # The sample is bounded, so one task can hold it; the driver gets the model alone.
    drawn = sample.mapInArrow(sparse, "lang string, fold int, whole boolean, at binary, n binary").repartition(1)
    return pickle.loads(drawn.mapInArrow(fitted, "model binary").toArrow().column(0)[0].as_py())


def fit_rows(every: list[dict], settings: Settings) -> Model:
    """Fit on sparse counts of texts and their beginnings."""
    dims = settings.dims
    rows = sorted((r for r in every if r["whole"]), key=lambda r: (r["lang"], r["at"], r["n"]))
    seen = np.zeros(dims)
    for r in rows:
        seen[np.frombuffer(r["at"], np.uint16)] += 1
    idf = (np.log((1 + len(rows)) / (1 + seen)) + 1).astype(np.float32)
    languages = sorted({r["lang"] for r in rows})
    if not rows:
        return Model([], np.empty(0, int), np.empty((0, dims), np.float32), np.ones(dims, np.float32), np.zeros(32))

    def dense(part: list[dict]) -> np.ndarray:
        tf = np.zeros((len(part), dims), np.float32)
        for i, r in enumerate(part):
            tf[i, np.frombuffer(r["at"], np.uint16)] = np.frombuffer(r["n"], np.uint32)
        return tf

    # One language at a time is dense: some 40 MB for 600 texts.
    def centroids(part: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        by = {g: [r for r in part if r["lang"] == g] for g in languages}
        centres = {g: _means(_vectors(dense(own), idf), settings.centroids, settings.rounds) for g, own in by.items() if own}
        return np.repeat([languages.index(g) for g in centres], [len(c) for c in centres.values()]), np.vstack(list(centres.values())).astype(np.float32)

    owner, centres = centroids(rows)
    nearest, lengths = [], []
    for fold in (0, 1):
        other = [r for r in rows if r["fold"] != fold]
        known = {r["lang"] for r in other}
        unseen = [r for r in every if r["fold"] == fold and r["lang"] in known]
        if unseen:
            apart = centroids(other)[1]
        for at in range(0, len(unseen), 64):
            tf = dense(unseen[at : at + 64])
            nearest += (_vectors(tf, idf) @ apart.T).max(1).tolist()
            lengths += [_length(n) for n in tf.sum(1)]
    return Model(languages, owner, centres, idf, _floor(np.array(nearest), np.array(lengths), settings.usual))


def _floor(nearest: np.ndarray, lengths: np.ndarray, usual: float) -> np.ndarray:
    """The limit by length. Longer texts than were seen have the limit of the longest: cosines grow with the length."""
    floor = np.zeros(32)
    for at in range(32):
        near = nearest[lengths == at]
        floor[at] = float(np.quantile(near, usual)) if len(near) >= 20 else floor[at - 1] if at else 0.0
    return floor


def learnable(docs: DataFrame) -> Column:
    """The rows that a classifier may learn from."""
    return remainder5().isNotNull() & (remainder5() != 0) & F.col("text").isNotNull() & F.col("lang").isNotNull()


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and rejected of every row of (doc_id, text)."""
    bound_batches(docs.sparkSession)
    # A few MB: languages and dims are bounded by the settings.
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores, rejected = shared.value.predict(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, lang_pred string, score double, rejected boolean")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predict every document's language, learning from those whose remainder is not 0."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = fit(docs.filter(learnable(docs)))
    return predict(docs, model).withColumn("held_out", F.coalesce(remainder5() == 0, F.lit(False)))


def kept_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: drop what the classifier rejects; it learns from the stage's own labelled rows.

    Rows keep their columns; the decision is made in the pass that reads the
    text, so nothing is shuffled.
    """
    bound_batches(spark)
    own = docs.select("doc_id", "text", "lang")
    shared = spark.sparkContext.broadcast(fit(own.filter(learnable(own))))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rejected = shared.value.predict(batch.column(at).to_pylist())[2]
            yield batch.filter(pa.array([not r for r in rejected], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
