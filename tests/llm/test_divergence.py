"""The audit against SQL, and the search by bounds against a full ranking."""

import random

from tests.llm.conftest import DOCS, doc_rows
from tests.llm.oracle import both

from codeloom.llm import divergence

WORDS = [f"w{a}{b}" for a in "abcdefgh" for b in "klmnopqrst"]


def corpus(n=300):
    rnd = random.Random(5)
    rows = []
    for i in range(n):
        source = f"s{rnd.randrange(6)}"
        words = rnd.choices(WORDS, [1 + (hash_of(w, source) % 50) for w in WORDS], k=rnd.randrange(1, 60))
        rows.append((i, " ".join(w.upper() if rnd.random() < 0.2 else w for w in words), rnd.choice(["en", "de", None]), source if rnd.random() < 0.95 else None, 0, None, 0, "x"))
    return rows


def hash_of(word, source):
    return sum(ord(c) * 31**i for i, c in enumerate(word + source))


def test_matches_sql(spark, folder, odd_texts):
    rows = corpus() + doc_rows(odd_texts) + doc_rows(["naïve 日本 Ünï x1y"] * 12, ("ja",)) + doc_rows(["", None, "12 34"], ("xx",)) + [(None, None, None, None, None, None, None, None)]
    got, asked = both(spark, "op12_source_divergence", folder(documents=(rows, DOCS)), "documents")
    assert got == asked and {k[2] for k in got} == {"pair", "term"}


def test_given_tables_match_sql(spark):
    got, asked = both(spark, "op12_source_divergence", "/root/testdata/sf0.001", "documents")
    assert got == asked


def test_bounds_find_what_a_full_ranking_finds(spark, folder):
    docs = spark.read.parquet(folder(documents=(corpus(), DOCS)) + "/documents.parquet")
    found, _ = divergence.postings(docs, 3)
    rows = {}
    for r in found.collect():
        if r.p > r.q:
            rows.setdefault((r.lang, r.source), []).append((-((r.p - r.q) ** 2 // (r.p + r.q)), r.term))
    for top in (1, 4, 1000):
        want = {(g, i + 1, t, -v) for g, own in rows.items() for i, (v, t) in enumerate(sorted(own)[:top])}
        assert {((r.lang, r.source), r.rank, r.item, r.value) for r in divergence.top_terms(found, top).collect()} == want


def test_ties_at_the_kth_place(spark):
    """Terms of one value in different buckets: the item decides, so equal bounds are not skipped."""
    rows = [("en", "s", t, n, 100, 1) for t, n in [("c", 1), ("b", 4), ("a", 64)]] + [("en", "s", "d", 9, 1, 100)]
    found = spark.createDataFrame(rows, "lang string, source string, term string, n bigint, p bigint, q bigint")
    assert [(r["rank"], r.item) for r in divergence.top_terms(found, 2).orderBy("rank").collect()] == [(1, "a"), (2, "b")]


def test_long_texts_are_read_in_blocks(monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK", 7)
    text = "naïve words, runs of letters and ünï".encode() * 9
    assert b"".join(divergence.blocks(text)) == text
    assert [t for b in divergence.blocks(text) for t in divergence.TERM.findall(b)] == divergence.TERM.findall(text)


def test_tasks_hand_on_what_they_hold(spark, folder, monkeypatch):
    path = folder(documents=(corpus(80), DOCS))
    docs = spark.read.parquet(f"{path}/documents.parquet")
    whole = sorted(divergence.audit(docs).collect())
    monkeypatch.setattr(divergence, "HELD", 5)
    assert sorted(divergence.audit(docs).collect()) == whole


def test_empty(spark, empty_folder):
    assert divergence.op12_source_divergence(spark, empty_folder).collect() == []
