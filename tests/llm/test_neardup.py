"""Shingle components against brute force."""

import random
import re

import pytest
from tests.llm.conftest import DOCS, doc_rows

import corpus_pipeline
from codeloom.llm import neardup
from codeloom.operators import components as cc
from codeloom.plans import shared

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingles(text, size):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(LOWER))
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)} if len(words) >= size else ({tuple(words)} if words else set())


def components(rows, size, percent):
    """Least id reachable by links, pair by pair."""
    sets = [shingles(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted((doc_id, len(sets[i]), least[find(i)]) for i, (doc_id, _) in enumerate(rows))


def corpus(seed):
    """Groups of near copies around the threshold, chains, shared passages and short texts."""
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(300)]
    passage = rnd.choices(words, k=25)
    texts = []
    for _ in range(8):
        base = rnd.choices(words, k=rnd.choice([6, 20, 60, 150]))
        texts.append(base)
        last = base
        for _ in range(rnd.randrange(12)):
            new = list(rnd.choice([base, last]))
            for _ in range(rnd.randrange(1 + len(new) // 25)):
                new[rnd.randrange(len(new))] = f"x{rnd.randrange(10**6)}"
            last = new
            texts.append(new)
    texts += [rnd.choices(words, k=rnd.randrange(1, 9)) + passage for _ in range(20)]
    texts += [rnd.choices(words[:4], k=rnd.randrange(1, 6)) for _ in range(30)]
    rnd.shuffle(texts)
    return [(i * 3 + 1, " ".join(t)) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("seed", "size", "percent"), [(1, 4, 85), (2, 4, 85), (3, 5, 80), (4, 2, 50)])
def test_components(spark, seed, size, percent):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = neardup.near_duplicates(docs, neardup.Settings(size, percent, cost=1))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out.collect()) == components(rows, size, percent)


@pytest.mark.parametrize(("seed", "size", "percent", "members"), [(1, 4, 85, 512), (2, 4, 85, 3), (4, 2, 50, 4)])
def test_every_link_is_counted(spark, monkeypatch, seed, size, percent, members):
    monkeypatch.setattr(neardup, "MEMBERS", members)
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: frozenset(shingles(t, size)) for i, t in rows}
    want = {i: sum(100 * len(a & b) >= percent * len(a | b) for b in set(sets.values()) if b and b != a) if a else 0 for i, a in sets.items()}
    out = neardup.near_duplicates(docs, neardup.Settings(size, percent, cost=1))
    assert {r.doc_id: r.n_links for r in out.collect()} == want and max(want.values()) > 2


def test_odd_texts(spark, docs_folder, odd_texts):
    out = neardup.op2_ngram_join(spark, docs_folder).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in out) == components(list(enumerate(odd_texts)), 4, 85)


def test_repeated_and_null_ids(spark, folder):
    rows = [(5, "a b c d e"), (5, "a b c d e"), (None, "a b c d e"), (None, "q r s t"), (7, None), (7, None)]
    out = neardup.op2_ngram_join(spark, folder(documents=(rows, "doc_id long, text string"))).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in out) == [(-1, 1, -1), (-1, 2, 5), (5, 2, 5), (5, 2, 5), (7, 0, 7), (7, 0, 7)]


def test_plans_stay_small(spark, monkeypatch):
    """No step's plan repeats the steps before it: plans are what the driver's memory holds."""
    plans = {}

    def planned(df, name, *rest):
        tree = df._jdf.queryExecution().executedPlan().toString()
        plans[name] = max(plans.get(name, 0), sum("Exchange" in line and "Reused" not in line for line in tree.splitlines()))
        return shared.materialize(df, name, *rest)

    monkeypatch.setattr(neardup, "materialize", planned)
    monkeypatch.setattr(cc, "materialize", planned)
    docs = spark.createDataFrame(corpus(2), "doc_id long, text string")
    out = neardup.near_duplicates(docs, neardup.Settings(4, 85, cost=1))
    planned(out, "result").collect()
    assert {"nd-links", "cc", "nd-lookup"} < set(plans) and max(plans.values()) <= 16, plans


def test_overlap_is_least():
    for n in range(1, 60):
        for m in range(1, 60):
            least = neardup.overlap(n, m, 85)
            assert 100 * least >= 85 * (n + m - least) and 100 * (least - 1) < 85 * (n + m - least + 1)


def test_stage_keeps_one_of_each_group(spark, folder, odd_texts):
    rows = doc_rows([*odd_texts, odd_texts[6]]) + doc_rows(odd_texts)[6:7]
    path = folder(documents=(rows, DOCS))
    docs = spark.read.parquet(f"{path}/documents.parquet")
    out = corpus_pipeline.STAGES[1][1](spark, docs, path)
    assert out.columns == docs.columns
    kept = [r.doc_id for r in out.collect()]
    plain = {least for _, n, least in components([(r[0], r[1]) for r in rows], 5, 80)}
    assert sorted(kept) == sorted(plain)


def test_empty(spark, empty_folder):
    assert neardup.op2_ngram_join(spark, empty_folder).collect() == []
