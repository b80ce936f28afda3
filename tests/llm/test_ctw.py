"""The base against plain counting; the tree against a sequential one."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from tests.llm.conftest import DOCS, doc_rows

from codeloom.llm import ctw

EDGES = b"\xff" * ctw.DEPTH
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(LOWER)), None]


@pytest.mark.parametrize("often", [ctw.FREQUENT, 4])
def test_base_score(spark, docs_folder, odd_texts, monkeypatch, often):
    monkeypatch.setattr(ctw, "FREQUENT", often)
    out = {r.doc_id: r for r in ctw.op9_lm_score(spark, docs_folder).collect()}
    train = Counter(t for i, text in enumerate(odd_texts) if zlib.crc32(str(i).encode()) % 5 != 1 for t in tokens(text))
    total, kinds = sum(train.values()), len(train)
    for i, text in enumerate(odd_texts):
        own = tokens(text)
        base = sum(math.log10((train[t] + 0.5) / (total + 0.5 * (kinds + 1))) for t in own)
        r = out[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(own), sum(train[t] > 0 for t in own), total, zlib.crc32(str(i).encode()) % 5 == 1)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0


def kt(a, b):
    return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - 2 * math.lgamma(0.5)


def plain_probability(texts, context, byte):
    """P(byte | context) of the tree by recursion over sparse counts."""
    counts = Counter()
    for t in texts:
        data = EDGES + t + b"\xff"
        for i in range(ctw.DEPTH, len(data)):
            for d in range(ctw.DEPTH + 1):
                for bit in range(8):
                    counts[data[i - d : i], 1 << bit | data[i] >> (8 - bit), data[i] >> (7 - bit) & 1] += 1
    seen = {c for c, _, _ in counts}

    def weighted(c, node):
        own = kt(counts[c, node, 0], counts[c, node, 1])
        if len(c) == ctw.DEPTH:
            return own, own
        below = sum(weighted(bytes([b]) + c, node)[1] for b in range(256) if bytes([b]) + c in seen)
        return below, math.log(0.5) + max(own, below) + math.log1p(math.exp(-abs(own - below)))

    total = 1.0
    for bit in range(8):
        node, want = 1 << bit | byte >> (8 - bit), byte >> (7 - bit) & 1
        p = 0.5
        for d in range(ctw.DEPTH, -1, -1):
            c = context[ctw.DEPTH - d :]
            zeros, ones = counts[c, node, 0], counts[c, node, 1]
            own = (ones + 0.5) / (zeros + ones + 1)
            if d == ctw.DEPTH:
                p = own
            else:
                stop = 1 / (1 + math.exp(weighted(c, node)[0] - kt(zeros, ones))) if c in seen else 0.5
                p = stop * own + (1 - stop) * p
        total *= p if want else 1 - p
    return total


def test_tree_equals_a_plain_one(spark):
    texts = [b"abracadabra", b"abra", b"", "é ".encode()]
    docs = spark.createDataFrame([(t.decode(),) for t in texts], "text string")
    model = ctw.fit(ctw.count_keys(docs).filter("kind = 1").select("key", "n"))
    for context, byte in [("racab", "r"), ("aabra", "c"), ("xxabr", "a"), ("xcada", "b"), ("xxdab", "z"), ("xxxra", "c"), ("xxxya", "b"), ("vwxyz", "b"), (EDGES, "a"), ("cadab", "r"), ("dabra", "\xff")]:
        data = context.encode() if isinstance(context, str) else context
        gram = np.array([int.from_bytes(data, "big") << 8 | ord(byte)], np.uint64)
        got = model.table[model.find(model.index(), gram)[0], ord(byte)]
        assert got == pytest.approx(math.log10(plain_probability(texts, data, ord(byte))), abs=1e-5), context
    assert np.allclose((10.0 ** model.table.astype(float)).sum(1), 1, atol=1e-4)


def test_score_is_the_sum_over_bytes(spark, folder, monkeypatch):
    rnd = random.Random(1)
    texts = ["".join(rnd.choices("ab c", k=rnd.randrange(40))) for _ in range(40)]
    path = folder(documents=(doc_rows(texts), DOCS))
    whole = {r.doc_id: r.score for r in ctw.op9_lm_score(spark, path).collect()}
    docs = spark.createDataFrame([(t,) for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 5 != 1], "text string")
    model = ctw.fit(ctw.count_keys(docs).filter("kind = 1").select("key", "n"))
    index = model.index()
    for i, t in enumerate(texts):
        data = np.frombuffer(EDGES + t.encode() + b"\xff", np.uint8)
        found = ctw.grams(data)
        want = model.table[model.find(index, found), data[ctw.DEPTH :]].astype(float).sum()
        assert whole[i] == pytest.approx(want, rel=1e-6)


@pytest.mark.parametrize("most", [0, 3, 40])
def test_a_bounded_tree_is_a_distribution(spark, monkeypatch, most):
    monkeypatch.setattr(ctw, "MAX_CONTEXTS", most)
    docs = spark.createDataFrame([("abracadabra abra cadabra",), ("abrab",)], "text string")
    model = ctw.fit(ctw.count_keys(docs).filter("kind = 1").select("key", "n"))
    assert sum(len(k) for k in model.kept) <= most
    assert np.allclose((10.0 ** model.table.astype(float)).sum(1), 1, atol=1e-4)


@pytest.mark.parametrize("part_bytes", [ctw.PART_BYTES, 300, 1])
def test_no_context_is_dropped(spark, folder, monkeypatch, part_bytes):
    """With a small bound some buckets are divided, or all into as many parts as there may be."""
    monkeypatch.setattr(ctw, "PART_BYTES", part_bytes)
    rnd = random.Random(5)
    texts = ["".join(rnd.choices("abcd e", k=60)) for _ in range(60)]
    docs = spark.createDataFrame([(t,) for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 5 != 1], "text string")
    model = ctw.fit(ctw.count_keys(docs).filter("kind = 1").select("key", "n"))
    index = model.index()
    monkeypatch.setattr(ctw, "MAX_CONTEXTS", 3)
    monkeypatch.setattr(ctw, "CHUNK", 700)
    monkeypatch.setattr(ctw, "BLOCK", 50)
    for r in ctw.op9_lm_score(spark, folder(documents=(doc_rows(texts), DOCS))).collect():
        data = np.frombuffer(EDGES + texts[r.doc_id].encode() + b"\xff", np.uint8)
        want = model.table[model.find(index, ctw.grams(data)), data[ctw.DEPTH :]].astype(float).sum()
        assert r.score == pytest.approx(want, rel=1e-5)


def test_empty(spark, empty_folder):
    assert ctw.op9_lm_score(spark, empty_folder).collect() == []
