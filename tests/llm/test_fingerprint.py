"""Order, equality, increments and likeness of fingerprints."""

import hashlib

import numpy as np
from tests.llm.conftest import DOCS, doc_rows

from codeloom.llm import fingerprint as fp


def test_paragraph_order_does_not_count_and_increments_do():
    a, b, c = fp.fingerprints(["one two three\nfour\n\nfive six", "five six\n\none two three\nfour", "one two three\nfour\n"])
    assert (a == b).all() and not (a == c).all()
    assert (fp.delete(a, "five six") == c).all() and (fp.insert(c, "five six") == a).all()
    assert not fp.fingerprints([""])[0].any()
    assert (fp.delete(fp.insert(a, "x"), "x") == a).all()


def test_blocks_change_nothing(monkeypatch):
    texts = ["line of some words\n" * 40, "", "other words here now\nand there"]
    whole = fp.fingerprints(texts)
    monkeypatch.setattr(fp, "BLOCK", 50)
    assert (fp.fingerprints(texts) == whole).all()


def test_edits(spark, docs_folder, odd_texts):
    out = {r.doc_id: r for r in fp.op4_fingerprint(spark, docs_folder).collect()}
    order = sorted(range(len(odd_texts)), reverse=True)
    for k, i in enumerate(order):
        text, after = odd_texts[i] or "", odd_texts[order[(k + 1) % len(order)]] or ""
        half = len(text) // 2
        new = text[: len(text) - half] + after[:half]
        r = out[i]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest()
        want = fp.fingerprints([text, new, after])
        assert r.fingerprint == fp.shown(want[0]) and r.edited_fingerprint == fp.shown(want[1])
        assert np.allclose([r.near_edited, r.near_next], [*fp.likeness(want[:1], want[1:2]), *fp.likeness(want[:1], want[2:])])


def test_order_holds_over_many_buckets(spark, folder):
    ids = [i * i % 1009 for i in range(300)] + [None]
    rows = [(d, f"text number {d}", "en", "s", 0, None, 0, "x") for d in sorted({i for i in ids if i is not None})] + [(None, "none", "en", "s", 0, None, 0, "x")]
    out = {r.doc_id: r.edited_sha256 for r in fp.op4_fingerprint(spark, folder(documents=(rows, DOCS))).collect()}
    order = sorted((r for r in rows if r[0] is not None), reverse=True) + rows[-1:]
    for k, r in enumerate(order):
        assert out[r[0]] == hashlib.sha256(fp.edited(r[1], order[(k + 1) % len(order)][1]).encode()).hexdigest()


def test_one_row_and_none(spark, folder, empty_folder):
    assert fp.op4_fingerprint(spark, empty_folder).collect() == []
    out = fp.op4_fingerprint(spark, folder(documents=(doc_rows(["ab cd"]), DOCS))).collect()
    assert len(out) == 1 and out[0].edited_sha256 == hashlib.sha256(b"ab ab").hexdigest()
