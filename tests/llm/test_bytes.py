"""Word hashing against a plain split."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given
from hypothesis import strategies as st

from codeloom.llm import _bytes

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def plain(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(LOWER))


@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB é\t\n\x0b😀c", max_size=30)), max_size=8))
def test_words_equal_exactly_when_plain_words_do(texts):
    hashes, bounds = _bytes.words(*_bytes.utf8(pa.array(texts, pa.string())))
    words = [w for t in texts for w in plain(t)]
    assert [int(x) for x in np.diff(bounds)] == [len(plain(t)) for t in texts]
    names = dict(zip(hashes.tolist(), words, strict=True))
    assert [names[h] for h in hashes.tolist()] == words and len(set(hashes.tolist())) == len(set(words))


def test_blocks_change_nothing(monkeypatch):
    texts = ["alpha beta " * 50, "x" * 300, " gamma\n" * 9, "", "delta"]
    whole = _bytes.words(*_bytes.utf8(pa.array(texts)))
    monkeypatch.setattr(_bytes, "BLOCK", 37)
    cut = _bytes.words(*_bytes.utf8(pa.array(texts)))
    assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()


def test_windows_keep_order():
    h = np.array([1, 2, 3, 1, 2, 3, 2, 1], np.uint64)
    w = _bytes.windows(h, 3)
    assert w[0] == w[3] and len(set(w.tolist())) == 5 and len(_bytes.windows(h[:2], 3)) == 0
