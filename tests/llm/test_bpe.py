"""The transducer against the public library."""

import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from codeloom.llm import bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = bpe.read_ranks(PATH)
OWN = bpe.Bpe(RANKS, public_tokenizers.PATTERN)
THEIRS = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text(alphabet="abth e\n\r\t é'sll1290 \u3000", max_size=80)))
def test_equals_the_library_and_decodes(text):
    ids = OWN.encode(text)
    assert ids == THEIRS.encode_ordinary(text)
    assert OWN.decode(ids) == text
    # Whatever the cut, the machine's state carries a character over it.
    state, out = 0, []
    for i in ids:
        found, state = OWN.decode_stream([i], state)
        out.append(found)
    assert state == 0 and "".join(out) == text


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n\té\u3000", min_size=20, max_size=200))
def test_segments_change_nothing(text):
    whole = THEIRS.encode_ordinary(text)
    before, bpe.SEGMENT = bpe.SEGMENT, 7
    try:
        assert "".join(bpe.cut_text(text)) == text
        assert OWN.encode(text) == whole
    finally:
        bpe.SEGMENT = before


@pytest.mark.parametrize("text", ["a" * 5000, "the" * 800, "é" * 999, " " * 300 + "x", "ab\n\n cd", "<|endoftext|>"])
def test_long_pieces(text):
    assert OWN.encode(text) == THEIRS.encode_ordinary(text)


def test_stores_may_be_dropped_at_any_time(monkeypatch):
    for name in ("MAX_STATES", "MAX_STORE", "MAX_PAIRS"):
        monkeypatch.setattr(bpe, name, 3)
    own = bpe.Bpe(RANKS, public_tokenizers.PATTERN)
    text = "some words, some other words, and some words again, unwontedly " * 3
    assert own.encode(text) == THEIRS.encode_ordinary(text)
    assert own.encode(text + "a" * 3000) == THEIRS.encode_ordinary(text + "a" * 3000)


def test_tokens_come_before_the_end_of_a_long_piece():
    fed = 0

    def count(data):
        nonlocal fed
        for b in data:
            fed += 1
            yield b

    class Bytes(bytes):
        def __getitem__(self, key):
            part = bytes(self)[key]
            return count(part) if isinstance(key, slice) else part

    stream = OWN.stream(Bytes(b"abcdefghij" * 400))
    next(stream)
    assert fed <= 2 * bpe.LOOKAHEAD


@given(st.binary(max_size=12))
def test_utf8_machine(data):
    state, text = bpe.utf8_feed(0, data)
    whole = data.decode("utf-8", "replace")
    assert text + "\ufffd" * (state != 0) == whole


def test_query(spark, docs_folder, odd_texts):
    out = {r.doc_id: r for r in bpe.op5_bpe(spark, docs_folder).collect()}
    assert len(out) == len(odd_texts)
    for i, text in enumerate(odd_texts):
        ids = THEIRS.encode_ordinary(text or "")
        assert out[i].n_tokens == len(ids)
        assert out[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert out[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_empty(spark, empty_folder):
    assert bpe.op5_bpe(spark, empty_folder).collect() == []
