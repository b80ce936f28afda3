"""Held-out accuracy, rejection, and what is never learned from."""

import random
import zlib

from tests.llm.conftest import DOCS, doc_rows

import corpus_pipeline
from codeloom.llm import langid

WORDS = {
    "en": "the of and to in that is with for was this from they have which water under house".split(),
    "de": "der die und das nicht ein sich mit auf für von werden über schön straße haben durch".split(),
    "fr": "le la les des est dans pour que qui une sur avec été où très après français".split(),
}


def labelled(n=400):
    rnd = random.Random(3)
    langs = list(WORDS)
    return [(i, " ".join(rnd.choices(WORDS[langs[i % 3]], k=rnd.randrange(4, 60))).capitalize() + ".", langs[i % 3], "s", 0, None, 0, "x") for i in range(n)]


def test_held_out_accuracy(spark, folder):
    rows = labelled() + [(1000, None, "en", "s", 0, None, 0, "x"), (1001, "12 !? 3", "en", "s", 0, None, 0, "x"), (None, "the water of this house", None, "s", 0, None, 0, "x")]
    out = {r.doc_id: r for r in langid.op7_language_id(spark, folder(documents=(rows, DOCS))).collect()}
    held = [r for r in rows if r[0] is not None and r[0] < 1000 and zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert all(out[r[0]].held_out for r in held) and not out[None].held_out
    assert sum(out[r[0]].lang_pred == r[2] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in out.values())
    assert (out[1000].lang_pred, out[1000].score, out[1001].lang_pred) == ("und", 0.0, "und")
    assert out[None].lang_pred == "en"


def test_held_out_labels_are_not_learned(spark, folder):
    rows = [r if zlib.crc32(str(r[0]).encode()) % 5 else (*r[:2], "xx", *r[3:]) for r in labelled()]
    assert {r.lang_pred for r in langid.op7_language_id(spark, folder(documents=(rows, DOCS))).collect()} == set(WORDS)


def test_stage_drops_rejected(spark, folder, odd_texts):
    rows = labelled() + [(2000 + r[0], *r[1:2], None, *r[3:]) for r in doc_rows(["", None, "123 456", "the water of this house"])]
    path = folder(documents=(rows, DOCS))
    docs = spark.read.parquet(f"{path}/documents.parquet")
    out = corpus_pipeline.STAGES[0][1](spark, docs, path)
    assert out.columns == docs.columns
    kept = {r.doc_id for r in out.collect()}
    assert {2000, 2001, 2002} & kept == set() and 2003 in kept and len(kept) >= 400


def test_unlearned_latin_text_is_rejected(spark, folder):
    rnd = random.Random(3)
    finnish = "tämän talon vesi on hyvin kylmää mutta aurinko lämmittää pihan kun kesäkuu alkaa ja lapset juoksevat rannalle uimaan yhdessä"
    letters = " ".join("".join(rnd.choices("abcdefghijklmnopqrstuvwxyz", k=rnd.randrange(3, 9))) for _ in range(60))
    junk = "".join(rnd.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=400))
    code = "for (int i = 0; i < n; ++i) { buf[i] = ptr->next ? malloc(sizeof(*ptr)) : NULL; } return errno;"
    dutch = "het water van dit huis is erg koud maar de zon verwarmt de tuin wanneer de zomer begint en kinderen onder de straat lopen"
    italian = "la casa della signora era molto bella e il giardino che si apre sulla strada dove giocano i bambini con le loro palle"
    swedish = "det här husets vatten är mycket kallt men solen värmer gården när sommaren börjar och barnen springer över stranden"
    rows = labelled() + [(3000 + i, t, None, "s", 0, None, 0, "x") for i, t in enumerate([finnish, letters, junk, code, dutch, italian, swedish])]
    out = {r.doc_id: r for r in langid.op7_language_id(spark, folder(documents=(rows, DOCS))).collect()}
    assert all(out[i].rejected for i in range(3000, 3007))
    held = [r for r in out.values() if r.held_out and r.doc_id is not None and r.doc_id < 3000]
    assert sum(r.rejected for r in held) <= 0.05 * len(held)


def test_nothing_labelled(spark, folder, odd_texts, empty_folder):
    assert langid.op7_language_id(spark, empty_folder).collect() == []
    rows = [(*r[:2], None, *r[3:]) for r in doc_rows(odd_texts)]
    assert {r.lang_pred for r in langid.op7_language_id(spark, folder(documents=(rows, DOCS))).collect()} == {"und"}
