"""Spans against plain matching; discovery and redaction."""

import hashlib
import random
import re

from tests.llm.conftest import DOCS, doc_rows

import corpus_pipeline
from codeloom.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in doubled) % 10 == 0


def base(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_base_spans(spark, folder, odd_texts):
    rnd = random.Random(5)
    parts = ["1", "2", "9", "0", "4", " ", "-", ".", "+", "@", "a", "%", "(", ")", "é", "\n", "😀", "+1 (974) 555-3436", "4111 1111 1111 1111", "10.0.0.1", "a.b@c.d.e", "256.1.1.1"]
    texts = [*odd_texts, *["".join(rnd.choices(parts, k=rnd.randrange(50))) for _ in range(800)], "1" * 20000, "a" * 20000 + "@b" + ".c" * 9000, "+1" + "-" * 20000]
    out = {r.doc_id: r for r in pii.op6_pii(spark, folder(documents=(doc_rows(texts), DOCS))).collect()}
    assert len(out) == len(texts)
    for i, text in enumerate(texts):
        want = base(text)
        shown = ",".join(f"{k}:{s}:{e}" for k, s, e in want)
        assert out[i].base_sha256 == hashlib.sha256(shown.encode()).hexdigest(), text
        assert [out[i][f"n_{k}"] for k in PATTERNS] == [sum(w[0] == k for w in want) for k in PATTERNS]
        assert set(shown.split(",")) <= set(out[i].spans.split(","))


def test_patterns_reveal_unseen_identifiers(spark, folder):
    texts = [f"Please note my phone number: +1 (974) 555-{1000 + i} thanks" for i in range(30)]
    texts += ["Please note my phone number: 974-555-9999 thanks", "the year of 1984555 was long", "version 2024100 of it"]
    out = {r.doc_id: r.spans for r in pii.op6_pii(spark, folder(documents=(doc_rows(texts), DOCS))).collect()}
    assert out[30] == f"phone:{texts[30].index('974')}:{texts[30].index(' thanks')}"
    assert out[31] == out[32] == ""


def test_recall_and_precision_of_planted_identifiers(spark, folder):
    rnd = random.Random(8)
    seeds = [f"Please call me at +49 30 {rnd.randrange(10**6, 10**7)} today" for _ in range(30)]
    unseen = [("(030) %03d %03d" if i % 2 else "030 %03d%03d") % (rnd.randrange(100, 1000), rnd.randrange(100, 1000)) for i in range(14)]
    # What the first pattern reveals carries a second one, whose own seeds are too few.
    bridge = [f"reach us under {u} always" for u in unseen] + ["reach us under 030 555777 always"]
    clean = [f"ordered in total {rnd.randrange(10**6, 10**7)} pieces" for _ in range(40)] + ["we call me at noon", "call me at x12345678 now", "me at a@b"]
    texts = [*seeds, *[f"Please call me at {u} today" for u in unseen], *bridge, *clean]
    out = {r.doc_id: r.spans for r in pii.op6_pii(spark, folder(documents=(doc_rows(texts), DOCS))).collect()}
    cut = lambda i: ["".join(texts[i][int(a) : int(b)]) for _, a, b in (x.split(":") for x in out[i].split(",") if x)]
    planted = [cut(i) for i in range(30, 44)]
    hit = sum(found == [u] or found == [u.lstrip("(")] for found, u in zip(planted, unseen, strict=True))
    wrong = sum(bool(out[i]) for i in range(59, len(texts)))
    assert hit >= 13 and hit / (hit + wrong) >= 0.9
    assert cut(58) == ["030 555777"]


def test_stage_keeps_columns_of_clashing_names(spark):
    docs = spark.createDataFrame([(1, "mail a@b.co", "k", "m", 3), (2, None, None, None, None)], "doc_id long, text string, key string, More string, n_chars long")
    out = {r.doc_id: r for r in pii.redacted(spark, docs, "").collect()}
    assert (out[1].text, out[1].key, out[1].More, out[1].n_chars, out[2].text) == ("mail [EMAIL]", "k", "m", 12, None)


def test_stage_redacts(spark, folder, odd_texts):
    texts = [*odd_texts, "mail a@b.co and 10.0.0.1 now", "4111 1111 1111 1111", "1.2.3.4@a.bc x"]
    path = folder(documents=(doc_rows(texts), DOCS))
    docs = spark.read.parquet(f"{path}/documents.parquet")
    out = corpus_pipeline.STAGES[3][1](spark, docs, path)
    assert out.columns == docs.columns
    found = {r.doc_id: r for r in out.collect()}
    n = len(odd_texts)
    assert [found[n + i].text for i in range(3)] == ["mail [EMAIL] and [IP] now", "[CARD]", "[EMAIL] x"]
    assert found[n].n_chars == len("mail [EMAIL] and [IP] now")
    assert [found[i].text for i in range(n)] == odd_texts


def test_empty(spark, empty_folder):
    assert pii.op6_pii(spark, empty_folder).collect() == []
