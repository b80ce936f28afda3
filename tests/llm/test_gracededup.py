"""Groups of equal texts against SQL, recursion of buckets, and equal hashes of different texts."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from tests.llm.conftest import DOCS, doc_rows
from tests.llm.oracle import both

from codeloom.llm import gracededup


def wanted(rows):
    groups = defaultdict(list)
    for doc_id, text, *_ in rows:
        groups[text or ""].append(doc_id)
    out = []
    for ids in groups.values():
        keep = max((i for i in ids if i is not None), default=None)
        rest = ids.copy()
        rest.remove(keep)
        out += [(keep, keep, len(ids), True)] + [(i, keep, len(ids), False) for i in rest]
    return sorted(out, key=str)


def told(df):
    return sorted([(r.doc_id, r.keep_id, r.group_size, r.kept) for r in df.collect()], key=str)


def test_odd_texts_match_sql(spark, folder, odd_texts):
    rows = doc_rows([*odd_texts, *odd_texts, " one", "one "])
    got, asked = both(spark, "op11_exact_dedup", folder(documents=(rows, DOCS)), "documents")
    assert got == asked and sum(got.values()) == len(rows)


def test_repeated_rows_and_null_ids_keep_one(spark, folder):
    rows = [(i, t, "en", "s", 0, None, 0, "x") for i, t in [(7, "a"), (7, "a"), (3, "a"), (None, "a"), (None, "b"), (None, "b"), (9, None), (2, "")]]
    docs = spark.read.parquet(folder(documents=(rows, DOCS)) + "/documents.parquet")
    assert told(gracededup.exact_groups(docs)) == wanted(rows)


@pytest.mark.parametrize("hashed", ["xxhash64(text)", "shiftleft(xxhash64(text) & 3, 62)", "0L"])
def test_small_buckets_divide_and_equal_hashes_stay_apart(spark, folder, hashed):
    """Four hashes, then one, for all texts: buckets divide to their last bit and contents decide."""
    rows = doc_rows([f"text {i % 37} " + "y" * (i % 37) for i in range(400)])
    docs = spark.read.parquet(folder(documents=(rows, DOCS)) + "/documents.parquet").repartition(3)
    assert told(gracededup.exact_groups(docs, bucket_bytes=200, hashed=F.expr(hashed))) == wanted(rows)


def test_buckets_fit(spark, folder):
    rows = doc_rows([f"{i} " * 20 for i in range(500)])
    docs = spark.read.parquet(folder(documents=(rows, DOCS)) + "/documents.parquet")
    owners, total = gracededup.with_buckets(gracededup.local_classes(docs, F.xxhash64("text")), 1000)
    sizes = owners.groupBy("depth", "prefix").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    assert total == sum(r.b for r in sizes) and all(r.b <= 1000 or r.n == 1 for r in sizes) and len({r.depth for r in sizes}) > 1


def test_a_hot_text_is_one_class_a_task_with_short_lists(spark, folder, monkeypatch):
    monkeypatch.setattr(gracededup, "LIST_IDS", 10)
    rows = doc_rows(["hot"] * 95 + ["cold"])
    docs = spark.read.parquet(folder(documents=(rows, DOCS)) + "/documents.parquet").coalesce(1)
    made = gracededup.local_classes(docs, F.xxhash64("text")).collect()
    assert sum(r.text is not None for r in made) == 2 and max(len(r.ids) for r in made) == 10
    assert told(gracededup.exact_groups(docs)) == wanted(rows)


def test_tasks_write_when_they_hold_too_much(spark, folder, monkeypatch):
    monkeypatch.setattr(gracededup, "TASK_IDS", 1)
    rows = doc_rows(["a", "b", "a", None] * 300)
    docs = spark.read.parquet(folder(documents=(rows, DOCS)) + "/documents.parquet")
    assert told(gracededup.exact_groups(docs)) == wanted(rows)


def test_empty(spark, empty_folder):
    assert gracededup.op11_exact_dedup(spark, empty_folder).collect() == []
