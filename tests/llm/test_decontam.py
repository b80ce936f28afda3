"""Templates, consistency of slots, and the stage."""

import random

from pyspark.sql import functions as F
from tests.llm.conftest import DOCS, doc_rows

import corpus_pipeline
from codeloom.llm import decontam

ITEM = "A train leaves the old station at 30 km per hour while Maria walks 12 minutes to meet it. How far does Maria walk before the train passes?"
SHORT = "name the capital city"
FILL = "some words that have nothing to do with any question go here and there "


def docs(folder, texts, items=(ITEM, SHORT, None, "", "7 8 9")):
    return folder(documents=(doc_rows(texts), DOCS), benchmark=([(i, t, 1) for i, t in enumerate(items)], "item_id long, text string, h int"))


def found(spark, path):
    return {(r.doc_id, r.item_id): r for r in decontam.op10_decontaminate(spark, path).collect()}


def test_finds_copies_and_reparameterised_copies(spark, folder):
    other = ITEM.replace("30", "45").replace("12", "20").replace("Maria", "Boris")
    mixed = ITEM.replace("Maria walk before", "Boris walk before")
    clash = "while Maria walks 12 minutes to meet it"
    texts = [ITEM, FILL + other + FILL, ITEM.upper(), " ".join(w + "%%%" for w in ITEM.split()), FILL * 5, None, "", clash, FILL + ITEM + FILL + other, "Name the capital city!", "what 7 8 9 is", mixed]
    out = found(spark, docs(folder, texts))
    assert {k for k in out if k[0] not in (7, 11)} == {(0, 0), (1, 0), (2, 0), (3, 0), (8, 0), (9, 1)}
    assert not out[0, 0].reparameterised and out[1, 0].reparameterised and out[0, 0].coverage == 1.0
    # One name stands for two: the alignment is inconsistent.
    assert (11, 0) not in out


def test_template_tokens(spark):
    row = spark.createDataFrame([("Then Bob ran 3.5km in 1,200 s. Later he won A1 twice",)], "t string")
    got = row.select(decontam.valued_template(row.t)).first()[0]
    n, u, i, p = decontam.NUMBER, decontam.UNIT, decontam.INNER, decontam.NAME
    assert got == ["then", p + "bob", "ran", f"{n}3{i}5", u + "km", "in", f"{n}1{i}200", u + "s", "later", "he", "won", "a1", "twice"]


def test_stage_drops_only_what_is_found(spark, folder, odd_texts):
    path = docs(folder, [*odd_texts, ITEM, FILL + ITEM])
    table = spark.read.parquet(f"{path}/documents.parquet")
    out = corpus_pipeline.STAGES[2][1](spark, table, path)
    assert out.columns == table.columns
    assert sorted(r.doc_id for r in out.collect()) == list(range(len(odd_texts)))


def test_empty(spark, empty_folder, folder):
    assert decontam.op10_decontaminate(spark, empty_folder).collect() == []


def test_empty_documents(spark, folder):
    assert decontam.op10_decontaminate(spark, docs(folder, [])).collect() == []


def test_names_that_start_sentences_and_items_short_of_words(spark):
    items = [(1, "Tom has 5 apples. Tom buys 3 more. How many apples does Tom have?"), (2, "What is 12 + 15 * 3?"), (3, "Solve 3 x + 4 = 19")]
    docs = [
        (10, "Anna has 7 apples. Anna buys 4 more. How many apples does Anna have?"),
        (11, "Some text. What is 12 + 15 * 3? More text."),
        (12, "please solve 3 x + 4 = 19 now"),
        (13, "What is 12 + 16 * 3? Solve 3 x + 4 = 18"),
    ]
    found = decontam.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id, r.reparameterised) for r in found.collect()} == {(10, 1, True), (11, 2, False), (12, 3, False), (13, 2, True), (13, 3, True)}


def found_pairs(spark, docs, items):
    rows = decontam.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    return {(r.doc_id, r.item_id) for r in rows.collect()}


def test_a_certain_name_may_not_stand_for_two(spark):
    item = "Tom has 5 red apples and 3 pears in a bag. Tom buys some more. How many apples of Tom's are left?"
    both = item.replace("Tom", "Bob")
    mixed = item.replace("Tom has", "Bob has").replace("Tom's", "Tim's")
    assert found_pairs(spark, [(1, both), (2, mixed), (3, item)], [(1, item)]) == {(1, 1), (3, 1)}


FORMS = ["What is {a} + {b}?", "{n} ran {a} km.", "How much is {a} times {b}?", "Solve {a} x + {b} = {c}.", "{n} has {a} apples and {m} has {b} pears. How many fruits have they?", "A box of {a} kg costs {b} dollars. What do {c} boxes cost?"]
NAMES = ["Tom", "Anna", "Boris", "Maria", "Chen", "Olga", "Peter", "Ravi"]


def test_planted_items_with_other_values_are_found(spark):
    """Recall and precision of short re-parameterised items, each in a document of its own among clean ones."""
    rnd = random.Random(6)

    def fill(form):
        n, m = rnd.sample(NAMES, 2)
        return form.format(n=n, m=m, **dict(zip("abc", rnd.sample(range(2, 99), 3), strict=True)))

    items = [(i, fill(f)) for i, f in enumerate(FORMS)]
    prose = [" ".join(rnd.choice(FILL.split()) for _ in range(40)) + ". In 1990 about 12 people came and Anna saw 3 km of it. " for _ in range(20)]
    planted = [(i, prose[i % 20] + fill(FORMS[i % len(FORMS)]) + " " + prose[(i + 7) % 20]) for i in range(120)]
    clean = [(1000 + i, p + prose[(i + 3) % 20]) for i, p in enumerate(prose)]
    got = found_pairs(spark, planted + clean, items)
    right = {(i, i % len(FORMS)) for i in range(120)}
    assert len(got & right) >= 0.9 * len(right) and len(got & right) >= 0.9 * len(got)


def plain(tokens, item, size):
    """Whether a document's tokens hold an item's whole template, slots meeting one to one in value."""
    kind = lambda w: w[0] if "\ue000" <= w[0] < "\ue003" else w
    for at in range(len(tokens) - size + 1):
        own = tokens[at : at + size]
        if [kind(w) for w in own] == [kind(w) for w in item]:
            stands = {}
            if all(stands.setdefault(i, d) == d for i, d in zip(item, own, strict=True)):
                return True
    return False


def test_short_items_match_a_plain_search(spark):
    """Texts without capitals, so that templates are the same in all readings."""
    rnd = random.Random(9)
    words = ["add", "take", "of", "3", "4", "5 km", "7 kg", "what", "is"]
    items = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(3, 7)))) for i in range(25)]
    docs = [(i, " ".join(rnd.choice(words) for _ in range(60))) for i in range(25)]
    read = lambda rows: {r[0]: r[1] for r in spark.createDataFrame(rows, "i long, t string").select("i", decontam.valued_template(F.col("t"))).collect()}
    ts, ds = read(items), read(docs)
    literal = lambda w: not "\ue000" <= w[0] < "\ue003"
    want = set()
    for i, t in ts.items():
        n = sum(map(literal, t))
        if n >= min(4, len(t)) and len(t) < 8 or len(t) >= 4 and n >= 1:
            want |= {(d, i) for d, own in ds.items() if plain(own, t, len(t))}
        elif n:
            strip = lambda w: w.strip("\ue000\ue001\ue002")
            want |= {(d, i) for d, own in ds.items() if any([strip(w) for w in own[a : a + len(t)]] == [strip(w) for w in t] for a in range(len(own)))}
    assert found_pairs(spark, docs, items) == want and want
