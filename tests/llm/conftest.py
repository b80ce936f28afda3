"""Fixtures of the operators' tests: odd texts that every operator must take."""

from __future__ import annotations

import random

import pytest
from hypothesis import settings

# Times depend on the machine; what is tested is results.
settings.register_profile("untimed", deadline=None)
settings.load_profile("untimed")

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, n long, word string"


def doc_rows(texts, langs=("en",)):
    return [(i, t, langs[i % len(langs)], "s", len(t or ""), None, 0, "x") for i, t in enumerate(texts)]


@pytest.fixture()
def odd_texts():
    """Null, empty, blank, short, very long and repeated texts, and near copies."""
    rnd = random.Random(7)
    base = " ".join(f"w{rnd.randrange(500)}" for _ in range(120))
    near = [base.replace(f" {w} ", f" x{i} ", 1) for i, w in enumerate(base.split()[5:45:8])]
    other = " ".join(f"v{rnd.randrange(500)}" for _ in range(60))
    return [None, "", " \n\t", "one", "one two", "One  TWO", base, base, *near, other, "Ünï ß 😀 \u2028 x", "x" * 30000, ("lo ng\n" * 20000), "1 2 3 " * 300]


@pytest.fixture()
def docs_folder(folder, odd_texts):
    return folder(documents=(doc_rows(odd_texts), DOCS))


@pytest.fixture()
def empty_folder(folder):
    return folder(documents=([], DOCS), pages=([], "page_id long, url string, html string"), benchmark=([], "item_id long, text string"))
