"""Name similarity: restricted Damerau-Levenshtein with bonuses, in Arrow batches."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def osa(a: str, b: str) -> int:
    """Optimal string alignment distance: edits and swaps of neighbours, no part edited twice."""
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            least = min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                least = min(least, before[j - 2] + 1)
            row.append(least)
        before, last = last, row
    return last[-1]


def name_words(name: str) -> list[str]:
    """Lower-case words of a camelCase or separated name, of two characters at least."""
    return [w for w in re.split(r"[\s_\-.:/\\]+", re.sub(r"([a-z0-9])([A-Z])", r"\1 \2", name).lower()) if len(w) > 1]


def score(source: str, target: str) -> float:
    """0 to 1: one less the relative distance, plus 0.25, 0.3 and 0.35 for a common prefix, containment and words."""
    a, b = source.lower(), target.lower()
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    short, long = sorted((a, b), key=len)
    total = 1.0 - osa(a, b) / len(long)
    if long.startswith(short):
        total += 0.25 * len(short) / len(long)
    if short in long:
        total += 0.3 * len(short) / len(long)
    mine, theirs = name_words(source), name_words(target)
    if mine and theirs:
        total += 0.35 * sum(any(w in t or t in w for t in theirs) for w in mine) / len({*mine, *theirs})
    return min(1.0, max(0.0, total))


@F.pandas_udf(DoubleType())
def similarity(source: pd.Series, target: pd.Series) -> pd.Series:
    """:func:`score` of two columns; a null on either side is 0."""
    return pd.Series([0.0 if a is None or b is None else score(a, b) for a, b in zip(source, target, strict=True)])
