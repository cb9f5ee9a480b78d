"""Page metrics as columns. Undefined is NaN."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from folimetry.operators import alignment

NAN = float("nan")
_REGISTRY: dict[str, Callable[..., dict[str, Column]]] = {}


def register_metric(name: str, build: Callable[..., dict[str, Column]]) -> None:
    """Add or replace a metric: (reference text, predicted text, **params) -> columns by key."""
    _REGISTRY[name] = build


def build_metrics(wanted: list[str | dict], reference: Column, predicted: Column) -> dict[str, Column]:
    """Columns of the named metrics, in order; unknown names are left out. An item is a name or {name, params}."""
    out: dict[str, Column] = {}
    for item in wanted:
        name, params = (item, {}) if isinstance(item, str) else (item["name"], item.get("params", {}))
        if name in _REGISTRY:
            out |= _REGISTRY[name](reference, predicted, **params)
    return out


#: Product of two lengths above which edit distance runs on bit vectors over Arrow instead of the built-in's table.
LONG_PAIR = 1 << 18


def edit_distance(left: Column, right: Column) -> Column:
    """Edit distance of two texts or of two arrays of words, of any length."""

    @F.pandas_udf("long")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        def listed(x):
            return x if isinstance(x, str) else list(x)

        return pd.Series([None if x is None or y is None else alignment.edit_distance(listed(x), listed(y)) for x, y in zip(a, b, strict=True)], dtype="Int64")

    return distance(left, right)


def cer(reference: Column, predicted: Column) -> Column:
    """Character edit distance over reference length."""
    n, m = F.char_length(reference), F.char_length(predicted)
    long = (n.cast("long") * m > LONG_PAIR) & (reference != predicted)
    far = edit_distance(F.when(long, reference), F.when(long, predicted))  # null, and free, for short pairs
    near = F.when(n == 0, NAN).when(m == 0, 1.0).when(reference == predicted, 0.0)
    return near.when(long, far / n).otherwise(F.levenshtein(reference, predicted) / n)


def wer(reference: Column, predicted: Column) -> Column:
    """Word edit distance over reference words, for arrays of words."""
    n = F.size(reference)
    return F.when(n == 0, NAN).when(F.size(predicted) == 0, 1.0).otherwise(edit_distance(reference, predicted) / n)


def overlaps(reference: Column, predicted: Column, max_n: int = 1) -> Column:
    """Of two arrays of words: how many each has, the size of the multiset intersection of their runs of 1 to max_n words,
    and how many different words both and either have. Counted in time linear in the words, over Arrow."""

    @F.pandas_udf("r long, h long, clipped array<long>, common long, either long")
    def count(left: pd.Series, right: pd.Series) -> pd.DataFrame:
        out = []
        for a, b in zip(left, right, strict=True):
            a, b = ([] if x is None else list(x) for x in (a, b))
            clipped = []
            for n in range(1, max_n + 1):
                x, y = (Counter(zip(*(w[k:] for k in range(n)), strict=False)) for w in (a, b))
                clipped.append((x & y).total())
            x, y = set(a), set(b)
            out.append((len(a), len(b), clipped, len(x & y), len(x | y)))
        return pd.DataFrame(out, columns=["r", "h", "clipped", "common", "either"])

    return count(reference, predicted)


def bag_of_words(reference: Column, predicted: Column) -> dict[str, Column]:
    """Multiset precision, recall and F1, and set Jaccard, of arrays of words."""
    found = overlaps(reference, predicted)
    r, h, both = found["r"], found["h"], found["clipped"][0]
    precision, recall = both / h, both / r
    empty_r, empty_h = r == 0, h == 0

    def cases(both_empty: float, no_reference: float, no_prediction: float, value: Column) -> Column:
        return F.when(empty_r & empty_h, both_empty).when(empty_r, no_reference).when(empty_h, no_prediction).otherwise(value)

    return {
        "bow_precision": cases(1.0, 0.0, 0.0, precision),
        "bow_recall": cases(1.0, NAN, 0.0, recall),
        "bow_f1": cases(1.0, NAN, 0.0, F.when(both == 0, 0.0).otherwise(2 * precision * recall / (precision + recall))),
        "bow_jaccard": cases(1.0, 0.0, 0.0, found["common"] / found["either"]),
    }


def bleu(reference: Column, predicted: Column, max_n: int = 4) -> Column:
    """Clipped n-gram precision with brevity penalty, for arrays of words; 0 if any precision is 0 or a side is empty."""
    found = overlaps(reference, predicted, max_n)
    r, h = found["r"], found["h"]
    precisions = [found["clipped"][n - 1] / F.greatest(h - n + 1, F.lit(1)) for n in range(1, max_n + 1)]
    some_zero = F.lit(False)
    for p in precisions:
        some_zero = some_zero | (p == 0)
    mean = sum((F.log(F.greatest(p, F.lit(1e-300))) for p in precisions), F.lit(0.0)) / max_n
    penalty = F.when(h < r, F.exp(1 - r / h)).otherwise(1.0)
    return F.when((r == 0) | (h == 0), 0.0).when(some_zero, 0.0).otherwise(penalty * F.exp(mean))
