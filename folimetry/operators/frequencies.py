"""How frequent words are in a corpus, and a compact table of the frequent ones for use inside tasks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base-10 logarithm of occurrences in a billion words, from which a word counts as one.
LEAST = 2.5
_EDGES = r"^\P{L}+|\P{L}+$"
_SPARK_SEED = 42


def bare(token: Column) -> Column:
    """Lower case, without what isn't a letter at either end."""
    return F.lower(F.regexp_replace(token, _EDGES, ""))


def word_frequencies(texts: DataFrame, text: str = "text") -> DataFrame:
    """(word, n, level) of all words of the texts: runs between white space in their bare form, how often they occur, and the
    logarithm of that in a billion. Null and empty texts have none. Counts are merged before they are shuffled."""
    counted = texts.select(F.explode(F.split(F.col(text), r"\s+")).alias("token")).select(bare(F.col("token")).alias("word")).filter("word <> ''").groupBy("word").agg(F.count("*").alias("n"))
    total = counted.agg(F.sum("n")).scalar()
    return counted.select("word", "n", F.log10(F.col("n") / total * 1e9).alias("level"))


class KnownWords:
    """Whether a token is among the words of a table: a binary search in sorted hashes. At most 10**(9 - level) words can be
    as frequent as `level` says (3.2 million at 2.5: 25 MB), however large the corpus; equal hashes of other words, some one
    in 10**12, are taken for them."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = np.sort(hashes)

    def __call__(self, token: str) -> bool:
        import xxhash

        letters = [i for i, c in enumerate(token) if c.isalpha()]
        low = token[letters[0] : letters[-1] + 1].lower() if letters else ""
        if not low or not len(self.hashes):
            return False
        code = np.uint64(xxhash.xxh64_intdigest(low.encode(), seed=_SPARK_SEED)).astype(np.int64)
        at = int(np.searchsorted(self.hashes, code))
        return at < len(self.hashes) and self.hashes[at] == code


def known_words(frequencies: DataFrame, level: float = LEAST) -> KnownWords:
    """The words of word_frequencies() that are at least so frequent. The level bounds what reaches the driver."""
    if level < LEAST:
        raise ValueError(f"a level below {LEAST} doesn't bound the table")
    found = frequencies.filter(F.col("level") >= level).select(F.xxhash64("word").alias("h")).toArrow()
    return KnownWords(found["h"].to_numpy())
