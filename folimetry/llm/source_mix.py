"""Mixing sources to target weights by fitting word budgets.

Sizes are counted for all documents. A source's target is met with whole passes over it plus a rest below one pass. For
the rest, its documents are counted by exact length; a proportional share of each length is taken first, then a
bounded-knapsack dynamic programme over the lengths left over fills what remains to the word, where that is possible.
Which documents of a length are taken is decided by a seeded hash, whose cut is found through bucket counts, so that
no task has to rank all documents of a length.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folimetry.llm.scratch import WORD, by_name, by_place, free_name, numbered, written

WEIGHTS = (5.0, 2.0, 1.0)
MOST_PASSES = 3
SEED = 20240607
#: The dynamic programme's first capacity in words; where it misses the budget by more than must be, it grows up to the budget.
KNAPSACK_WORDS = 1 << 16
#: Documents of one length that a task ranks together.
BUCKET_ROWS = 256
#: Sources and counted lengths up to which the plan is broadcast (some 100 bytes each); beyond, the joins shuffle.
BROADCAST_ROWS = 200_000


def targets(totals: list[tuple[str | None, int]], weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, cap: int = MOST_PASSES) -> dict:
    """Words each source should give. Weights repeat over the sources by code point, null last; no target is above
    `cap` times its source: the excess is shared again by weight among the others until none is above."""
    order = sorted(totals, key=lambda t: (t[0] is None, (t[0] or "").encode("utf-8", "surrogatepass")))
    weight = {s: weights[i % len(weights)] for i, (s, _) in enumerate(order)}
    words, fixed = dict(order), {}
    budget = share * sum(words.values())
    while open_ := [s for s, _ in order if s not in fixed]:
        left, whole = budget - sum(fixed.values()), sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / whole > cap * words[s]]
        if not over:
            return fixed | {s: left * weight[s] / whole for s in open_}
        fixed |= {s: float(cap * words[s]) for s in over}
    return fixed


def _best_sum(size: np.ndarray, free: np.ndarray, rest: int) -> np.ndarray:
    """How many of each length, at most `free`, make the largest sum that is not above `rest`: bounded subset sums as a bit
    set, counts split into powers of two, and for each sum the step that reached it first."""
    reach, mask, steps, first = 1, (1 << (rest + 1)) - 1, [], np.full(rest + 1, -1, np.int32)
    for i in np.flatnonzero(size > 0).tolist():
        many, part = min(int(free[i]), rest // int(size[i])), 1
        while many > 0 and not reach >> rest & 1:
            n = min(part, many)
            new = reach << n * int(size[i]) & mask & ~reach
            if new:
                bits = np.unpackbits(np.frombuffer(new.to_bytes(rest // 8 + 1, "little"), np.uint8), bitorder="little")
                first[np.flatnonzero(bits)] = len(steps)
                steps.append((i, n))
                reach |= new
            many, part = many - n, part * 2
    taken, at = np.zeros(len(size), np.int64), reach.bit_length() - 1
    while at:
        i, n = steps[first[at]]
        taken[i] += n
        at -= n * int(size[i])
    return taken


def fit_lengths(lengths: np.ndarray, counts: np.ndarray, budget: int, capacity: int = KNAPSACK_WORDS) -> np.ndarray:
    """How many documents of each length to take so that their words come nearest to `budget` from below.

    A share of every length is taken in proportion, the longest lengths left over lower the rest to `capacity`, and a
    bounded subset sum fills it. A result is nearest for certain if it misses the budget by less than the lengths' greatest
    common divisor. While it misses by more, the capacity grows; at the budget itself nothing is taken beforehand, and the
    subset sum is over all documents. Its memory is 4 bytes a word of the capacity.
    """
    order = np.argsort(lengths, kind="stable")
    size, count = lengths[order].astype(np.int64), counts[order].astype(np.int64)
    whole = int((size * count).sum())
    if budget >= whole:
        return counts.astype(np.int64)
    step = int(np.gcd.reduce(size))
    while True:
        taken = np.zeros(len(size), np.int64)
        if capacity < budget:
            taken = np.array([int(c) * budget // whole for c in count], np.int64)
            taken[size == 0] = 0
        rest = budget - int((size * taken).sum())
        for i in range(len(size) - 1, -1, -1):
            if rest <= capacity:
                break
            if size[i]:
                more = int(min(count[i] - taken[i], (rest - capacity) // size[i]))
                taken[i] += more
                rest -= more * int(size[i])
        taken += _best_sum(size, count - taken, rest)
        if budget - int((size * taken).sum()) < step or capacity >= budget:
            break
        capacity *= 16
    out = np.empty(len(size), np.int64)
    out[order] = taken
    return out


def _source_key(source: Column) -> Column:
    """Null apart from every text."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def _spread(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("row_id"))


def mix_levels(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, cap: int = MOST_PASSES, seed: int = SEED,
) -> DataFrame:
    """For each source_key and size of docs(row_id, doc_id, source_key, source, size): source_size, target, passes (how often
    each document is taken at least), and which are taken once more: none (more = 0), all (more = docs), or those up to
    (cut, cut_row) in order of their spread. A row a source and size."""
    spark = docs.sparkSession
    per_length = written(docs.groupBy("source_key", "source", "size").agg(F.count("*").alias("docs")), rows=docs.count())
    n = per_length.count()
    totals = per_length.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).alias("words")).collect()  # a row a source
    wanted = targets([(r.source, r.words) for r in totals], weights, share, cap)
    words = {r.source: r.words for r in totals}
    schema = "source_key string, source_no int, source_size long, target double, passes int, rest long"
    rows = [(_key(s), i, *_passes(words[s], t, cap)) for i, (s, t) in enumerate(wanted.items())]
    plan = spark.createDataFrame(rows, schema)
    plan = F.broadcast(plan) if len(rows) <= BROADCAST_ROWS else plan

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        more = fit_lengths(pdf["size"].to_numpy(), pdf["docs"].to_numpy(), int(pdf["rest"].iloc[0]))
        return pdf.assign(more=more)[["source_no", "size", "docs", "more"]]

    budgets = per_length.join(plan, "source_key").select("source_no", "size", "docs", "rest")
    fitted = written(budgets.groupBy("source_no").applyInPandas(fit, "source_no int, size long, docs long, more long"))
    split = fitted.filter("more > 0 and more < docs")
    split = F.broadcast(split) if split.count() <= BROADCAST_ROWS else split.hint("merge")
    parts = F.greatest(F.lit(1), F.ceil(F.col("docs") / BUCKET_ROWS))
    keyed = (
        docs.join(plan, "source_key").select("row_id", "doc_id", "source_no", "size").join(split, ["source_no", "size"]).withColumn("spread", _spread(seed))
        .withColumn("bucket", F.floor((F.shiftright("spread", 11).cast("double") / float(1 << 53) + 0.5) * parts).cast("long"))
    )
    group = ["source_no", "size"]
    in_buckets = keyed.groupBy(*group, "more", "bucket").agg(F.count("*").alias("here"))
    upto = F.sum("here").over(Window.partitionBy(*group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    at_cut = in_buckets.withColumn("upto", upto).filter("upto >= more and upto - here < more").select(*group, "bucket", (F.col("more") - F.col("upto") + F.col("here")).alias("nth"))
    at_cut = written(at_cut, rows=n)
    at_cut = F.broadcast(at_cut) if at_cut.count() <= BROADCAST_ROWS else at_cut.hint("merge")
    rank = F.row_number().over(Window.partitionBy(*group).orderBy("spread", "row_id"))
    cuts = keyed.join(at_cut, [*group, "bucket"]).withColumn("rank", rank).filter("rank = nth").select(*group, F.col("spread").alias("cut"), F.col("row_id").alias("cut_row"))
    return written(fitted.join(cuts, group, "left").join(plan, "source_no").select("source_key", "size", "source_size", "target", "passes", "docs", "more", "cut", "cut_row"), rows=n)


def _times() -> Column:
    """How often a row is taken that meets its level."""
    before = (F.col("spread") < F.col("cut")) | ((F.col("spread") == F.col("cut")) & (F.col("row_id") <= F.col("cut_row")))
    return F.col("passes") + F.when(F.col("more") >= F.col("docs"), 1).when(F.col("more") == 0, 0).otherwise(before.cast("int"))


def _met(docs: DataFrame, levels: DataFrame, seed: int) -> DataFrame:
    """docs(row_id, doc_id, source_key, size) with their level and `times`; levels are broadcast up to BROADCAST_ROWS."""
    known = F.broadcast(levels) if levels.count() <= BROADCAST_ROWS else levels.hint("merge")
    return docs.join(known, ["source_key", "size"]).withColumn("spread", _spread(seed)).withColumn("times", _times())


def mix_counts(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, cap: int = MOST_PASSES, seed: int = SEED,
) -> DataFrame:
    """Every document's row_id (as given), doc_id, size, source_size, target, times (how often the mix takes it) and taken.

    `docs` has row_id, doc_id, source and size; row ids are all different and stay when the table is read again, and which
    documents of a length are taken depends on them, doc_id and the seed alone. Documents without words count 0 and are
    taken as often as whole passes go over their source. A source without words has target 0. Repeated rows are documents
    of their own, as are rows without doc_id; ties of the hash are broken by row_id. Sizes are of whole texts, whatever
    their length. An empty table gives an empty result. The driver holds one row a source, a task one source's lengths.
    """
    docs = docs.select("row_id", "doc_id", _source_key(F.col("source")).alias("source_key"), "source", "size")
    met = _met(docs.drop("source"), mix_levels(docs, weights, share, cap, seed), seed)
    return met.select("row_id", "doc_id", "size", "source_size", "target", "times", (F.col("size") * F.col("times")).alias("taken"))


def _key(source: str | None) -> str:
    return "n" if source is None else "s" + source


def _passes(words: int, target: float, cap: int) -> tuple:
    whole = round(target)
    passes = min(cap, whole // words) if words else 0
    rest = whole - passes * words if passes < cap else 0
    return (int(words), float(target), int(passes), int(rest))


def _size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sized(docs: DataFrame, row: str | None = None) -> DataFrame:
    """row_id, doc_id, source and size (words in the whole text; null: 0) of docs, written once. `row` names a column with
    row numbers that stay; without it rows are numbered here."""
    rows = docs.select("doc_id", "source", "text", F.col(row).alias("row_id")) if row else numbered(docs.select("doc_id", "source", "text"), "row_id")
    return written(rows.select("row_id", "doc_id", "source", _size(F.col("text")).alias("size")))


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_counts(sized(spark.read.parquet(f"{sf_dir}/documents.parquet"))).drop("row_id")


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: each document, with its columns, repeated as often as the mix takes it.

    Null and blank texts count no words. Null sources are a source of their own; repeated rows are documents of their own.
    Other columns may have any names; an empty table gives an empty result. Texts meet the levels, which are few, where
    they are read; they are neither shuffled nor joined by row.
    """
    names, row = docs.columns, free_name(docs, "__row")
    rows = numbered(docs, row)
    counted = sized(rows, row)
    levels = mix_levels(counted.select("row_id", "doc_id", _source_key(F.col("source")).alias("source_key"), "source", "size"))
    own = {"row_id": F.col(row), "doc_id": F.col("doc_id"), "source_key": _source_key(F.col("source")), "size": _size(F.col("text"))}
    met = _met(by_place(rows, *(c.alias(n) for n, c in own.items())), levels, SEED)
    return by_name(met.filter("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))), names)
