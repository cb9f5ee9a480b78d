"""Summaries over runs and pages. Undefined scores are null or NaN and count nowhere."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

RESAMPLES, SEED, CONFIDENCE = 10_000, 42, 0.95
#: Numbers drawn at once.
CHUNK = 4_000_000


def defined(score: Column) -> Column:
    return F.when(~F.isnan(score), score)


def mean_or_nan(score: Column) -> Column:
    """Mean of the defined scores; NaN if there are none."""
    return F.coalesce(F.avg(defined(score)), F.lit(float("nan")))


def run_means(scores: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    return scores.groupBy(*keys).agg(mean_or_nan(F.col(score)).alias("mean"), F.count("*").alias("pages"))


def summary_columns(value: Column) -> list[Column]:
    """mean, std, median, min, max and n; zeros over nothing, and no spread of one value."""
    x = defined(value)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return [
        zero(F.avg(x)).alias("mean"), zero(F.stddev_samp(x)).alias("std"), zero(F.median(x)).alias("median"), zero(F.min(x)).alias("min"), zero(F.max(x)).alias("max"), F.count(x).alias("n"),
    ]


def resampled_means(values: np.ndarray, statistic: str = "mean") -> np.ndarray:
    """The statistic of each resample; rows are drawn in chunks, in the order one draw of all would give."""
    rng, n, out = np.random.default_rng(SEED), len(values), []
    rows = max(1, CHUNK // max(n, 1))
    for a in range(0, RESAMPLES, rows):
        drawn = values[rng.integers(0, n, size=(min(rows, RESAMPLES - a), n))]
        out.append(drawn.mean(axis=1) if statistic == "mean" else np.median(drawn, axis=1))
    return np.concatenate(out)


def interval(values: np.ndarray, confidence: float = CONFIDENCE, statistic: str = "mean") -> tuple[float, float]:
    """Percentile bootstrap interval; of one value itself, of none zeros."""
    if len(values) < 2:
        value = float(values[0]) if len(values) else 0.0
        return value, value
    low, high = np.percentile(resampled_means(values, statistic), [50 * (1 - confidence), 50 * (1 + confidence)])
    return float(low), float(high)


def paired_p(a: np.ndarray, b: np.ndarray) -> float:
    """Two-sided paired bootstrap: how often centred differences have a mean as large as the observed one."""
    if len(a) != len(b):
        raise ValueError("paired values differ in number")
    gap = a - b
    seen = abs(np.mean(a) - np.mean(b))
    return float(np.mean(np.abs(resampled_means(gap - gap.mean())) >= seen))


def bootstrap(df: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """Interval of the mean of each group of runs; values in the given order, which the drawn numbers follow."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        values = pdf[value].dropna().to_numpy(float)
        low, high = interval(values)
        return pd.DataFrame([[*pdf[keys].iloc[0], low, high, len(values)]], columns=[*keys, "ci_lower", "ci_upper", "n"])

    schema = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.select(*dict.fromkeys([*keys, value, *order])).groupBy(*keys).applyInPandas(run, f"{schema}, ci_lower double, ci_upper double, n long")


def _poisson_means(df: DataFrame, keys: list[str], value: str, row: str, resamples: int) -> DataFrame:
    """(keys, draw, mean, times) of Poisson resamples: how often a value is drawn in each follows from its row number alone,
    so that tasks add up sums and counts of `resamples` draws and nothing else."""
    names = [f.name for f in df.select(*keys).schema]

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            pdf = pdf[pdf["__x"].notna()]
            for a in range(0, len(pdf), 1024):
                part = pdf.iloc[a : a + 1024]
                x = part["__x"].to_numpy(float)
                times = np.stack([np.random.default_rng([SEED, int(r) & (2**63 - 1)]).poisson(1.0, resamples) for r in part["__row"]])
                for key, at in part.groupby(names, dropna=False).indices.items():
                    sums = held.setdefault(key if isinstance(key, tuple) else (key,), np.zeros((2, resamples)))
                    sums += np.stack([x[at] @ times[at], times[at].sum(axis=0)])
        for key, (total, n) in held.items():
            yield pd.DataFrame({**{k: [v] * resamples for k, v in zip(names, key, strict=True)}, "draw": range(resamples), "total": total, "times": n})

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)
    rows = df.select(*keys, F.col(value).cast("double").alias("__x"), F.col(row).cast("long").alias("__row"))
    drawn = rows.mapInPandas(draw, f"{kinds}, draw int, total double, times double").groupBy(*keys, "draw").agg((F.sum("total") / F.sum("times")).alias("mean"), F.sum("times").alias("times"))
    return drawn.filter("times > 0")


def bootstrap_merged(df: DataFrame, keys: list[str], value: str, row: str, resamples: int = 1000, confidence: float = CONFIDENCE) -> DataFrame:
    """Interval of the mean of groups too large for one task, by Poisson resampling. Not the draws of bootstrap(); the
    intervals agree as the groups grow. Resamples without a draw are left out."""
    low, high = 0.5 - confidence / 2, 0.5 + confidence / 2
    return _poisson_means(df, keys, value, row, resamples).groupBy(*keys).agg(F.percentile("mean", F.lit(low)).alias("ci_lower"), F.percentile("mean", F.lit(high)).alias("ci_upper"))


#: Bins between a group's least and largest value, in which values of known rank are looked for first.
BINS = 4096


def _met(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Rows of equal keys, where null equals null, with the keys once."""
    named = right.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), *(c for c in right.columns if c not in keys))
    same = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)))
    return left.join(named, same, how).drop(*(f"__k{i}" for i in range(len(keys))))


def values_at(df: DataFrame, keys: list[str], value: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """(keys, n, and a column for each of `ranks`): the values that come at these places, from 1, when a group's defined values
    are sorted. Each rank is a function of the number of values, which it is kept within; groups of none have nulls.

    No group meets in one task: values are counted by bin, then the distinct values of the bins that the places fall in.
    """
    x = df.select(*keys, defined(F.col(value).cast("double")).alias("__x"))
    sizes = x.groupBy(*keys).agg(F.count("__x").alias("n"), F.min("__x").alias("__low"), F.max("__x").alias("__high"))
    share = (F.col("__x") - F.col("__low")) / (F.col("__high") - F.col("__low"))
    bins = F.when(F.col("__high") > F.col("__low"), F.least(F.floor(share * BINS), F.lit(BINS - 1))).otherwise(0)
    binned = _met(x.filter("__x is not null"), sizes, keys).withColumn("__bin", bins)
    placed = F.array(*(F.struct(F.lit(name).alias("name"), F.greatest(F.lit(1), F.least(F.col("n"), rank(F.col("n")).cast("long"))).alias("k")) for name, rank in ranks.items()))

    def reached(counted: DataFrame, by: list[str], at: str) -> DataFrame:
        """Rows with how many values come before them, in order of `at`."""
        return counted.withColumn("__before", F.sum("__n").over(Window.partitionBy(*by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1))).fillna(0, ["__before"])

    held = reached(binned.groupBy(*keys, "__bin", "n").agg(F.count("*").alias("__n")), keys, "__bin")
    holding = held.withColumn("__p", F.explode(placed)).filter("__p.k > __before and __p.k <= __before + __n")
    wanted = holding.select(*keys, "__bin", F.col("__p.name").alias("__name"), (F.col("__p.k") - F.col("__before")).alias("__left"))
    inside = _met(binned.groupBy(*keys, "__bin", "__x").agg(F.count("*").alias("__n")), wanted, [*keys, "__bin"])
    found = reached(inside, [*keys, "__name"], "__x").filter("__left > __before and __left <= __before + __n")
    columns = [F.max(F.when(F.col("__name") == name, F.col("__x"))).alias(name) for name in ranks]
    return _met(sizes.select(*keys, "n"), found.groupBy(*keys).agg(*columns), keys, "left")


def median_merged(df: DataFrame, keys: list[str], value: str, confidence: float = CONFIDENCE) -> DataFrame:
    """(keys, n, median, ci_lower, ci_upper) of groups too large for one task: the bootstrap's percentile interval of the
    median without drawing.

    How many of a resample's values are at most the k-th smallest is binomial, so that the interval's ends are values of
    known rank, half the group plus or minus z * sqrt(n) / 2. That holds for groups of some ten values on; of two middle
    values the median is the lower one. Groups of one have their value, groups of none nulls.
    """
    z = NormalDist().inv_cdf(0.5 + confidence / 2)
    return values_at(
        df, keys, value, {"median": lambda n: F.ceil(n / 2), "ci_lower": lambda n: F.ceil(n / 2 - z * F.sqrt(n) / 2), "ci_upper": lambda n: F.ceil(n / 2 + z * F.sqrt(n) / 2)},
    )


def paired_merged(pairs: DataFrame, keys: list[str], row: str, resamples: int = 1000) -> DataFrame:
    """(keys, mean_a, mean_b, p_value, significant, n) of groups of pairs (a, b) too large for one task: how often the mean
    of Poisson-drawn differences is as far from their mean as that is from zero. Not the draws of paired_test(); the values
    agree as the groups grow. Pairs with an undefined side don't count; fewer than two pairs give no p value."""
    both = pairs.filter(defined(F.col("a")).isNotNull() & defined(F.col("b")).isNotNull()).withColumn("__gap", F.col("a") - F.col("b"))
    means = both.groupBy(*keys).agg(F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), F.avg("__gap").alias("__seen"), F.count("*").alias("n"))
    drawn = _poisson_means(both, keys, "__gap", row, resamples)
    far = F.when(F.abs(F.col("mean") - F.col("__seen")) >= F.abs("__seen"), 1.0).otherwise(0.0)
    found = _met(drawn, means, keys).groupBy(*keys).agg(F.first("mean_a").alias("mean_a"), F.first("mean_b").alias("mean_b"), F.when(F.first("n") > 1, F.avg(far)).alias("p_value"), F.first("n").alias("n"))
    return found.withColumn("significant", F.col("p_value") < 0.05)


def compare(a: DataFrame, b: DataFrame, keys: list[str], score: str = "score") -> DataFrame:
    """Pages that both models have a defined score for."""
    left = a.select(*keys, defined(F.col(score)).alias("a")).filter("a is not null")
    return left.join(b.select(*keys, defined(F.col(score)).alias("b")).filter("b is not null"), keys)


def paired_test(pairs: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Means, p value and its verdict of each group of pairs; fewer than two pairs give no p value."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        a, b = pdf["a"].to_numpy(float), pdf["b"].to_numpy(float)
        p = paired_p(a, b) if len(a) > 1 else None
        return pd.DataFrame([[*pdf[group].iloc[0], a.mean(), b.mean(), p, None if p is None else p < 0.05, len(a)]], columns=[*group, "mean_a", "mean_b", "p_value", "significant", "n"])

    schema = ", ".join(f"{k} {pairs.schema[k].dataType.simpleString()}" for k in group)
    return pairs.groupBy(*group).applyInPandas(run, f"{schema}, mean_a double, mean_b double, p_value double, significant boolean, n long")


def last_run(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of each key's last measured run, of its last run if none is measured: the run is found first, then joined."""
    best = runs.groupBy(*keys).agg(F.max(F.struct((~F.col("is_warmup")).alias("measured"), "run_index")).alias("best"))
    chosen = best.select(*keys, F.col("best.run_index").alias("run_index"), (~F.col("best.measured")).alias("is_warmup"))
    return runs.join(chosen, [*keys, "run_index", "is_warmup"])


def keep_last(df: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(sequence)))
    return df.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace old ones of equal key; columns that one side lacks are null."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)
