"""Summaries over measured runs, result documents with their pages, and markdown reports, from a table of page scores.

Pages have the keys of a result, `label` (empty for clean runs, else the degradation's), `run_index`, `is_warmup`, `file`,
`page`, `seconds` and a column for each metric; undefined scores are null or NaN. Runs may add `load_seconds` and
`resources`, a map of MB, by key, label and run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folimetry.functions.text import fixed
from folimetry.operators import statistics as st

KEYS = ("model", "test_set", "device")
SPEED = "seconds per page"
RESOURCES = ("ram_after_load_mb", "peak_ram_mb", "vram_after_load_mb", "peak_vram_mb")


def run_level(pages: DataFrame, metrics: list[str], keys: tuple[str, ...] = KEYS) -> DataFrame:
    """A row a run: keys, label, run_index, is_warmup, pages, seconds and the mean of each metric's defined scores."""
    means = [F.avg(st.defined(F.col(m))).alias(m) for m in metrics]
    return pages.groupBy(*keys, "label", "run_index", "is_warmup").agg(F.count("*").alias("pages"), F.sum("seconds").alias("seconds"), *means)


def score_summary(pages: DataFrame, metrics: list[str], keys: tuple[str, ...] = KEYS, intervals: bool = True) -> DataFrame:
    """(keys, metric, mean, std, median, min, max, n) over the measured clean runs' means, and `ci_lower`, `ci_upper` by
    bootstrap with `intervals`. Runs without a defined score don't count; a metric without any has n 0. SPEED is a metric."""
    return _summaries(run_level(pages, metrics, keys), metrics, keys, intervals)


def _summaries(runs: DataFrame, metrics: list[str], keys: tuple[str, ...], intervals: bool) -> DataFrame:
    values = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics), F.struct(F.lit(SPEED).alias("metric"), (F.col("seconds") / F.col("pages")).alias("value")))
    long = runs.filter("label = '' and not is_warmup").select(*keys, "run_index", F.explode(values).alias("v")).select(*keys, "run_index", "v.metric", "v.value")
    found = long.groupBy(*keys, "metric").agg(*st.summary_columns(F.col("value")))
    if not intervals:
        return found
    by_runs = st.bootstrap(long.withColumn("value", st.defined(F.col("value"))), [*keys, "metric"], "value", ["run_index"])
    return found.join(by_runs.drop("n"), [*keys, "metric"], "left")


def last_runs(runs: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """The last measured clean run of each key, the last one if none is measured."""
    clean = runs.filter("label = ''")
    best = clean.groupBy(*keys).agg(F.max(F.struct((~F.col("is_warmup")).alias("measured"), "run_index")).alias("best"))
    return clean.join(best.select(*keys, F.col("best.run_index").alias("run_index"), (~F.col("best.measured")).alias("is_warmup")), [*keys, "run_index", "is_warmup"])


def _in_order(rows: DataFrame, keys: tuple[str, ...], order: list[str], entry: Column, name: str) -> DataFrame:
    """Each key's entries as an array, in order."""
    whole = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*order, entry.alias("__entry")))).alias("__x"))
    return whole.select(*keys, F.transform("__x", lambda x: x["__entry"]).alias(name))


def _scores(metrics: list[str]) -> Column:
    """A struct of the metrics, null where undefined: JSON then leaves them out."""
    return F.struct(*(F.round(st.defined(F.col(m).cast("double")), 6).alias(m) for m in metrics))


def _degradations(runs: DataFrame, metrics: list[str], keys: tuple[str, ...]) -> DataFrame:
    entry = F.struct("label", _scores(metrics).alias("scores"))
    return _in_order(runs.filter("label <> ''"), keys, ["label", "run_index"], entry, "degradation_results")


def result_documents(
    pages: DataFrame, metrics: list[str], keys: tuple[str, ...] = KEYS, runs: DataFrame | None = None, details: tuple[str, ...] = (), intervals: bool = True,
) -> DataFrame:
    """(keys, document): one JSON a key with counts of runs, speed, resources and pages of the last measured run, summaries
    of metrics and speed over measured runs, and scores of each degraded run.

    `details` are further columns of a page (texts, regions; no maps, for pages are sorted). Undefined scores are left out, numbers have 6 decimals. A
    document holds its last run's pages, as its format has it: a run's pages must fit a row (2 GB). write_results() writes them.
    """
    level = run_level(pages, metrics, keys)
    counts = level.filter("label = ''").groupBy(*keys).agg(F.count("*").alias("total_runs"), F.count_if("is_warmup").alias("warmup_runs"), F.count_if(~F.col("is_warmup")).alias("measured_runs"))
    last = last_runs(level, keys)
    shown = F.struct("file", "page", F.round("seconds", 6).alias("prediction_time_seconds"), *details, _scores(metrics).alias("scores"))
    of_last = pages.filter("label = ''").join(last.select(*keys, "run_index", "is_warmup"), [*keys, "run_index", "is_warmup"])
    made = counts.join(_in_order(of_last, keys, ["file", "page"], shown, "metrics"), list(keys), "left")
    speed = (F.col("seconds") / F.col("pages")).alias("average_prediction_time_s_per_page")
    own = [F.lit(None).cast("double").alias("model_load_time_seconds"), F.lit(None).cast("map<string,double>").alias("resources")]
    if runs is not None:
        last = last.join(runs.filter("label = ''").select(*keys, "run_index", "load_seconds", "resources"), [*keys, "run_index"], "left")
        own = [F.col("load_seconds").alias("model_load_time_seconds"), F.col("resources")]
    made = made.join(last.select(*keys, *own, F.round("seconds", 6).alias("total_prediction_time_s"), F.col("pages").alias("total_pages_processed"), F.round(speed, 6).alias("average_prediction_time_s_per_page")), list(keys), "left")
    bounds = ["ci_lower", "ci_upper"] if intervals else []
    found = _summaries(level, metrics, keys, intervals).filter("n > 0")
    entry = F.struct(F.col("metric").alias("key"), F.struct(*(F.round(c, 6).alias(c) for c in ("mean", "std", *bounds)), F.col("n").alias("n_runs")).alias("value"))
    listed = _in_order(found, keys, ["metric"], entry, "__all")
    is_speed = lambda e: e["key"] == SPEED
    made = made.join(
        listed.select(*keys, F.map_from_entries(F.filter("__all", lambda e: ~is_speed(e))).alias("metric_summaries"), F.get(F.filter("__all", is_speed), F.lit(0))["value"].alias("timing_summary")), list(keys), "left",
    ).join(_degradations(level, metrics, keys), list(keys), "left")
    return made.select(*keys, F.to_json(F.struct(*keys, *(c for c in made.columns if c not in keys))).alias("document"))


def _number(value: Column, places: int, unit: str = "") -> Column:
    return F.coalesce(F.concat(fixed(value, places), F.lit(unit)), F.lit("—"))


def markdown_reports(pages: DataFrame, metrics: list[str], keys: tuple[str, ...] = KEYS, runs: DataFrame | None = None, intervals: bool = True) -> DataFrame:
    """(keys, report): a heading, a table of metrics and speed over measured runs, resources of the last measured run, and a
    table of degraded runs. Metrics without a defined score are left out of the first table and a dash in the second; parts
    without rows are left out."""
    level = run_level(pages, metrics, keys)
    names = F.array(*map(F.lit, [*metrics, SPEED]))
    found = _summaries(level, metrics, keys, intervals).filter("n > 0")
    shown = F.when(F.col("metric") == SPEED, "Speed (s/page)").otherwise(F.upper("metric"))
    line = F.concat(F.lit("| "), shown, *(x for c in ("mean", "std") for x in (F.lit(" | "), fixed(F.col(c), 4))), F.lit(" |"), *((F.lit(" ["), fixed(F.col("ci_lower"), 4), F.lit(", "), fixed(F.col("ci_upper"), 4), F.lit("] |")) if intervals else ()))
    head = "| Metric | Mean | Std |" + " 95% CI |" * intervals + "\n|---|---|---|" + "---|" * intervals
    made = level.select(*keys).distinct().join(_in_order(found.withColumn("__at", F.array_position(names, F.col("metric"))), keys, ["__at"], line, "__lines"), list(keys), "left")
    parts = [F.concat(F.lit("## "), F.concat_ws(" — ", *keys)), F.when(F.size("__lines") > 0, F.concat(F.lit(head + "\n"), F.array_join("__lines", "\n")))]
    if runs is not None:
        last = last_runs(level, keys).filter("not is_warmup").join(runs.filter("label = ''").select(*keys, "run_index", "load_seconds", "resources"), [*keys, "run_index"])
        made = made.join(last.select(*keys, "load_seconds", "resources"), list(keys), "left")
        listed = [F.concat(F.lit("- Load time: "), _number(F.col("load_seconds"), 2, "s")), *(F.concat(F.lit(f"- Peak {n}: "), _number(F.col("resources")[k], 0, " MB")) for n, k in (("RAM", "peak_ram_mb"), ("VRAM", "peak_vram_mb")))]
        parts.append(F.when(F.col("resources").isNotNull() | F.col("load_seconds").isNotNull(), F.concat(F.lit("### Resources\n\n"), F.concat_ws("\n", *listed))))
    rows = level.filter("label <> ''")
    row = F.concat(F.lit("| "), F.col("label"), F.lit(" |"), *(F.concat(F.lit(" "), _number(st.defined(F.col(m)), 4), F.lit(" |")) for m in metrics))
    top = "| Degradation |" + "".join(f" {m.upper()} |" for m in metrics) + "\n|---|" + "---|" * len(metrics)
    made = made.join(_in_order(rows, keys, ["label", "run_index"], row, "__degraded"), list(keys), "left")
    parts.append(F.when(F.size("__degraded") > 0, F.concat(F.lit(f"### Degradation robustness\n\n{top}\n"), F.array_join("__degraded", "\n"))))
    return made.select(*keys, F.concat_ws("\n\n", *parts).alias("report"))
