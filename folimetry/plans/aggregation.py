"""Aggregation, statistics and comparison queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folimetry.operators import statistics as st
from folimetry.plans.catalogue import register
from folimetry.plans.inputs import SCORES, scores, table
from folimetry.plans.metrics import CER, NORMAL, page_scores

RUN = ["model", "test_set", "device", "run_index", "is_warmup"]
GROUP = ["model", "test_set", "device"]


def _rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, places) for n in names})


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(spark, sf_dir).filter(~F.col("is_warmup"))


def _q(name: str, build, sql: str | None, base=scores) -> None:
    register(name, lambda s, d: build(base(s, d)), sql and f"{SCORES} {sql}")


STATS = ("mean", "std", "median", "min", "max")
_SUM = "round(coalesce(avg({0}), 0), 6) AS mean, round(coalesce(stddev_samp({0}), 0), 6) AS std, round(coalesce(median({0}), 0), 6) AS median, round(coalesce(min({0}), 0), 6) AS min, round(coalesce(max({0}), 0), 6) AS max, count({0}) AS n"
RUNS = f"{SCORES}, runs AS (SELECT model, test_set, device, run_index, is_warmup, avg(score) AS mean, count(*) AS pages, sum(seconds) AS total FROM scores GROUP BY ALL)"


def score_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character error rate of each model and test set over pages."""
    found = page_scores(spark, sf_dir).groupBy("model", "test_set").agg(*st.summary_columns(F.col("cer")))
    return _rounded(found, *STATS)


register("score_summary", score_summary, f"{NORMAL}, c AS (SELECT model, test_set, {CER} AS cer FROM n) SELECT model, test_set, {_SUM.format('cer')} FROM c GROUP BY 1, 2")
_q("run_aggregate", lambda df: _rounded(st.run_means(df, RUN), "mean"), "SELECT model, test_set, device, run_index, is_warmup, round(avg(score), 6) AS mean, count(*) AS pages FROM scores GROUP BY 1, 2, 3, 4, 5")
register(
    "summarise", lambda s, d: _rounded(st.run_means(_measured(s, d), RUN).groupBy(*GROUP).agg(*st.summary_columns(F.col("mean"))), *STATS),
    f"{RUNS} SELECT model, test_set, device, {_SUM.format('mean')} FROM runs WHERE NOT is_warmup GROUP BY 1, 2, 3",
)
register(
    "timing_summary",
    lambda s, d: _rounded(_measured(s, d).groupBy(*RUN).agg((F.sum("seconds") / F.count("*")).alias("t")).groupBy(*GROUP).agg(*st.summary_columns(F.col("t"))), *STATS),
    f"{RUNS} SELECT model, test_set, device, {_SUM.format('total / pages')} FROM runs WHERE NOT is_warmup AND pages > 0 GROUP BY 1, 2, 3",
)
register("bootstrap_ci", lambda s, d: st.bootstrap(st.run_means(_measured(s, d), RUN).withColumn("mean", st.defined(F.col("mean"))), GROUP, "mean", ["run_index"]))


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of both models, by test set."""
    found = page_scores(spark, sf_dir)
    return st.compare(found.filter("model = 'A'"), found.filter("model = 'B'"), ["test_set", "file", "page"], "cer")


register("paired_bootstrap", lambda s, d: st.paired_test(_compared(s, d), ["test_set"], ["file", "page"]))
register(
    "paired_compare", lambda s, d: _rounded(_compared(s, d).groupBy("test_set").agg(F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), F.count("*").alias("n")), "mean_a", "mean_b"),
    f"""{NORMAL}, c AS (SELECT model, test_set, file, page, {CER} AS cer FROM n)
    SELECT a.test_set, round(avg(a.cer), 6) AS mean_a, round(avg(b.cer), 6) AS mean_b, count(*) AS n FROM c a JOIN c b ON a.model = 'A' AND b.model = 'B' AND a.test_set = b.test_set AND a.file = b.file AND a.page = b.page
    WHERE a.cer IS NOT NULL AND b.cer IS NOT NULL GROUP BY 1""",
)
register(
    "common_pages", lambda s, d: scores(s, d).filter("model = 'm0' and score is not null").select("page").union(scores(s, d).filter("model = 'm0'").select("page")).intersect(scores(s, d).filter("score > 0.05").select("page")),
    f"{SCORES} SELECT page FROM scores WHERE model = 'm0' INTERSECT SELECT page FROM scores WHERE score > 0.05",
)
_q("measured_runs", lambda df: df.filter(~F.col("is_warmup")).groupBy("model").agg(F.countDistinct("run_index").alias("runs")), "SELECT model, count(DISTINCT run_index) AS runs FROM scores WHERE NOT is_warmup GROUP BY 1")
_q("page_counts", lambda df: df.groupBy(*RUN).agg(F.count("*").alias("pages")), "SELECT model, test_set, device, run_index, is_warmup, count(*) AS pages FROM scores GROUP BY 1, 2, 3, 4, 5")
_LAST = "last AS (SELECT s.* FROM scores s JOIN (SELECT model, test_set, device, arg_max(run_index, CASE WHEN is_warmup THEN 0 ELSE 1000 END + run_index) AS run_index FROM scores GROUP BY 1, 2, 3) b USING (model, test_set, device, run_index))"
_q("last_run_detail", lambda df: st.last_run(df, GROUP).select(*GROUP, "run_index", "file", "page", "score"), f", {_LAST} SELECT model, test_set, device, run_index, file, page, score FROM last")


def _summary_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _measured(spark, sf_dir).groupBy(*RUN).agg(F.avg("score").alias("score"), F.avg("seconds").alias("seconds"))
    found = runs.groupBy(*GROUP).agg(F.count("*").alias("runs"), *[F.round(f(c), 4).alias(f"{c}_{n}") for c in ("score", "seconds") for n, f in (("mean", F.avg), ("std", F.stddev_samp))])
    return found.withColumns({f"{c}_std": F.coalesce(f"{c}_std", F.lit(0.0)) for c in ("score", "seconds")})


register(
    "summary_rows", _summary_rows,
    f"""{SCORES}, r AS (SELECT model, test_set, device, run_index, avg(score) AS score, avg(seconds) AS seconds FROM scores WHERE NOT is_warmup GROUP BY 1, 2, 3, 4)
    SELECT model, test_set, device, count(*) AS runs, round(avg(score), 4) AS score_mean, coalesce(round(stddev_samp(score), 4), 0) AS score_std, round(avg(seconds), 4) AS seconds_mean, coalesce(round(stddev_samp(seconds), 4), 0) AS seconds_std FROM r GROUP BY 1, 2, 3""",
)
_q("degradation_summary", lambda df: _rounded(df.groupBy("model", "label").pivot("test_set", ["click", "error", "purchase", "view"]).agg(F.avg("score")), "click", "error", "purchase", "view"), "SELECT model, label, " + ", ".join(f"round(avg(score) FILTER (test_set = '{t}'), 6) AS {t}" for t in ("click", "error", "purchase", "view")) + " FROM scores GROUP BY 1, 2")
_q("running_peak", lambda df: df.select("file", "page", F.max("seconds").over(Window.partitionBy("file").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)).alias("peak")), "SELECT file, page, max(seconds) OVER (PARTITION BY file ORDER BY page ROWS UNBOUNDED PRECEDING) AS peak FROM scores")
_q("quick_stats", lambda df: df.agg(F.countDistinct("model").alias("models"), F.countDistinct("test_set").alias("test_sets"), F.countDistinct("device").alias("devices"), F.count("*").alias("rows"), F.count_if(F.col("device") == "cpu").alias("filtered")), "SELECT count(DISTINCT model) AS models, count(DISTINCT test_set) AS test_sets, count(DISTINCT device) AS devices, count(*) AS rows, count(*) FILTER (device = 'cpu') AS filtered FROM scores")
_q("pivot_heatmap", lambda df: _rounded(df.groupBy("test_set").pivot("model", ["m0", "m1", "m2", "m3"]).agg(F.avg("score")), "m0", "m1", "m2", "m3"), "SELECT test_set, " + ", ".join(f"round(avg(score) FILTER (model = 'm{i}'), 6) AS m{i}" for i in range(4)) + " FROM scores GROUP BY 1")
_q("timing_quartiles", lambda df: df.groupBy("model", "device").agg(F.percentile("seconds", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q")).select("model", "device", *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("q1", "q2", "q3"))]), "SELECT model, device, " + ", ".join(f"round(quantile_cont(seconds, {p}), 6) AS {n}" for p, n in ((0.25, "q1"), (0.5, "q2"), (0.75, "q3"))) + " FROM scores GROUP BY 1, 2")


def _dominant_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Most common non-empty line of each document and its share; the first seen wins ties."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line")).filter(F.trim("line") != "")
    counted = lines.groupBy("doc_id", "line").agg(F.count("*").alias("c"), F.min("pos").alias("p"))
    best = counted.groupBy("doc_id").agg(F.max_by(F.struct("line", "c"), F.struct("c", -F.col("p"))).alias("b"), F.sum("c").alias("total"))
    return best.select("doc_id", F.md5("b.line").alias("line"), F.col("b.c").alias("n"), F.round(F.col("b.c") / F.col("total"), 6).alias("share"))


register(
    "dominant_line", _dominant_line,
    r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
    c AS (SELECT doc_id, line, count(*) AS c, min(pos) AS p FROM l WHERE trim(line) <> '' GROUP BY 1, 2),
    r AS (SELECT *, sum(c) OVER (PARTITION BY doc_id) AS total, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, p) AS k FROM c)
    SELECT doc_id, md5(line) AS line, c AS n, round(c / total::DOUBLE, 6) AS share FROM r WHERE k = 1""",
)
