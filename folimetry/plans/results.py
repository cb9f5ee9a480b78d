"""Result queries: summaries over measured runs, whole result documents and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folimetry.operators import reports
from folimetry.plans.catalogue import register
from folimetry.plans.inputs import SCORES, scores

METRICS = ["cer", "wer"]
#: Irrational, so that no mean lies halfway between two shown ones.
_SCALE = 0.7071067811865476


def _pages(s: SparkSession, d: str) -> DataFrame:
    """Two metrics a page; every label but the clean one is a degraded run, and labels have runs of their own."""
    return scores(s, d).select(
        "model", "test_set", "device", "label", "run_index", "is_warmup", "file", "page", (F.col("seconds") / 7).alias("seconds"), (F.col("score") * _SCALE).alias("cer"),
        F.when(F.col("page") % 13 == 0, float("nan")).otherwise(F.col("score") * 2 * _SCALE + 0.1).alias("wer"),
    )


def _runs(s: SparkSession, d: str) -> DataFrame:
    """What a run took: made of its seconds, as no table has it."""
    own = _pages(s, d).groupBy("model", "test_set", "device", "label", "run_index").agg(F.min("seconds").alias("a"), F.max("seconds").alias("b"))
    return own.select("model", "test_set", "device", "label", "run_index", F.round("a", 3).alias("load_seconds"), F.create_map(F.lit("peak_ram_mb"), F.round(F.col("b") * 10, 1)).alias("resources"))


_P = f"""{SCORES}, p AS (SELECT model, test_set, device, label, run_index, is_warmup, file, page, seconds / 7 AS seconds, score * {_SCALE} AS cer, CASE WHEN page % 13 <> 0 THEN score * 2 * {_SCALE} + 0.1 END AS wer FROM scores),
l AS (SELECT model, test_set, device, label, run_index, is_warmup, count(*) AS pages, sum(seconds) AS seconds, avg(cer) AS cer, avg(wer) AS wer FROM p GROUP BY ALL),
m AS (SELECT * FROM (UNPIVOT (SELECT model, test_set, device, run_index, cer, wer, seconds / pages AS "seconds per page" FROM l WHERE label = '' AND NOT is_warmup) ON cer, wer, "seconds per page" INTO NAME metric VALUE v)),
s AS (SELECT model, test_set, device, metric, avg(v) AS mean, coalesce(stddev_samp(v), 0) AS std, median(v) AS median, min(v) AS min, max(v) AS max, count(v) AS n FROM m GROUP BY 1, 2, 3, 4),
z AS (SELECT model, test_set, device, arg_max(run_index, (NOT is_warmup)::INT * 1000 + run_index) AS run_index, count(*) AS total, count(*) FILTER (is_warmup) AS warm FROM l WHERE label = '' GROUP BY 1, 2, 3)"""

_STATS = ("mean", "std", "median", "min", "max")
register(
    "score_summary_runs", lambda s, d: reports.score_summary(_pages(s, d), METRICS, intervals=False).withColumns({c: F.round(c, 6) for c in _STATS}),
    f"{_P} SELECT model, test_set, device, metric, {', '.join(f'round({c}, 6) AS {c}' for c in _STATS)}, n FROM s",
)
register("score_summary_intervals", lambda s, d: reports.score_summary(_pages(s, d), METRICS))


def _documents(s: SparkSession, d: str) -> DataFrame:
    return reports.result_documents(_pages(s, d), METRICS, runs=_runs(s, d), intervals=False)


_DOCUMENT = """total_runs long, warmup_runs long, measured_runs long, model_load_time_seconds double, total_pages_processed long, total_prediction_time_s double, resources map<string,double>,
metrics array<struct<file:long,page:long,prediction_time_seconds:double,scores:map<string,double>>>, metric_summaries map<string,struct<mean:double,std:double,n_runs:long>>, timing_summary struct<mean:double,n_runs:long>,
degradation_results array<struct<label:string,scores:map<string,double>>>"""


def _whole(s: SparkSession, d: str) -> DataFrame:
    """What the documents say, read back."""
    x = _documents(s, d).select("model", "test_set", "device", F.from_json("document", _DOCUMENT).alias("x"))
    return x.select(
        "model", "test_set", "device", "x.total_runs", "x.warmup_runs", "x.measured_runs", "x.model_load_time_seconds", "x.total_pages_processed", F.round("x.total_prediction_time_s", 4).alias("seconds"),
        F.col("x.resources")["peak_ram_mb"].alias("peak_ram_mb"), F.col("x.metric_summaries")["wer"]["mean"].alias("wer"), F.col("x.timing_summary.mean").alias("speed"),
        F.size("x.degradation_results").cast("long").alias("degraded"), F.round(F.aggregate("x.degradation_results", F.lit(0.0), lambda a, r: a + F.coalesce(r["scores"]["cer"], F.lit(0.0))), 6).alias("degraded_cer"),
    )


register(
    "result_document_whole", _whole,
    f"""{_P}, g AS (SELECT model, test_set, device, count(*) AS degraded, round(sum(round(coalesce(cer, 0), 6)), 6) AS degraded_cer FROM l WHERE label <> '' GROUP BY 1, 2, 3),
    r AS (SELECT model, test_set, device, run_index, round(min(seconds), 3) AS load, round(max(seconds) * 10, 1) AS ram FROM p WHERE label = '' GROUP BY 1, 2, 3, 4)
    SELECT z.model, z.test_set, z.device, total AS total_runs, warm AS warmup_runs, total - warm AS measured_runs, load AS model_load_time_seconds, l.pages AS total_pages_processed, round(l.seconds, 4) AS seconds, ram AS peak_ram_mb,
      round(w.mean, 6) AS wer, round(t.mean, 6) AS speed, coalesce(degraded, -1) AS degraded, degraded_cer
    FROM z JOIN l ON (l.model, l.test_set, l.device, l.run_index, l.label) = (z.model, z.test_set, z.device, z.run_index, '') JOIN r ON (r.model, r.test_set, r.device, r.run_index) = (z.model, z.test_set, z.device, z.run_index)
    LEFT JOIN s w ON (w.model, w.test_set, w.device, w.metric) = (z.model, z.test_set, z.device, 'wer') LEFT JOIN s t ON (t.model, t.test_set, t.device, t.metric) = (z.model, z.test_set, z.device, 'seconds per page')
    LEFT JOIN g ON (g.model, g.test_set, g.device) = (z.model, z.test_set, z.device)""",
)


def _document_pages(s: SparkSession, d: str) -> DataFrame:
    x = _documents(s, d).select("model", "test_set", "device", F.posexplode(F.from_json("document", _DOCUMENT)["metrics"]).alias("place", "p"))
    return x.select("model", "test_set", "device", F.col("place").cast("long").alias("place"), "p.file", "p.page", F.col("p.scores")["cer"].alias("cer"), F.col("p.scores")["wer"].alias("wer"))


register(
    "result_document_pages", _document_pages,
    f"""{_P} SELECT p.model, p.test_set, p.device, row_number() OVER (PARTITION BY p.model, p.test_set, p.device ORDER BY p.file, p.page) - 1 AS place, p.file, p.page, round(p.cer, 6) AS cer, round(p.wer, 6) AS wer
    FROM p JOIN z ON (p.model, p.test_set, p.device, p.run_index) = (z.model, z.test_set, z.device, z.run_index) WHERE p.label = ''""",
)
register(
    "markdown_report_whole", lambda s, d: reports.markdown_reports(_pages(s, d), METRICS, runs=_runs(s, d), intervals=False),
    f"""{_P}, t AS (SELECT model, test_set, device, string_agg(printf('| %s | %.4f | %.4f |', CASE metric WHEN 'seconds per page' THEN 'Speed (s/page)' ELSE upper(metric) END, mean, std), chr(10) ORDER BY metric = 'seconds per page', metric) AS lines FROM s WHERE n > 0 GROUP BY 1, 2, 3),
    r AS (SELECT model, test_set, device, run_index, round(min(seconds), 3) AS load, round(max(seconds) * 10, 1) AS ram FROM p WHERE label = '' GROUP BY 1, 2, 3, 4),
    q AS (SELECT z.model, z.test_set, z.device, '### Resources' || chr(10) || chr(10) || printf('- Load time: %.2fs', load) || chr(10) || printf('- Peak RAM: %.0f MB', ram) || chr(10) || '- Peak VRAM: —' AS own FROM z JOIN r USING (model, test_set, device, run_index) WHERE total > warm),
    g AS (SELECT model, test_set, device, string_agg('| ' || label || ' | ' || coalesce(printf('%.4f', cer), '—') || ' | ' || coalesce(printf('%.4f', wer), '—') || ' |', chr(10) ORDER BY label, run_index) AS rows FROM l WHERE label <> '' GROUP BY 1, 2, 3)
    SELECT k.model, k.test_set, k.device, concat_ws(chr(10) || chr(10), '## ' || concat_ws(' — ', k.model, k.test_set, k.device), '| Metric | Mean | Std |' || chr(10) || '|---|---|---|' || chr(10) || lines, own,
      '### Degradation robustness' || chr(10) || chr(10) || '| Degradation | CER | WER |' || chr(10) || '|---|---|---|' || chr(10) || rows) AS report
    FROM (SELECT DISTINCT model, test_set, device FROM l) k LEFT JOIN t USING (model, test_set, device) LEFT JOIN q USING (model, test_set, device) LEFT JOIN g USING (model, test_set, device)""",
)
