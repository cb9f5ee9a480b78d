"""Filters, set operations, windows, reshaping and reports over page scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folimetry.functions import formatting
from folimetry.functions.text import fixed
from folimetry.operators import statistics as st
from folimetry.plans.catalogue import register
from folimetry.plans.inputs import REGIONS, SCORES, regions, scores, table

KEY = ["model", "test_set", "device"]


def _q(name: str, build, sql: str | None) -> None:
    register(name, lambda s, d: build(scores(s, d)), sql and f"{SCORES} {sql}")


_q("categorical_filter", lambda df: df.filter(F.col("model").isin("m0", "m2") & F.col("device").isin("cpu")).select("page", "model", "score"), "SELECT page, model, score FROM scores WHERE model IN ('m0', 'm2') AND device IN ('cpu')")
_q("project_columns", lambda df: df.select(*dict.fromkeys(c for c in [*KEY, "page", "model", "absent"] if c in df.columns)), "SELECT model, test_set, device, page FROM scores")
_q("distinct_values", lambda df: df.select("label").filter("label is not null").distinct().orderBy("label"), "SELECT DISTINCT label FROM scores WHERE label IS NOT NULL")
_q("sorted_summary", lambda df: df.groupBy(*KEY).agg(F.round(F.avg("score"), 6).alias("mean")).orderBy(F.desc_nulls_last("mean")), "SELECT model, test_set, device, round(avg(score), 6) AS mean FROM scores GROUP BY 1, 2, 3")
_q("metric_leaderboard", lambda df: df.groupBy("model").agg(F.round(F.avg("score"), 6).alias("mean")).dropna(subset=["mean"]).orderBy(F.desc("mean")), "SELECT model, round(avg(score), 6) AS mean FROM scores GROUP BY 1 HAVING avg(score) IS NOT NULL")
_q("explore_page", lambda df: df.groupBy("file").agg(F.min_by(F.struct("page", "score", "seconds"), "page").alias("x")).select("file", "x.*"), "SELECT file, min(page) AS page, arg_min(score, page) FILTER (true) AS score, arg_min(seconds, page) AS seconds FROM (SELECT file, page, score, seconds, row_number() OVER (PARTITION BY file ORDER BY page) AS k FROM scores) WHERE k = 1 GROUP BY 1")
_q("score_keys", lambda df: df.select("model", F.explode(F.array(F.when(F.col("score").isNotNull(), F.concat(F.col("test_set"), F.lit("_score"))), F.lit("seconds"))).alias("k")).filter("k is not null").groupBy("model").agg(F.array_join(F.array_sort(F.collect_set("k")), ",").alias("keys")), "SELECT model, string_agg(DISTINCT k, ',' ORDER BY k) AS keys FROM (SELECT model, test_set || '_score' AS k FROM scores WHERE score IS NOT NULL UNION ALL SELECT model, 'seconds' FROM scores) GROUP BY 1")
_q("summary_dedup_last", lambda df: st.keep_last(df, KEY, "page").select(*KEY, "page", "seconds"), "SELECT model, test_set, device, max(page) AS page, arg_max(seconds, page) AS seconds FROM scores GROUP BY 1, 2, 3")
_WIDE = ["click", "error", "purchase", "view"]
_q("scores_wide", lambda df: df.groupBy("file").pivot("test_set", _WIDE).agg(F.round(F.sum("score"), 6)), "SELECT file, " + ", ".join(f"round(sum(score) FILTER (test_set = '{t}'), 6) AS {t}" for t in _WIDE) + " FROM scores GROUP BY 1")
_q("scores_long", lambda df: df.groupBy("file").agg(F.round(F.sum("score"), 6).alias("score"), F.round(F.sum("seconds"), 6).alias("seconds")).unpivot("file", ["score", "seconds"], "metric", "value"), "SELECT file, 'score' AS metric, round(sum(score), 6) AS value FROM scores GROUP BY 1 UNION ALL SELECT file, 'seconds', round(sum(seconds), 6) FROM scores GROUP BY 1")


def _upsert(df: DataFrame) -> DataFrame:
    old = df.groupBy(*KEY).agg(F.count("*").alias("pages"))
    new = df.filter("model = 'm1'").groupBy(*KEY).agg(F.round(F.sum("seconds"), 4).alias("seconds"))
    return st.upsert(old, new, KEY)


_q("summary_upsert", _upsert, "SELECT model, test_set, device, count(*) AS pages, NULL::DOUBLE AS seconds FROM scores WHERE model <> 'm1' GROUP BY 1, 2, 3 UNION ALL SELECT model, test_set, device, NULL, round(sum(seconds), 4) FROM scores WHERE model = 'm1' GROUP BY 1, 2, 3")


def _regions(name: str, build, sql: str) -> None:
    register(name, lambda s, d: build(regions(s, d)), f"{REGIONS} {sql}")


_regions("regions_by_category", lambda df: df.filter(F.col("category").isin("A", "R")).select("page", "idx", "category"), "SELECT page, idx, category FROM gt WHERE category IN ('A', 'R')")
_regions("page_flags", lambda df: df.groupBy("page").agg((F.count("*") > 0).alias("has_regions"), F.max(F.when(F.col("x2") > F.col("x1"), True).otherwise(False)).alias("has_boxes")), "SELECT page, count(*) > 0 AS has_regions, bool_or(x2 > x1) AS has_boxes FROM gt GROUP BY 1")
_regions("page_full_text", lambda df: df.filter("category <> 'N'").groupBy("page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", F.concat(F.lit("r"), F.col("x1").cast("string")).alias("t")))), lambda x: x["t"]), "\n\n").alias("full_text")), "SELECT page, string_agg('r' || x1, chr(10) || chr(10) ORDER BY idx) AS full_text FROM gt WHERE category <> 'N' GROUP BY 1")
_regions("page_markdown", lambda df: df.groupBy("page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", F.concat(F.when(F.col("category") == "A", "# ").when(F.col("category") == "R", "- ").otherwise(""), F.col("x1").cast("string")).alias("t")))), lambda x: x["t"]), "\n\n").alias("markdown")), "SELECT page, string_agg(CASE category WHEN 'A' THEN '# ' WHEN 'R' THEN '- ' ELSE '' END || x1, chr(10) || chr(10) ORDER BY idx) AS markdown FROM gt GROUP BY 1")


def _bullets(df: DataFrame) -> DataFrame:
    w = Window.partitionBy("page").orderBy("idx")
    near = (F.abs(F.col("x1") - F.lag("x1").over(w)) <= 100) & (F.abs(F.col("x1") - F.lead("x1").over(w)) <= 100)
    hit = (F.col("category") == "N") & (F.lag("category").over(w) == "R") & (F.lead("category").over(w) == "R") & near
    return df.select("page", "idx", F.coalesce(hit, F.lit(False)).alias("bullet"))


_regions("bullet_context", _bullets, "SELECT page, idx, coalesce(category = 'N' AND lag(category) OVER w = 'R' AND lead(category) OVER w = 'R' AND abs(x1 - lag(x1) OVER w) <= 100 AND abs(x1 - lead(x1) OVER w) <= 100, false) AS bullet FROM gt WINDOW w AS (PARTITION BY page ORDER BY idx)")
_regions("label_class", lambda df: df.groupBy(formatting.label_class(F.col("category"), {"text": ("A",), "table": ("N",), "image": ("R",)}).alias("class")).agg(F.count("*").alias("n")), "SELECT CASE category WHEN 'A' THEN 'text' WHEN 'N' THEN 'table' ELSE 'image' END AS class, count(*) AS n FROM gt GROUP BY 1")


def _turns(name: str, joiner: str, head: bool, sql: str) -> None:
    def query(s: SparkSession, d: str) -> DataFrame:
        rows = table(s, d, "conversations").filter(F.coalesce("text", F.lit("")) != "")
        shown = F.concat(F.lit("── Page "), (F.col("turn") + 1).cast("string"), F.lit(" ──\n"), F.col("text")) if head else F.col("text")
        joined = rows.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", shown.alias("t")))), lambda x: x["t"]), joiner).alias("t"))
        return joined.select("conv_id", F.md5("t").alias("digest"))

    register(name, query, sql)


_turns("document_text", "\n\n", False, "SELECT conv_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS digest FROM conversations WHERE text <> '' GROUP BY 1")
_turns("compare_text", "\n\n", True, "SELECT conv_id, md5(string_agg('── Page ' || (turn + 1) || ' ──' || chr(10) || text, chr(10) || chr(10) ORDER BY turn)) AS digest FROM conversations WHERE text <> '' GROUP BY 1")


def _aligned(s: SparkSession, d: str) -> DataFrame:
    """Worker pages meet ground truth by place in their lists, whatever their numbers; a missing page keeps its row."""
    turns = table(s, d, "conversations")
    place = (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).cast("long")
    worker = turns.select("conv_id", "turn", F.md5("text").alias("predicted")).withColumn("place", place)
    truth = turns.filter("role <> 'system'").select("conv_id", "turn", F.md5("text").alias("gt")).withColumn("place", place)
    return worker.join(truth.drop("turn"), ["conv_id", "place"], "left").select("conv_id", "place", "predicted", "gt")


register("page_alignment", _aligned, "WITH w AS (SELECT conv_id, md5(text) AS predicted, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM conversations), g AS (SELECT conv_id, md5(text) AS gt, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM conversations WHERE role <> 'system') SELECT conv_id, place, predicted, gt FROM w LEFT JOIN g USING (conv_id, place)")


def _report(df: DataFrame) -> DataFrame:
    """A markdown table of each model's test sets."""
    means = df.groupBy("model", "test_set").agg(F.avg("score").alias("m"), F.count("*").alias("n"))
    line = F.concat(F.lit("| "), "test_set", F.lit(" | "), fixed(F.col("m"), 4), F.lit(" | "), F.col("n").cast("string"), F.lit(" |"))
    rows = means.groupBy("model").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("body"))
    return rows.select("model", F.concat(F.lit("## "), F.col("model"), F.lit("\n\n| Test set | Mean | Pages |\n| --- | --- | --- |\n"), F.col("body")).alias("report"))


_q("markdown_report", _report, "SELECT model, '## ' || model || chr(10) || chr(10) || '| Test set | Mean | Pages |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg(printf('| %s | %.4f | %d |', test_set, m, n), chr(10) ORDER BY test_set) AS report FROM (SELECT model, test_set, avg(score) AS m, count(*) AS n FROM scores GROUP BY 1, 2) GROUP BY 1")
_q("result_document", lambda df: df.groupBy(*KEY).agg(F.to_json(F.struct(F.round(F.avg("score"), 6).alias("mean"), F.count("*").alias("pages"))).alias("document")), "SELECT model, test_set, device, '{' || coalesce('\"mean\":' || round(avg(score), 6) || ',', '') || '\"pages\":' || count(*) || '}' AS document FROM scores GROUP BY 1, 2, 3")
