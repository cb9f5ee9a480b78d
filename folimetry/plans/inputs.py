"""Inputs of the registered queries, made from whole tables; each has a DataFrame and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference and prediction of every turn by two models; a prediction is corrupted in one of five ways."""
    text = F.regexp_replace("text", r"[^ -~\n]", "?")
    base = table(spark, sf_dir, "conversations").select(
        F.col("role").alias("test_set"), F.col("conv_id").alias("file"), F.col("turn").alias("page"), text.alias("gt"),
        ((F.col("conv_id") * 3 + F.col("turn")) % 5).alias("k"),
    )
    gt = F.col("gt")

    def predicted(k):
        return (
            F.when(k == 0, gt).when(k == 1, F.translate(gt, "oe", "0c")).when(k == 2, F.substring(gt, F.lit(1), F.floor(F.char_length(gt) * 0.75).cast("int")))
            .when(k == 3, F.replace(gt, F.lit(", "), F.lit(","))).otherwise("")
        )

    both = [base.select(F.lit(m).alias("model"), "test_set", "file", "page", "gt", predicted((F.col("k") + s) % 5).alias("pred")) for m, s in (("A", 0), ("B", 2))]
    return both[0].unionByName(both[1])


def _predicted(k: str) -> str:
    return f"""CASE {k} WHEN 0 THEN gt WHEN 1 THEN translate(gt, 'oe', '0c') WHEN 2 THEN substr(gt, 1, CAST(floor(length(gt) * 0.75) AS INT))
      WHEN 3 THEN replace(gt, ', ', ',') ELSE '' END"""


PAIRS = rf"""WITH base AS (
  SELECT role AS test_set, conv_id AS file, turn AS page, regexp_replace(text, '[^ -~\n]', '?', 'g') AS gt, (conv_id * 3 + turn) % 5 AS k FROM conversations
), pairs AS (
  SELECT 'A' AS model, test_set, file, page, gt, {_predicted("k")} AS pred FROM base
  UNION ALL SELECT 'B', test_set, file, page, gt, {_predicted("(k + 2) % 5")} FROM base
)"""

_REGION = (
    "l_orderkey AS page", "l_returnflag AS category", "l_partkey % 800 AS x", "(l_suppkey * 37) % 800 AS y", "40 + l_partkey % 61 AS w", "30 + l_suppkey % 47 AS h",
    "CAST(l_quantity AS BIGINT) AS q", "(l_partkey * 31) % 100 / CAST(100 AS DOUBLE) AS score",
    "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) AS idx",
)
_BOXES = ("page", "idx", "category", "score", "q", "x AS x1", "y AS y1", "x + w AS x2", "y + h AS y2")
_SHIFTED = ("page", "idx", "CASE WHEN q % 11 = 0 THEN 'N' ELSE category END AS category", "score", "q", "x + q % 9 AS x1", "y + q % 5 AS y1", "x + w + q % 9 AS x2", "y + h + q % 5 AS y2")


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference boxes: pages are orders, boxes their lines."""
    return table(spark, sf_dir, "lineitem").selectExpr(*_REGION).selectExpr(*_BOXES)


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted boxes: the same ones shifted, some in another category."""
    return table(spark, sf_dir, "lineitem").selectExpr(*_REGION).selectExpr(*_SHIFTED)


REGIONS = f"""WITH raw AS (SELECT {", ".join(_REGION)} FROM lineitem), gt AS (SELECT {", ".join(_BOXES)} FROM raw), pr AS (SELECT {", ".join(_SHIFTED)} FROM raw)"""

_SCORES = (
    "concat('m', CAST(user_id % 4 AS STRING)) AS model", "event_type AS test_set", "CASE WHEN user_id % 2 = 0 THEN 'cpu' ELSE 'cuda' END AS device",
    "CAST(day(ts) % 5 AS BIGINT) AS run_index", "day(ts) % 5 = 0 AS is_warmup", "CASE WHEN hour(ts) % 3 = 0 THEN '' ELSE concat('noise_', CAST(hour(ts) % 3 AS STRING)) END AS label",
    "user_id AS file", "event_id AS page", "CASE WHEN event_id % 17 = 0 THEN NULL ELSE value / CAST(100 AS DOUBLE) END AS score", "value AS seconds", "props",
)


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page scores of runs; null is an undefined score."""
    return table(spark, sf_dir, "events").selectExpr(*_SCORES)


SCORES = f"WITH scores AS (SELECT {', '.join(_SCORES).replace('AS STRING', 'AS VARCHAR')} FROM events)"
