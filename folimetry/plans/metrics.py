"""Page metric queries over pairs of texts and over synthetic tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folimetry.functions import text as tx
from folimetry.operators import alignment, metrics, trees
from folimetry.plans.catalogue import register
from folimetry.plans.inputs import PAIRS, pairs, table

KEYS = ("model", "test_set", "file", "page")
ASCII = tx.Normalisation(unicode_form="", halfwidth=False)

metrics.register_metric("cer", lambda r, h: {"cer": metrics.cer(r, h)})


metrics.register_metric("wer", lambda r, h: {"wer": metrics.wer(tx.words(r), tx.words(h))})
metrics.register_metric("bleu", lambda r, h, max_n=4: {"bleu": metrics.bleu(tx.words(r), tx.words(h), max_n)})
metrics.register_metric("bag_of_words", lambda r, h: metrics.bag_of_words(tx.words(r), tx.words(h)))


def normal_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs normalised, spread over tasks: the table is one small file, the metrics are long."""
    spread = pairs(spark, sf_dir).repartition(spark.sparkContext.defaultParallelism * 2, *KEYS)
    return spread.select(*KEYS, tx.normalise(F.col("gt"), ASCII).alias("r"), tx.normalise(F.col("pred"), ASCII).alias("h"))


def _null(c):
    return F.round(F.when(~F.isnan(c), c), 6)


def page_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.build_metrics(["cer", "no such metric"], F.col("r"), F.col("h"))
    return normal_pairs(spark, sf_dir).select(*KEYS, *[c.alias(k) for k, c in found.items()])


NORMAL = f"""{PAIRS}, n AS (SELECT model, test_set, file, page, trim(regexp_replace(gt, '\\s+', ' ', 'g')) AS r, trim(regexp_replace(pred, '\\s+', ' ', 'g')) AS h FROM pairs)"""
CER = "CASE WHEN length(r) = 0 THEN NULL WHEN length(h) = 0 THEN 1.0::DOUBLE ELSE levenshtein(r, h) / length(r)::DOUBLE END"

register("metric_cer", lambda s, d: page_scores(s, d).withColumn("cer", _null(F.col("cer"))), f"{NORMAL} SELECT model, test_set, file, page, round({CER}, 6) AS cer FROM n")


def _metric(name: str) -> DataFrame:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        worded = normal_pairs(spark, sf_dir)
        found = metrics.build_metrics([name], F.col("r"), F.col("h"))
        return worded.select(*KEYS, *[_null(c).alias(k) for k, c in found.items()])

    return query


register("metric_wer", _metric("wer"))
WORDS = f"""{NORMAL}, rw AS (SELECT model, test_set, file, page, w, count(*) AS c FROM (SELECT model, test_set, file, page, unnest(string_split(r, ' ')) AS w FROM n) WHERE w <> '' GROUP BY ALL),
  hw AS (SELECT model, test_set, file, page, w, count(*) AS c FROM (SELECT model, test_set, file, page, unnest(string_split(h, ' ')) AS w FROM n) WHERE w <> '' GROUP BY ALL),
  x AS (SELECT coalesce(a.model, b.model) AS model, coalesce(a.file, b.file) AS file, coalesce(a.page, b.page) AS page, sum(least(coalesce(a.c, 0), coalesce(b.c, 0))) AS o, sum(coalesce(a.c, 0)) AS nr, sum(coalesce(b.c, 0)) AS nh,
    count(*) AS u, sum(CASE WHEN a.c > 0 AND b.c > 0 THEN 1 ELSE 0 END) AS i FROM rw a FULL JOIN hw b ON a.model = b.model AND a.file = b.file AND a.page = b.page AND a.w = b.w GROUP BY 1, 2, 3)"""
register(
    "metric_bow", _metric("bag_of_words"),
    f"""{WORDS} SELECT n.model, n.test_set, n.file, n.page,
      CASE WHEN x.u IS NULL THEN 1.0 WHEN nr = 0 OR nh = 0 THEN 0.0 ELSE round(o / nh::DOUBLE, 6) END::DOUBLE AS bow_precision,
      CASE WHEN x.u IS NULL THEN 1.0 WHEN nr = 0 THEN NULL WHEN nh = 0 THEN 0.0 ELSE round(o / nr::DOUBLE, 6) END::DOUBLE AS bow_recall,
      CASE WHEN x.u IS NULL THEN 1.0 WHEN nr = 0 THEN NULL WHEN o = 0 THEN 0.0 ELSE round(2 * o / (nr + nh)::DOUBLE, 6) END::DOUBLE AS bow_f1,
      CASE WHEN x.u IS NULL THEN 1.0 ELSE round(i / u::DOUBLE, 6) END::DOUBLE AS bow_jaccard
    FROM n LEFT JOIN x ON n.model = x.model AND n.file = x.file AND n.page = x.page""",
)
register(
    "metric_bleu", _metric("bleu"),
    f"""{NORMAL}, l AS (SELECT *, CASE WHEN r = '' THEN [] ELSE string_split(r, ' ') END AS rl, CASE WHEN h = '' THEN [] ELSE string_split(h, ' ') END AS hl FROM n),
    ks AS (SELECT unnest([1, 2, 3, 4]) AS k),
    rg AS (SELECT model, file, page, k, array_to_string(rl[i:i + k - 1], ' ') AS g, count(*) AS c FROM (SELECT model, file, page, rl, k, unnest(range(1, greatest(len(rl) - k + 2, 1))) AS i FROM l, ks) GROUP BY ALL),
    hg AS (SELECT model, file, page, k, array_to_string(hl[i:i + k - 1], ' ') AS g, count(*) AS c FROM (SELECT model, file, page, hl, k, unnest(range(1, greatest(len(hl) - k + 2, 1))) AS i FROM l, ks) GROUP BY ALL),
    p AS (SELECT hg.model, hg.file, hg.page, hg.k, sum(least(hg.c, coalesce(rg.c, 0))) / sum(hg.c)::DOUBLE AS p FROM hg LEFT JOIN rg ON hg.model = rg.model AND hg.file = rg.file AND hg.page = rg.page AND hg.k = rg.k AND hg.g = rg.g GROUP BY 1, 2, 3, 4),
    q AS (SELECT model, file, page, count(*) AS grams, min(p) AS least, sum(CASE WHEN p > 0 THEN ln(p) ELSE 0 END) / 4 AS m FROM p GROUP BY 1, 2, 3)
    SELECT l.model, l.test_set, l.file, l.page, CASE WHEN len(rl) = 0 OR len(hl) = 0 OR coalesce(grams, 0) < 4 OR least = 0 THEN 0.0::DOUBLE
      ELSE round(exp(m) * CASE WHEN len(hl) < len(rl) THEN exp(1 - len(rl) / len(hl)::DOUBLE) ELSE 1 END, 6) END AS bleu FROM l LEFT JOIN q ON l.model = q.model AND l.file = q.file AND l.page = q.page""",
)


def _char_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("precision double, recall double, f1 double")
    def score(r: pd.Series, h: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([alignment.char_f1(a, b) for a, b in zip(r, h, strict=True)], columns=["precision", "recall", "f1"])

    return normal_pairs(spark, sf_dir).select(*KEYS, score("r", "h").alias("s")).select(*KEYS, "s.*")


register("metric_char_f1", _char_f1)


def _diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters in runs of each kind, per pair."""

    @F.pandas_udf("array<struct<kind:string,old:string,new:string>>")
    def ops(r: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series([[{"kind": k, "old": a, "new": b} for k, a, b in alignment.diff_ops(x, y)] for x, y in zip(r, h, strict=True)])

    found = normal_pairs(spark, sf_dir).select(*KEYS, F.explode(ops("r", "h")).alias("o"))
    return found.groupBy(*KEYS, F.col("o.kind").alias("kind")).agg(F.count("*").alias("runs"), F.sum(F.char_length("o.old")).alias("old_chars"), F.sum(F.char_length("o.new")).alias("new_chars"))


register("text_diff_ops", _diff)


def _html(lines: Column) -> Column:
    return F.concat(F.lit("<table>"), F.array_join(F.transform(lines, lambda x: x["c"]), ""), F.lit("</table>"))


def _tables(spark: SparkSession, sf_dir: str, *parts: str) -> DataFrame:
    """A table of the order lines of each page, or of each part of a page, and the predicted one: misread, short of its first
    line, in order of parts instead of lines, or equal."""
    cell = F.concat(F.lit("<tr><td>"), F.col("l_linenumber").cast("string"), F.lit("</td><td>"), F.col("l_quantity").cast("string"), F.lit("</td></tr>"))
    rows = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "page").repartition("page")  # the only shuffle, before there are texts
    made = rows.groupBy("page", *parts).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", cell.alias("c")))).alias("lines"))
    kind, lines, gt = F.col("page") % 4, F.col("lines"), F.col("gt")
    by_part = F.transform(F.sort_array(F.transform(lines, lambda x: F.struct(x["l_partkey"].alias("p"), x.alias("x")))), lambda x: x["x"])
    return made.withColumn("gt", _html(lines)).withColumn(
        "pred", F.when(kind == 0, F.replace(gt, F.lit("<td>1"), F.lit("<td>7"))).when(kind == 1, _html(F.slice(lines, 2, F.size(lines)))).when(kind == 2, _html(by_part)).otherwise(gt)
    ).drop("lines")


#: A predicted table that no reference has.
SPURIOUS = "<table><tr><td>1</td></tr></table>"


def _teds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page has a table for each return flag. Its predicted tables come in reverse: on one page in five the first of them is
    missing, on another one there is a table too many."""

    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([alignment.teds(list(x), list(y)) for x, y in zip(a, b, strict=True)], dtype=float)

    found = _tables(spark, sf_dir, "l_returnflag").groupBy("page").agg(F.sort_array(F.collect_list(F.struct("l_returnflag", "gt", "pred"))).alias("t"))
    pred, kind = F.reverse("t.pred"), F.col("page") % 5
    pred = F.when(kind == 0, F.slice(pred, 2, F.size(pred))).when(kind == 1, F.concat(pred, F.array(F.lit(SPURIOUS)))).otherwise(pred)
    return found.select("page", score("t.gt", pred).alias("teds"))


def _pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of a page as one table, against the predicted one."""

    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([trees.table_similarity(x, y) for x, y in zip(a, b, strict=True)], dtype=float)

    return _tables(spark, sf_dir).select("page", score("gt", "pred").alias("similarity"))


def _tree_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("long")
    def size(html: pd.Series) -> pd.Series:
        return html.map(lambda t: len(trees.parse_tree(t) or ()))

    return table(spark, sf_dir, "pages").select("page_id", size(F.coalesce("html", F.lit(""))).alias("nodes"))


register("metric_teds", _teds)
register("teds_pair", _pair)
register("html_tree_size", _tree_size)
