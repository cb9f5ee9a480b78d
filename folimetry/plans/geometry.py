"""Layout queries over order lines as boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folimetry.operators import layout as lo
from folimetry.plans.catalogue import register
from folimetry.plans.inputs import REGIONS, predictions, regions, table


def _inter(a: str, b: str, p: int = 0) -> str:
    return f"(greatest(least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1) + {p}, 0) * greatest(least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1) + {p}, 0))::DOUBLE"


def _area(a: str, p: int = 0) -> str:
    return f"(({a}.x2 - {a}.x1 + {p}) * ({a}.y2 - {a}.y1 + {p}))::DOUBLE"


def _iou(a: str, b: str, p: int = 0) -> str:
    return f"({_inter(a, b, p)} / ({_area(a, p)} + {_area(b, p)} - {_inter(a, b, p)}))"


def _both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return regions(spark, sf_dir), predictions(spark, sf_dir)


def _paired(build, name: str, pixel: int) -> None:
    """IoU of each reference box and its own prediction."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        g, p = _both(spark, sf_dir)
        met = lo.renamed(g, "g_", ("page", "idx")).join(lo.renamed(p, "p_", ("page", "idx")), ["page", "idx"])
        return met.select("page", "idx", F.round(build(lo.box("g_"), lo.box("p_")), 9).alias("iou"))

    register(name, query, f"{REGIONS} SELECT g.page, g.idx, round({_iou('g', 'p', pixel)}, 9) AS iou FROM gt g JOIN pr p ON g.page = p.page AND g.idx = p.idx")


_paired(lo.iou, "bbox_iou", 0)
_paired(lo.iou_inclusive, "bbox_iou_inclusive", 1)
_paired(lo.iou_unclamped, "bbox_iou_unclamped", 0)

register(
    "iou_matrix",
    lambda s, d: lo.iou_matrix(*_both(s, d)).groupBy("page").agg(F.count("*").alias("n"), F.round(F.sum("iou"), 6).alias("total"), F.sum(((F.col("iou") >= 0.5) & (F.col("g_category") == F.col("p_category"))).cast("long")).alias("hits")),
    f"{REGIONS} SELECT g.page, count(*) AS n, round(sum({_iou('g', 'p')}), 6) AS total, sum(CASE WHEN {_iou('g', 'p')} >= 0.5 AND g.category = p.category THEN 1 ELSE 0 END)::BIGINT AS hits FROM gt g JOIN pr p ON g.page = p.page GROUP BY g.page",
)
_RECURSIVE = REGIONS.replace("WITH raw", "WITH RECURSIVE raw", 1)
register(
    "greedy_match", lambda s, d: lo.greedy_pairs(lo.iou_matrix(*_both(s, d))),
    f"""{_RECURSIVE}, m AS (SELECT g.page, g.idx AS i, p.idx AS j, {_iou('g', 'p')} AS s FROM gt g JOIN pr p ON g.page = p.page),
    o AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY s DESC, i DESC, j DESC) AS k FROM m),
    f AS (SELECT page, k, [i] AS rs, [j] AS cs, true AS taken FROM o WHERE k = 1 UNION ALL
      SELECT o.page, o.k, CASE WHEN list_contains(rs, i) OR list_contains(cs, j) THEN rs ELSE list_append(rs, i) END, CASE WHEN list_contains(rs, i) OR list_contains(cs, j) THEN cs ELSE list_append(cs, j) END, NOT (list_contains(rs, i) OR list_contains(cs, j))
      FROM f JOIN o ON o.page = f.page AND o.k = f.k + 1)
    SELECT o.page, o.i, o.j, o.s AS score FROM f JOIN o USING (page, k) WHERE taken""",
)


def _nms_sql(keep: str) -> str:
    """Boxes by score; one is kept if `keep` holds for it (b) and every kept one (y, a list's element)."""
    return f"""{_RECURSIVE}, b AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY score DESC, idx) AS k FROM pr),
    one AS (SELECT page, k, {{'idx': idx, 'category': category, 'score': score, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} AS x, category, x1, y1, x2, y2 FROM b),
    f AS (SELECT page, k, [x] AS kept FROM one WHERE k = 1 UNION ALL
      SELECT b.page, b.k, CASE WHEN len(list_filter(f.kept, lambda y: NOT ({keep}))) = 0 THEN list_append(f.kept, b.x) ELSE f.kept END FROM f JOIN one b ON b.page = f.page AND b.k = f.k + 1),
    e AS (SELECT page, unnest(arg_max(kept, k)) AS x FROM f GROUP BY page)
    SELECT page, x.idx AS idx, x.category AS category, x.score AS score, x.x1 AS x1, x.y1 AS y1, x.x2 AS x2, x.y2 AS y2 FROM e"""


register("metric_layout_iou", lambda s, d: lo.layout_scores(*_both(s, d)))
register("metric_reading_order", lambda s, d: lo.reading_order(*_both(s, d)))
register("nms_class_aware", lambda s, d: lo.nms_class_aware(predictions(s, d), other=0.98), _nms_sql(f"{_iou('y', 'b', 1)} < CASE WHEN y.category = b.category THEN 0.6 ELSE 0.98 END"))
register("nms_greedy", lambda s, d: lo.nms_greedy(predictions(s, d)), _nms_sql(f"{_iou('y', 'b')} <= 0.5"))
register(
    "kendall_tau", lambda s, d: lo.kendall(regions(s, d), ["page"], "x1", "y1").withColumn("tau", F.round("tau", 9)),
    f"""{REGIONS}, z AS (SELECT a.page, sum(CASE WHEN a.idx < b.idx THEN sign((a.x1 - b.x1) * (a.y1 - b.y1)) ELSE 0 END) AS s,
      sum(CASE WHEN a.idx < b.idx THEN abs(sign((a.x1 - b.x1) * (a.y1 - b.y1))) ELSE 0 END) AS t FROM gt a JOIN gt b ON a.page = b.page AND a.idx <= b.idx GROUP BY a.page)
    SELECT page, CASE WHEN t = 0 THEN 1.0::DOUBLE ELSE round(s::DOUBLE / t, 9) END AS tau FROM z""",
)
_HELD = f"SELECT a.page, a.idx, b.idx AS other FROM pr a JOIN pr b ON a.page = b.page AND a.idx <> b.idx WHERE {_inter('a', 'b')} / {_area('a')} >= 0.8"
register("contained_anti", lambda s, d: lo.containment(predictions(s, d)), f"{REGIONS} {_HELD}")
register(
    "merge_large", lambda s, d: lo.merge_boxes(predictions(s, d), "large").select("page", "idx"),
    f"{REGIONS}, held AS ({_HELD}) SELECT page, idx FROM pr WHERE (page, idx) NOT IN (SELECT page, idx FROM held)",
)
register(
    "merge_small", lambda s, d: lo.merge_boxes(predictions(s, d), "small").select("page", "idx"),
    f"{REGIONS}, held AS ({_HELD}) SELECT page, idx FROM pr WHERE (page, idx) NOT IN (SELECT page, other FROM held) OR (page, idx) IN (SELECT page, idx FROM held)",
)


def _boxes(name: str, build, sql: str) -> None:
    register(name, lambda s, d: build(predictions(s, d)), f"{REGIONS} {sql}")


def _unclipped(df: DataFrame) -> DataFrame:
    return df.select("page", "idx", *[c.alias(k) for k, c in lo.unclip(lo.box(), 1.2, 1.1).items()])


_boxes("unclip_boxes", _unclipped, "SELECT page, idx, (x1 + x2) / 2.0::DOUBLE - (x2 - x1) * 1.2::DOUBLE / 2 AS x1, (y1 + y2) / 2.0::DOUBLE - (y2 - y1) * 1.1::DOUBLE / 2 AS y1, (x1 + x2) / 2.0::DOUBLE + (x2 - x1) * 1.2::DOUBLE / 2 AS x2, (y1 + y2) / 2.0::DOUBLE + (y2 - y1) * 1.1::DOUBLE / 2 AS y2 FROM pr")


def _clamped(df: DataFrame) -> DataFrame:
    made = df.select("page", "idx", *[c.alias(k) for k, c in lo.clamp(lo.box(), F.lit(760), F.lit(700)).items()])
    return made.filter((F.col("x1") < F.col("x2")) & (F.col("y1") < F.col("y2")))


_boxes("clamp_boxes", _clamped, "SELECT * FROM (SELECT page, idx, least(greatest(x1, 0), 760)::BIGINT AS x1, least(greatest(y1, 0), 700)::BIGINT AS y1, least(greatest(x2, 0), 760)::BIGINT AS x2, least(greatest(y2, 0), 700)::BIGINT AS y2 FROM pr) WHERE x1 < x2 AND y1 < y2")
_boxes(
    "large_image_filter",
    lambda df: lo.without_large_images(df, F.lit(6000), "N").select("page", "idx"),
    f"""SELECT page, idx FROM (SELECT page, idx, category = 'N' AND {_area('pr')} > 4920 AS big, sum(CASE WHEN category = 'N' AND {_area('pr')} > 4920 THEN 0 ELSE 1 END) OVER (PARTITION BY page) AS lft,
      count(*) OVER (PARTITION BY page) AS n FROM pr) WHERE n <= 1 OR lft = 0 OR NOT big""",
)


_boxes("topleft_order", lambda df: lo.reindex(df, "y1", "x1", "idx").select("page", "idx", "new_idx"), "SELECT page, idx, row_number() OVER (PARTITION BY page ORDER BY y1, x1, idx) - 1 AS new_idx FROM pr")
_boxes("reindex_regions", lambda df: lo.reindex(df.filter(F.col("score") >= 0.3), "idx").select("page", "idx", "new_idx"), "SELECT page, idx, row_number() OVER (PARTITION BY page ORDER BY idx) - 1 AS new_idx FROM pr WHERE score >= 0.3")
_LIMITS = {"A": 0.2, "R": 0.4}
_boxes(
    "class_threshold",
    lambda df: lo.above_threshold(df, _LIMITS).select("page", "idx", "category"),
    "SELECT page, idx, category FROM pr WHERE score >= CASE category WHEN 'A' THEN 0.2 WHEN 'R' THEN 0.4 ELSE 0.3 END",
)
_TASKS = {"A": "text", "N": "table", "R": "abandon"}
_boxes(
    "task_route",
    lambda df: lo.routed(df, _TASKS).groupBy("task").agg(F.count("*").alias("n")),
    "SELECT CASE category WHEN 'A' THEN 'text' WHEN 'N' THEN 'table' END AS task, count(*) AS n FROM pr WHERE category IN ('A', 'N') GROUP BY 1",
)
_boxes("category_map", lambda df: df.groupBy(lo.lookup(F.col("category"), {"A": "title", "N": "table"}, F.lit("text")).alias("mapped")).agg(F.count("*").alias("n")), "SELECT CASE category WHEN 'A' THEN 'title' WHEN 'N' THEN 'table' ELSE 'text' END AS mapped, count(*) AS n FROM pr GROUP BY 1")
_boxes("coords_restore", lambda df: df.select("page", "idx", lo.from_scale(lo.to_scale(F.col("x1"), 1240), 1240).alias("x1"), lo.to_scale(F.col("y1"), 1754).alias("y1_norm")), "SELECT page, idx, trunc(x1 / 1240.0::DOUBLE * 1000)::BIGINT / 1000.0::DOUBLE * 1240 AS x1, trunc(y1 / 1754.0::DOUBLE * 1000)::BIGINT AS y1_norm FROM pr")


def _unit_scaled(df: DataFrame) -> DataFrame:
    unit = df.withColumn("f", F.when(F.col("q") % 2 == 0, 1000.0).otherwise(1.0)).select("page", "idx", *[(F.col(s) / F.col("f")).alias(s) for s in ("x2", "y1", "x1", "y2")])
    sides = lo.from_shares(lo.box(), F.lit(1000.0), F.lit(1000.0))
    return unit.select("page", "idx", *(F.round(sides[s], 6).alias(s) for s in ("x1", "x2")))


_boxes(
    "coords_unit_scale", _unit_scaled,
    """SELECT page, idx, round(least(x1, x2) * CASE WHEN x1 <= 1 AND x2 <= 1 AND y1 <= 1 AND y2 <= 1 AND x1 >= 0 AND x2 >= 0 THEN 1000.0 ELSE 1.0 END::DOUBLE, 6) AS x1, round(greatest(x1, x2) * CASE WHEN x1 <= 1 AND x2 <= 1 AND y1 <= 1 AND y2 <= 1 AND x1 >= 0 AND x2 >= 0 THEN 1000.0 ELSE 1.0 END::DOUBLE, 6) AS x2
    FROM (SELECT page, idx, x1 / f AS x1, x2 / f AS x2, y1 / f AS y1, y2 / f AS y2 FROM (SELECT *, CASE WHEN q % 2 = 0 THEN 1000.0 ELSE 1.0 END::DOUBLE AS f FROM pr))""",
)
_boxes(
    "crop_bounds",
    lambda df: lo.crop(df, 1.5, F.lit(1200), F.lit(1200)).select("page", "idx", *lo.SIDES),
    "SELECT * FROM (SELECT page, idx, greatest(trunc(x1 * 1.5::DOUBLE - 2)::BIGINT, 0) AS x1, greatest(trunc(y1 * 1.5::DOUBLE - 2)::BIGINT, 0) AS y1, least(trunc(x2 * 1.5::DOUBLE + 2)::BIGINT, 1200) AS x2, least(trunc(y2 * 1.5::DOUBLE + 2)::BIGINT, 1200) AS y2 FROM pr) WHERE x2 - x1 >= 4 AND y2 - y1 >= 4",
)


def _rotated(df: DataFrame) -> DataFrame:
    return df.select("page", "idx", *(c.alias(s) for s, c in lo.turned(lo.box(), F.col("q")).items()))


_boxes(
    "rotated_envelope", _rotated,
    """SELECT page, idx, round(cx - dx, 1) + 0.0::DOUBLE AS x1, round(cy - dy, 1) + 0.0::DOUBLE AS y1, round(cx + dx, 1) + 0.0::DOUBLE AS x2, round(cy + dy, 1) + 0.0::DOUBLE AS y2 FROM (
      SELECT page, idx, (x1 + x2) / 2.0::DOUBLE AS cx, (y1 + y2) / 2.0::DOUBLE AS cy,
        abs((x2 - x1) / 2.0::DOUBLE * cos(radians(q))) + abs((y2 - y1) / 2.0::DOUBLE * sin(radians(q))) AS dx, abs((x2 - x1) / 2.0::DOUBLE * sin(radians(q))) + abs((y2 - y1) / 2.0::DOUBLE * cos(radians(q))) AS dy FROM pr)""",
)


def _sizes(s: SparkSession, d: str) -> DataFrame:
    w, h = F.col("p_size") * 90 + 100, F.col("p_partkey") % 3000 + 60
    (aw, ah), (lw, lh) = lo.resize_by_area(w, h), lo.resize_longest(w, h, 1288)
    return table(s, d, "part").select("p_partkey", aw.alias("area_w"), ah.alias("area_h"), lw.alias("long_w"), lh.alias("long_h"))


register(
    "resize_dims", _sizes,
    """WITH p AS (SELECT p_partkey, (p_size * 90 + 100)::DOUBLE AS w, (p_partkey % 3000 + 60)::DOUBLE AS h FROM part), n AS (SELECT *, round_even(w / 28, 0) * 28 AS rw, round_even(h / 28, 0) * 28 AS rh FROM p)
    SELECT p_partkey, (CASE WHEN rw * rh > 11760000 THEN floor(w / sqrt(w * h / 11760000) / 28) * 28 WHEN rw * rh < 12544 THEN ceil(w * sqrt(12544 / (w * h)) / 28) * 28 ELSE rw END)::BIGINT AS area_w,
      (CASE WHEN rw * rh > 11760000 THEN floor(h / sqrt(w * h / 11760000) / 28) * 28 WHEN rw * rh < 12544 THEN ceil(h * sqrt(12544 / (w * h)) / 28) * 28 ELSE rh END)::BIGINT AS area_h,
      round_even(w * (1288 / greatest(w, h)), 0)::BIGINT AS long_w, round_even(h * (1288 / greatest(w, h)), 0)::BIGINT AS long_h FROM n""",
)
register(
    "upscale_rule", lambda s, d: table(s, d, "part").select("p_partkey", lo.upscale(F.col("p_size") * 40, F.col("p_partkey") % 2500, F.col("p_type") == "ECONOMY").alias("scale")),
    "SELECT p_partkey, CASE WHEN p_size * 40 < 1500 AND p_partkey % 2500 < 1500 AND p_type = 'ECONOMY' THEN 2 ELSE 1 END AS scale FROM part",
)


def _matched(s: SparkSession, d: str) -> DataFrame:
    """First polygon (predicted box) with all four sides within 1 of the reference box; else none."""
    return lo.first_close(regions(s, d), predictions(s, d)).select("page", "idx", F.coalesce("match", F.lit(-1)).alias("poly"))


register(
    "box_match_tolerance", _matched,
    f"{REGIONS} SELECT g.page, g.idx, coalesce(min(CASE WHEN abs(g.x1 - p.x1) <= 1 AND abs(g.y1 - p.y1) <= 1 AND abs(g.x2 - p.x2) <= 1 AND abs(g.y2 - p.y2) <= 1 THEN p.idx END), -1) AS poly FROM gt g LEFT JOIN pr p ON g.page = p.page GROUP BY 1, 2",
)


def _stepped(s: SparkSession, d: str) -> DataFrame:
    w, h = F.col("p_size") * 90 + 100, F.col("p_partkey") % 3000 + 60
    rows = table(s, d, "part").select("p_partkey", lo.resize_by_steps(w, h).alias("a"), lo.resize_by_blocks(w, h).alias("b"))
    return rows.select("p_partkey", F.col("a.width").alias("step_w"), F.col("a.height").alias("step_h"), F.col("b.width").alias("grid_w"), F.col("b.height").alias("grid_h"))


register("resize_loops", _stepped)
