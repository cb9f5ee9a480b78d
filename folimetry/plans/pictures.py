"""Image queries: pages' sources as pixels, 64 to a row, through decoders, degradations and masks."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folimetry.operators import degrade
from folimetry.operators.crops import crop_regions, draw_boxes, limit_images
from folimetry.plans.catalogue import register
from folimetry.plans.inputs import table
from folimetry.sources import images

WIDTH = 64
_ROW = 3 * WIDTH


def page_pixels(s: SparkSession, d: str) -> DataFrame:
    """page_id, width, height and pixels: the bytes of a page's source, filled up with spaces to whole rows, one at least."""
    html = F.coalesce("html", F.lit(""))
    height = F.greatest(F.ceil(F.octet_length(html) / _ROW), F.lit(1)).cast("int")
    filled = F.concat(html.cast("binary"), F.repeat(F.lit(" "), height * _ROW - F.octet_length(html)).cast("binary"))
    return table(s, d, "pages").select("page_id", F.lit(WIDTH).alias("width"), height.alias("height"), filled.alias("pixels"))


_PIXELS = f"""WITH r AS (SELECT page_id, coalesce(html, '') AS html, greatest(ceil(octet_length(encode(coalesce(html, ''))) / {_ROW}.0), 1)::INT AS height FROM pages),
p AS (SELECT page_id, {WIDTH} AS width, height, html || repeat(' ', (height * {_ROW} - octet_length(encode(html)))::INT) AS pixels FROM r)"""


def _sums(pixels: Column) -> tuple[Column, Column]:
    """Sum of all bytes, and of all bytes times their place from 1."""

    @F.pandas_udf("struct<total:long,checksum:long>")
    def run(rows: pd.Series) -> pd.DataFrame:
        arrays = [np.frombuffer(r, np.uint8).astype(np.int64) for r in rows]
        return pd.DataFrame({"total": [a.sum() for a in arrays], "checksum": [(a * np.arange(1, len(a) + 1)).sum() for a in arrays]}, dtype="int64")

    made = run(pixels)
    return made["total"].alias("total"), made["checksum"].alias("checksum")


# --- decoding


def _decoded(s: SparkSession, d: str) -> DataFrame:
    """Every page written as PNG or, every third, as PPM, and read back; every fifth cut off in the middle."""
    pages = page_pixels(s, d)
    ppm = F.concat(F.concat(F.lit(f"P6\n{WIDTH} "), F.col("height").cast("string"), F.lit("\n255\n")).cast("binary"), "pixels")

    @F.pandas_udf("binary")
    def png(pixels: pd.Series) -> pd.Series:
        return pixels.map(lambda p: images.encode_png(np.frombuffer(p, np.uint8).reshape(-1, WIDTH, 3)))

    whole = F.when(F.col("page_id") % 3 == 0, ppm).otherwise(png("pixels"))
    cut = F.when(F.col("page_id") % 5 == 0, F.substring(whole, F.lit(1), F.floor(F.octet_length(whole) / 2).cast("int"))).otherwise(whole)
    read = images.decode_images(pages.select("page_id", cut.alias("content")))
    return read.select("page_id", "width", "height", F.md5("pixels").alias("digest"), F.col("error").isNotNull().alias("broken"))


register(
    "image_decode", _decoded,
    f"""{_PIXELS} SELECT page_id, CASE WHEN page_id % 5 <> 0 THEN width END AS width, CASE WHEN page_id % 5 <> 0 THEN height END AS height,
    CASE WHEN page_id % 5 <> 0 THEN md5(pixels) END AS digest, page_id % 5 = 0 AS broken FROM p""",
)

# --- degradations


def _step(name: str, amount: float):
    def build(s: SparkSession, d: str) -> DataFrame:
        made = page_pixels(s, d).select("page_id", "height", degrade.degraded(F.col("pixels"), F.lit(name), F.lit(amount), F.col("width")).alias("pixels"))
        return made.select("page_id", "height", *_sums(F.col("pixels")))

    return build


BLUR_RADIUS = 1.0
register(
    "degrade_blur", _step(degrade.BLUR, BLUR_RADIUS),
    f"""{_PIXELS}, k AS (SELECT i, exp(-0.5 * (i / {BLUR_RADIUS}) ** 2) / (SELECT sum(exp(-0.5 * (j / {BLUR_RADIUS}) ** 2)) FROM range(-3, 4) t(j)) AS w FROM range(-3, 4) u(i)),
    b AS (SELECT page_id, height, string_split_regex(regexp_replace(hex(encode(pixels)), '(..)', '\\1 ', 'g').trim(), ' ') AS bytes FROM p),
    v AS (SELECT page_id, height, unnest(bytes) AS hex, (generate_subscripts(bytes, 1) - 1)::INT AS pos FROM b),
    x AS (SELECT page_id, height, pos // {_ROW} AS y, pos % {_ROW} // 3 AS x, pos % 3 AS c, ('0x' || hex)::INT AS v FROM v),
    a AS (SELECT page_id, height, y, t AS x, c, sum(w * v) AS v FROM x, k, (SELECT range AS t FROM range({WIDTH})) WHERE least(greatest(t + i, 0), {WIDTH - 1}) = x GROUP BY ALL),
    q AS (SELECT page_id, height, unnest(range(0, height)) AS t FROM p),
    o AS (SELECT q.page_id, q.height, q.t AS y, a.x, a.c, floor(sum(w * a.v) + 0.5)::BIGINT AS v FROM q CROSS JOIN k JOIN a ON a.page_id = q.page_id AND a.y = least(greatest(q.t + k.i, 0), q.height - 1) GROUP BY ALL)
    SELECT page_id, height, sum(v)::BIGINT AS total, sum(v * (y * {_ROW} + x * 3 + c + 1))::BIGINT AS checksum FROM o GROUP BY 1, 2""",
)
register("degrade_jpeg", _step(degrade.JPEG, 50.0))
register("degrade_rotate", _step(degrade.ROTATE, 5.0))
register("degrade_dpi", _step(degrade.DPI, 0.5))

STEPS = [
    {"name": "noise", "params": {"sigma": [10, 25]}}, {"name": "salt_and_pepper", "params": {"amount": 0.25}}, {"name": "unknown", "params": {}}, {"name": "blur"},
    {"name": "jpeg", "params": {"quality": [30, 90]}}, {"name": "rotate", "params": {"degrees": 5}}, {"name": "dpi_reduction", "params": {"factor": 0.5}},
]
LABELS = ("", "noise_sigma=10", "noise_sigma=25", "salt_and_pepper(amount=0.25)", "blur()", "jpeg_quality=30", "jpeg_quality=90", "rotate(degrees=5)", "dpi_reduction(factor=0.5)")
register(
    "degradation_sweep", lambda s, d: degrade.sweep(page_pixels(s, d), STEPS, width="width").select("page_id", "degradation_label", F.octet_length("pixels").cast("long").alias("bytes")),
    f"{_PIXELS} SELECT page_id, label AS degradation_label, octet_length(encode(pixels)) AS bytes FROM p, (VALUES {', '.join(f'({x!r})' for x in LABELS)}) v(label)",
)


def _grid(s: SparkSession, d: str) -> DataFrame:
    """Each user's events as a list of steps: one that sweeps two parameters, one with fixed ones, one unknown."""
    users = table(s, d, "events").groupBy("user_id").agg(F.min("event_id").alias("a"), F.max("event_id").alias("b"), F.count("*").alias("n"))
    text = F.format_string('[{"name":"noise","params":{"sigma":[%s,%s],"seed":[1,%s],"mode":"x"}},{"name":"jpeg","params":{"quality":%s}},{"name":"blur"},{"name":"u%s"}]', "a", "b", "n", "n", "n")
    return degrade.variants_of(users.select("user_id", F.when(F.col("user_id") % 9 == 8, "[broken").otherwise(text).alias("steps"))).select("user_id", "label", "name", F.size("params").cast("long").alias("params"))


register(
    "degradation_grid", _grid,
    """WITH u AS (SELECT user_id, min(event_id) AS a, max(event_id) AS b, count(*) AS n FROM events GROUP BY 1 HAVING user_id % 9 <> 8)
    SELECT user_id, 'noise_sigma=' || s || '_seed=' || e AS label, 'noise' AS name, 3::BIGINT AS params FROM (SELECT user_id, unnest([a, b]) AS s, n FROM u) v, LATERAL (SELECT unnest([1, n]) AS e) w
    UNION ALL SELECT user_id, 'jpeg(quality=' || n || ')', 'jpeg', 1 FROM u UNION ALL SELECT user_id, 'blur()', 'blur', 0 FROM u""",
)

# --- masks

# a star whose points, in thousandths, move with the page
_STAR = ((500, 20), (640, 950), (30, 400), (970, 380), (300, 960))


def _masked(s: SparkSession, d: str) -> DataFrame:
    """Pixels that a crop by a polygon keeps, of black pages on white."""
    pages = page_pixels(s, d)
    shift = (F.col("page_id") % 30).cast("double")
    points = F.array(*(F.array(F.lit(float(x)) - shift, F.lit(float(y)) + shift) for x, y in _STAR))
    box = F.array(F.lit(0.0), F.lit(0.0), F.lit(1000.0), F.lit(1000.0))
    black = pages.withColumn("pixels", F.repeat(F.lit("\u0000"), F.octet_length("pixels")).cast("binary"))
    made = crop_regions(black, "pixels", "width", box, points)
    size = F.octet_length("crop.pixels")
    kept = F.octet_length(F.regexp_replace(F.hex("crop.pixels"), "FF", "").cast("binary")) / 2
    return made.select("page_id", F.col("crop.width").alias("width"), F.col("crop.height").alias("height"), (kept / 3).cast("long").alias("kept"), (size / 3).cast("long").alias("pixels"))


register(
    "polygon_crop", _masked,
    f"""{_PIXELS}, pt AS (SELECT page_id, height, k, trunc((x - page_id % 30) * {WIDTH} / 1000)::BIGINT AS x, trunc((y + page_id % 30) * height / 1000)::BIGINT AS y
      FROM p, (VALUES {', '.join(f'({k}, {x}, {y})' for k, (x, y) in enumerate(_STAR))}) s(k, x, y)),
    e AS (SELECT a.page_id, a.x AS x0, a.y AS y0, b.x AS x1, b.y AS y1 FROM pt a JOIN pt b ON a.page_id = b.page_id AND b.k = (a.k + 1) % {len(_STAR)}),
    g AS (SELECT page_id, width, height, unnest(range(0, height)) AS y FROM p),
    c AS (SELECT g.page_id, g.y, t.x,
        bool_or((e.x1 - e.x0) * (g.y - e.y0) = (e.y1 - e.y0) * (t.x - e.x0) AND t.x BETWEEN least(e.x0, e.x1) AND greatest(e.x0, e.x1) AND g.y BETWEEN least(e.y0, e.y1) AND greatest(e.y0, e.y1)) AS edge,
        sum(CASE WHEN (e.y0 <= g.y) <> (e.y1 <= g.y) AND (t.x - e.x0) * abs(e.y1 - e.y0) < (g.y - e.y0) * (e.x1 - e.x0) * sign(e.y1 - e.y0) THEN 1 ELSE 0 END) % 2 = 1 AS inside
      FROM g JOIN e USING (page_id), range({WIDTH}) t(x) GROUP BY ALL)
    SELECT page_id, any_value(width) AS width, any_value(height)::INT AS height, count(*) FILTER (WHERE edge OR inside) AS kept, count(*) AS pixels FROM c JOIN p USING (page_id) GROUP BY page_id""",
)


def _framed(s: SparkSession, d: str) -> DataFrame:
    """White pixels of two frames drawn on black pages; the second reaches beyond the page."""
    black = page_pixels(s, d).withColumn("pixels", F.repeat(F.lit("\u0000"), F.octet_length("pixels")).cast("binary"))
    x, y = (F.col("page_id") % 40).cast("double"), (F.col("page_id") % 11).cast("double")
    boxes = F.array(*(F.struct(*(c.alias(n) for n, c in zip(("x1", "y1", "x2", "y2"), b, strict=True))) for b in ((x, y, x + 20, y + 9), (x + 30, y + 5, x + 90, y + 500))))
    made = draw_boxes(black, "pixels", "width", boxes, (255, 255, 255))
    return made.select("page_id", "width", "height", (F.octet_length(F.regexp_replace(F.hex("pixels"), "00", "")) / 6).cast("long").alias("drawn"))


register(
    "page_frames", _framed,
    f"""{_PIXELS}, b AS (SELECT page_id, height, page_id % 40 AS x1, page_id % 11 AS y1, page_id % 40 + 20 AS x2, page_id % 11 + 9 AS y2 FROM p UNION ALL SELECT page_id, height, page_id % 40 + 30, page_id % 11 + 5, page_id % 40 + 90, page_id % 11 + 500 FROM p),
    g AS (SELECT page_id, height, unnest(range(0, height)) AS y FROM p),
    c AS (SELECT g.page_id, g.y, t.x, bool_or(t.x BETWEEN x1 AND x2 AND g.y BETWEEN y1 AND y2 AND NOT (t.x BETWEEN x1 + 2 AND x2 - 2 AND g.y BETWEEN y1 + 2 AND y2 - 2)) AS hit FROM g JOIN b USING (page_id), range({WIDTH}) t(x) GROUP BY 1, 2, 3)
    SELECT page_id, any_value(width) AS width, any_value(height) AS height, count(*) FILTER (WHERE hit) AS drawn FROM c JOIN p USING (page_id) GROUP BY 1""",
)
register(
    "image_limit", lambda s, d: limit_images(page_pixels(s, d), "pixels", "width", 50).select("page_id", F.col("width").cast("long").alias("width"), (F.octet_length("pixels") / (3 * F.col("width"))).cast("long").alias("height")),
    f"""{_PIXELS}, m AS (SELECT page_id, width, height, least(1.0::DOUBLE, 50::DOUBLE / greatest(width, height)) AS f FROM p)
    SELECT page_id, CASE WHEN f < 1 THEN greatest(trunc(width * f), 1) ELSE width END::BIGINT AS width, CASE WHEN f < 1 THEN greatest(trunc(height * f), 1) ELSE height END::BIGINT AS height FROM m""",
)
