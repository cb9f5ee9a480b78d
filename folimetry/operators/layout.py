"""Boxes, layouts and reading order. Boxes are columns x1, y1, x2, y2, or structs of these."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folimetry.operators.alignment import assign

SIDES = ("x1", "y1", "x2", "y2")


def box(prefix: str = "") -> dict[str, Column]:
    return {s: F.col(prefix + s) for s in SIDES}


def area(b: dict[str, Column], clamp: bool = True, pixel: int = 0) -> Column:
    w, h = b["x2"] - b["x1"] + pixel, b["y2"] - b["y1"] + pixel
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0)) if clamp else w * h


def intersection(a: dict[str, Column], b: dict[str, Column], pixel: int = 0) -> Column:
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]) + pixel
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]) + pixel
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))


def iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Continuous coordinates; an empty union gives 0."""
    both = intersection(a, b)
    union = area(a) + area(b) - both
    return F.when(union <= 0, 0.0).otherwise(both / union)


def iou_inclusive(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Pixel coordinates: a box includes its last column and row."""
    both = intersection(a, b, 1)
    return both / (area(a, False, 1) + area(b, False, 1) - both)


def iou_unclamped(a: dict[str, Column], b: dict[str, Column]) -> Column:
    both = intersection(a, b)
    union = area(a, False) + area(b, False) - both
    return F.when(union <= 0, 0.0).otherwise(both / union)


def renamed(df: DataFrame, prefix: str, keys: tuple[str, ...] = ("page",)) -> DataFrame:
    return df.select(*[F.col(c).alias(c if c in keys else prefix + c) for c in df.columns])


def iou_matrix(reference: DataFrame, predicted: DataFrame) -> DataFrame:
    """IoU of every reference and predicted box of a page: an equi-join on the page."""
    met = renamed(reference, "g_").join(renamed(predicted, "p_"), "page")
    return met.select("*", iou(box("g_"), box("p_")).alias("iou"))


def greedy_pairs(scored: DataFrame, score: str = "iou") -> DataFrame:
    """(page, i, j, score): best score first, larger (i, j) on ties, each box once. Folded over a page's sorted pairs."""
    ordered = scored.groupBy("page").agg(F.sort_array(F.collect_list(F.struct(F.col(score).alias("s"), F.col("g_idx").alias("i"), F.col("p_idx").alias("j"))), asc=False).alias("pairs"))
    start = F.expr("cast(array() as array<struct<s:double,i:bigint,j:bigint>>)")

    def take(acc: Column, x: Column) -> Column:
        used = F.exists(acc, lambda y: (y["i"] == x["i"]) | (y["j"] == x["j"]))
        return F.when(used, acc).otherwise(F.concat(acc, F.array(F.struct(x["s"].cast("double").alias("s"), x["i"].cast("bigint").alias("i"), x["j"].cast("bigint").alias("j")))))

    taken = ordered.select("page", F.explode(F.aggregate("pairs", start, take)).alias("x"))
    return taken.select("page", F.col("x.i").alias("i"), F.col("x.j").alias("j"), F.col("x.s").alias("score"))


def _page_boxes(df: DataFrame, name: str) -> DataFrame:
    return df.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("idx", "category", *SIDES))).alias(name))


def _iou_array(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    low, high = np.maximum(a[:, None, :2], b[None, :, :2]), np.minimum(a[:, None, 2:], b[None, :, 2:])
    both = np.clip(high - low, 0, None).prod(axis=2)
    size = lambda x: np.clip(x[:, 2:] - x[:, :2], 0, None).prod(axis=1)
    union = size(a)[:, None] + size(b)[None] - both
    return np.where(union > 0, both / np.where(union > 0, union, 1), 0.0)


def _array(boxes) -> np.ndarray:
    return np.array([(b["x1"], b["y1"], b["x2"], b["y2"]) for b in boxes], float).reshape(-1, 4)


def layout_scores(reference: DataFrame, predicted: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Mean IoU of optimally matched boxes, precision and recall of those with IoU and category right, per page."""

    @F.pandas_udf("mean_iou double, precision double, recall double")
    def score(gt: pd.Series, pred: pd.Series) -> pd.DataFrame:
        out = []
        for g, p in zip(gt, pred, strict=True):
            g, p = ([] if x is None else x for x in (g, p))
            if not len(g) or not len(p):
                value = float("nan") if len(p) else 0.0
                out.append((1.0,) * 3 if not len(g) and not len(p) else (value,) * 3)
                continue
            m = _iou_array(_array(g), _array(p))
            pairs = assign(m)
            right = sum(m[i, j] >= threshold and g[i]["category"] == p[j]["category"] for i, j in pairs)
            out.append((float(np.mean([m[i, j] for i, j in pairs])), right / len(p), right / len(g)))
        return pd.DataFrame(out, columns=["mean_iou", "precision", "recall"])

    both = _page_boxes(reference, "g").join(_page_boxes(predicted, "p"), "page", "full")
    return both.withColumn("s", score("g", "p")).select("page", *(F.coalesce(f"s.{k}", F.lit(float("nan"))).alias(k) for k in ("mean_iou", "precision", "recall")))


def reading_order(reference: DataFrame, predicted: DataFrame) -> DataFrame:
    """Kendall's tau of the orders (idx) of optimally matched boxes, per page; NaN where fewer than two are matched."""

    @F.pandas_udf("double")
    def tau(gt: pd.Series, pred: pd.Series) -> pd.Series:
        out = []
        for g, p in zip(gt, pred, strict=True):
            g, p = ([] if x is None else x for x in (g, p))
            if len(g) < 2:
                out.append(float("nan"))
                continue
            if len(p) < 2:
                out.append(0.0)
                continue
            m = _iou_array(_array(g), _array(p))
            pairs = [(g[i]["idx"], p[j]["idx"]) for i, j in assign(m) if m[i, j] > 0]
            out.append(concordance(*np.array(pairs, float).T) if len(pairs) > 1 else float("nan"))
        return pd.Series(out)

    both = _page_boxes(reference, "g").join(_page_boxes(predicted, "p"), "page", "left")
    return both.select("page", F.coalesce(tau("g", "p"), F.lit(float("nan"))).alias("tau"))


#: Values up to which all pairs are looked at at once.
FEW = 48


def kendall(df: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Kendall's tau of two columns per key, ties and nulls left out; no untied pairs give 1. Pairs of a key are counted in
    n log n steps, so that a page of many regions doesn't become its square in rows."""

    @F.pandas_udf("double")
    def tau(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([concordance(p, q) for p, q in zip(x, y, strict=True)], dtype=float)

    known = df.select(*keys, F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.struct(F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))).alias("v"))
    pages = known.groupBy(*keys).agg(F.collect_list("v").alias("v"))
    return pages.select(*keys, tau(F.col("v.a"), F.col("v.b")).alias("tau"))


def _tied(*columns: np.ndarray) -> int:
    """Pairs that are equal in all columns."""
    _, count = np.unique(np.stack(columns, axis=1), axis=0, return_counts=True)
    return int((count * (count - 1) // 2).sum())


def _inversions(values: np.ndarray) -> int:
    """Pairs in which an earlier value is larger, by merging ever longer sorted runs."""
    x, found, width = values.copy(), 0, 1
    while width < len(x):
        for start in range(0, len(x) - width, 2 * width):
            left, right = x[start : start + width], x[start + width : start + 2 * width]
            found += int(len(left) * len(right) - np.searchsorted(left, right, "right").sum())
            x[start : start + 2 * width] = np.sort(np.concatenate([left, right]), kind="stable")
        width *= 2
    return found


def concordance(x: np.ndarray, y: np.ndarray) -> float:
    """(pairs in the same order - pairs in the other) / both, ties in either left out."""
    if len(x) <= FEW:
        sign = np.sign(np.subtract.outer(x, x)) * np.sign(np.subtract.outer(y, y))
        both = np.abs(sign).sum()
        return float(sign.sum() / both) if both else 1.0
    order = np.lexsort((y, x))
    other = _inversions(y[order])
    untied = len(x) * (len(x) - 1) // 2 - _tied(x) - _tied(y) + _tied(x, y) if len(x) else 0
    return 1.0 if not untied else (untied - 2 * other) / untied


def _suppressed(boxes: Column, keep) -> Column:
    """Fold over boxes sorted by score: a box is kept if `keep(kept, box)` holds for all kept before."""
    start = F.slice(boxes, 1, 0)
    return F.aggregate(boxes, start, lambda acc, x: F.when(F.forall(acc, lambda y: keep(y, x)), F.concat(acc, F.array(x))).otherwise(acc))


def _sides(x: Column) -> dict[str, Column]:
    return {s: x[s] for s in SIDES}


#: Boxes of a page up to which they are folded one by one; larger pages are suppressed in numpy.
FOLDED = 64


def suppress(df: DataFrame, keep, many) -> DataFrame:
    """Boxes of each page that survive, best score first, ties by idx. `keep(kept, box)` says whether a kept box leaves
    another one; `many(one, others)` says it for arrays of sides and categories, of one box and all after it."""
    order = F.struct((-F.col("score")).alias("o"), "idx", "category", "score", *SIDES)
    pages = df.groupBy("page").agg(F.sort_array(F.collect_list(order)).alias("b"))

    @F.pandas_udf("array<int>")
    def left(sides: pd.Series, categories: pd.Series) -> pd.Series:
        out = []
        for x, c in zip(sides, categories, strict=True):
            if x is None:
                out.append(None)
                continue
            boxes, names, open_, taken = np.stack(x).astype(float), np.array(c, dtype=object), np.ones(len(c), bool), []
            for k in range(len(c)):
                if open_[k]:
                    taken.append(k)
                    open_[k + 1 :] &= many((boxes[k], names[k]), (boxes[k + 1 :], names[k + 1 :]))
            out.append(taken)
        return pd.Series(out, dtype=object)

    large = F.size("b") > FOLDED
    sides = F.transform("b", lambda x: F.array(*(x[s].cast("double") for s in SIDES)))
    places = left(F.when(large, sides), F.when(large, F.col("b.category")))
    found = pages.withColumn("places", places)
    kept = F.when(F.col("places").isNotNull(), F.transform("places", lambda k: F.get("b", k))).otherwise(_suppressed(F.col("b"), keep))
    return found.select("page", F.explode(kept).alias("x")).select("page", F.col("x.idx").alias("idx"), F.col("x.category").alias("category"), F.col("x.score").alias("score"), *[F.col(f"x.{s}").alias(s) for s in SIDES])


def _overlap(one: np.ndarray, others: np.ndarray, pixel: int) -> np.ndarray:
    """IoU of one box and others, areas not clamped."""
    both = np.clip(np.minimum(one[2:], others[:, 2:]) - np.maximum(one[:2], others[:, :2]) + pixel, 0, None).prod(axis=1)
    union = (one[2:] - one[:2] + pixel).prod() + (others[:, 2:] - others[:, :2] + pixel).prod(axis=1) - both
    with np.errstate(divide="ignore", invalid="ignore"):
        return both / union if pixel else np.where(union <= 0, 0.0, both / union)


def nms_class_aware(df: DataFrame, same: float = 0.6, other: float = 0.95) -> DataFrame:
    """Inclusive IoU; a box is kept if it is below the threshold against every kept one."""
    return suppress(
        df, lambda y, x: iou_inclusive(_sides(y), _sides(x)) < F.when(y["category"] == x["category"], same).otherwise(other),
        lambda one, others: _overlap(one[0], others[0], 1) < np.where(others[1] == one[1], same, other),
    )


def nms_greedy(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Whatever the category; suppressed above the threshold."""
    return suppress(df, lambda y, x: iou_unclamped(_sides(y), _sides(x)) <= threshold, lambda one, others: _overlap(one[0], others[0], 0) <= threshold)


def containment(df: DataFrame, share: float = 0.8) -> DataFrame:
    """Every ordered pair of a page's boxes of which the first (idx) lies in the second (other) by that share of its area."""
    a, b = renamed(df, "a_"), renamed(df, "b_")
    inside = intersection(box("a_"), box("b_")) / area(box("a_")) >= share
    return a.join(b, "page").filter((F.col("a_idx") != F.col("b_idx")) & (area(box("a_")) > 0) & inside).select("page", F.col("a_idx").alias("idx"), F.col("b_idx").alias("other"))


def merge_boxes(df: DataFrame, mode: str, share: float = 0.8) -> DataFrame:
    """union: all; large: those in no other; small: those that hold no other, or lie in one."""
    if mode == "union":
        return df
    held = containment(df, share)
    if mode == "large":
        return df.join(held.select("page", "idx").distinct(), ["page", "idx"], "left_anti")
    holders = held.select("page", F.col("other").alias("idx")).distinct().withColumn("holds", F.lit(True))
    inside = held.select("page", "idx").distinct().withColumn("inside", F.lit(True))
    return df.join(holders, ["page", "idx"], "left").join(inside, ["page", "idx"], "left").filter(F.col("holds").isNull() | F.col("inside").isNotNull()).drop("holds", "inside")


def unclip(b: dict[str, Column], across: float, down: float) -> dict[str, Column]:
    cx, cy = (b["x1"] + b["x2"]) / 2, (b["y1"] + b["y2"]) / 2
    w, h = (b["x2"] - b["x1"]) * across / 2, (b["y2"] - b["y1"]) * down / 2
    return {"x1": cx - w, "y1": cy - h, "x2": cx + w, "y2": cy + h}


def clamp(b: dict[str, Column], width: Column, height: Column) -> dict[str, Column]:
    inside = lambda v, most: F.least(F.greatest(v, F.lit(0)), most).cast("long")
    return {"x1": inside(b["x1"], width), "y1": inside(b["y1"], height), "x2": inside(b["x2"], width), "y2": inside(b["y2"], height)}


def lookup(key: Column, names: dict[str, object], default: Column | None = None) -> Column:
    """The value of a key; of other keys the default, null without one."""
    found = F.element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), key)
    return found if default is None else F.coalesce(found, default)


def above_threshold(df: DataFrame, limits: dict[str, float], other: float = 0.3) -> DataFrame:
    """Boxes whose score reaches their category's limit; categories without one have `other`."""
    return df.filter(F.col("score") >= lookup(F.col("category"), limits, F.lit(other)))


def routed(df: DataFrame, tasks: dict[str, str], dropped: tuple[str, ...] = ("abandon",)) -> DataFrame:
    """Boxes with their category's task; those without a task, or with a dropped one, are left out."""
    return df.withColumn("task", lookup(F.col("category"), tasks)).filter(F.col("task").isNotNull() & ~F.col("task").isin(*dropped))


def without_large_images(df: DataFrame, page_area: Column, image: str = "image", share: float = 0.82) -> DataFrame:
    """Without images above a share of the page, on pages of several boxes of which some would stay."""
    page = Window.partitionBy("page")
    sized = df.withColumn("__big", (F.col("category") == image) & (area(box()) > share * page_area))
    counted = sized.withColumns({"__left": F.sum((~F.col("__big")).cast("int")).over(page), "__all": F.count("*").over(page)})
    return counted.filter((F.col("__all") <= 1) | (F.col("__left") == 0) | ~F.col("__big")).drop("__big", "__left", "__all")


def to_scale(value: Column, size: Column | float, scale: int = 1000) -> Column:
    """A pixel coordinate as a whole number out of `scale`."""
    return (value / size * scale).cast("long")


def from_scale(value: Column, size: Column | float, scale: int = 1000) -> Column:
    return value / scale * size


def from_shares(b: dict[str, Column], width: Column, height: Column) -> dict[str, Column]:
    """Pixels of a box that may be given in shares of the page (all sides between 0 and 1); reversed sides are swapped."""
    shares = F.lit(True)
    for side in SIDES:
        shares = shares & b[side].between(0, 1)
    sides = {s: b[s] * F.when(shares, width if s[0] == "x" else height).otherwise(1.0) for s in SIDES}
    out = {}
    for axis in "xy":
        out[axis + "1"], out[axis + "2"] = (pick(sides[axis + "1"], sides[axis + "2"]) for pick in (F.least, F.greatest))
    return out


def crop(df: DataFrame, scale: Column | float, width: Column, height: Column, pad: int = 2, least: int = 4) -> DataFrame:
    """Boxes scaled, widened by a pad and cut at the page, in whole pixels; those below a least side are left out."""
    low = {s: F.greatest((F.col(s) * scale - pad).cast("long"), F.lit(0)) for s in ("x1", "y1")}
    high = {s: F.least((F.col(s) * scale + pad).cast("long"), size) for s, size in (("x2", width), ("y2", height))}
    return df.withColumns(low | high).filter((F.col("x2") - F.col("x1") >= least) & (F.col("y2") - F.col("y1") >= least))


def turned(b: dict[str, Column], degrees: Column) -> dict[str, Column]:
    """The upright box, to a tenth, around one that is turned about its centre."""
    a, cx, cy = F.radians(degrees.cast("double")), (b["x1"] + b["x2"]) / 2, (b["y1"] + b["y2"]) / 2
    w, h = (b["x2"] - b["x1"]) / 2, (b["y2"] - b["y1"]) / 2
    across, down = F.abs(w * F.cos(a)) + F.abs(h * F.sin(a)), F.abs(w * F.sin(a)) + F.abs(h * F.cos(a))
    sides = {"x1": cx - across, "y1": cy - down, "x2": cx + across, "y2": cy + down}
    return {s: F.round(c, 1) + 0.0 for s, c in sides.items()}


def upscale(width: Column, height: Column, wanted: Column, below: int = 1500) -> Column:
    """2 for small pages where it is wanted, else 1."""
    return F.when((width < below) & (height < below) & wanted, 2).otherwise(1)


def reindex(df: DataFrame, *order: str) -> DataFrame:
    """Contiguous numbers from 0 over each page's remaining boxes."""
    return df.withColumn("new_idx", (F.row_number().over(Window.partitionBy("page").orderBy(*order)) - 1).cast("long"))


def resize_by_area(width: Column, height: Column, factor: int = 28, least: int = 112 * 112, most: int = 14 * 14 * 4 * 15000) -> tuple[Column, Column]:
    """Sides as multiples of a factor: rounded half-even, then scaled down or up by the root of the area's excess."""
    w, h = F.bround(width / factor) * factor, F.bround(height / factor) * factor
    shrink, grow = F.sqrt(width * height / most), F.sqrt(least / (width * height))
    pick = lambda near, side: F.when(w * h > most, F.floor(side / shrink / factor) * factor).when(w * h < least, F.ceil(side * grow / factor) * factor).otherwise(near)
    return pick(w, width).cast("long"), pick(h, height).cast("long")


def resize_longest(width: Column, height: Column, longest: int) -> tuple[Column, Column]:
    scale = longest / F.greatest(width, height)
    return F.bround(width * scale).cast("long"), F.bround(height * scale).cast("long")


def _resized(width: Column, height: Column, pick) -> Column:
    """struct<width, height> that `pick` finds for each pair of sides; null where one is missing."""

    @F.pandas_udf("width long, height long")
    def run(widths: pd.Series, heights: pd.Series) -> pd.DataFrame:
        known = [pick(int(w), int(h)) if w == w and h == h and w is not None and h is not None else (None, None) for w, h in zip(widths, heights, strict=True)]
        return pd.DataFrame(known, columns=["width", "height"]).astype("Int64")

    return run(width, height)


def sides_by_steps(width: int, height: int, factor: int, least: int, most: int) -> tuple[int, int]:
    """Sides as multiples of a factor with an area between bounds: scaled by the root of the area's excess, rounded
    half-even, then the longer side loses, or the shorter one gains, a factor at a time until the area fits."""
    area = width * height
    if least <= area <= most and not width % factor and not height % factor:
        return width, height
    scale = (least / area) ** 0.5 if area < least else (most / area) ** 0.5 if area > most else 1.0
    sides = [max(factor, round(int(v * scale) / factor) * factor) for v in (width, height)]
    while sides[0] * sides[1] > most and max(sides) > factor:
        sides[0 if sides[0] > sides[1] else 1] -= factor
    while sides[0] * sides[1] < least:
        sides[0 if sides[0] < sides[1] else 1] += factor
    return max(factor, sides[0]), max(factor, sides[1])


def sides_by_blocks(width: int, height: int, grid: int, least: int, most: int) -> tuple[int, int]:
    """Sides as whole blocks of a grid, scaled into the bounds of area; while they are too large, the side goes down whose
    loss leaves the aspect ratio nearer to the original, height on a tie."""
    if width <= 0 or height <= 0:
        return width, height
    area, ratio = width * height, width / height
    scale = (most / area) ** 0.5 if area > most else (least / area) ** 0.5 if area < least else 1.0
    across, down = (max(1, round(v * scale / grid)) for v in (width, height))
    while across * down * grid * grid > most and (across, down) != (1, 1):
        narrower = down == 1 or (across > 1 and abs((across - 1) / down - ratio) < abs(across / (down - 1) - ratio))
        across, down = (across - 1, down) if narrower else (across, down - 1)
    return across * grid, down * grid


def resize_by_steps(width: Column, height: Column, factor: int = 28, least: int = 3136, most: int = 11_289_600) -> Column:
    return _resized(width, height, lambda w, h: sides_by_steps(w, h, factor, least, most))


def resize_by_blocks(width: Column, height: Column, grid: int = 28, least: int = 1792 * 28, most: int = 3072 * 2048) -> Column:
    return _resized(width, height, lambda w, h: sides_by_blocks(w, h, grid, least, most))


#: Sides of a cell in tolerances: most boxes then look into one cell.
CELL = 32


def first_close(reference: DataFrame, candidates: DataFrame, page: str = "page", place: str = "idx", tolerance: float = 1.0) -> DataFrame:
    """(page, place, match) of each reference box: the smallest place of a candidate on its page with all four sides within
    the tolerance, or null. Boxes meet by cells of their left and top sides, CELL tolerances wide: a candidate is in one, a
    reference box looks into those that its tolerance reaches, four at most. Boxes with a null side match nothing; reference
    rows with the same page and place are one."""
    if tolerance <= 0:
        raise ValueError("the tolerance must be above 0")

    def cell(side: Column) -> Column:
        return F.floor(side.cast("double") / (CELL * tolerance))

    def reached(side: str) -> Column:
        # a little further than the tolerance, for sums of doubles are rounded
        reach = tolerance * (1 + 1e-9) + F.abs(F.col(side).cast("double")) * 1e-15
        return F.array_distinct(F.array(cell(F.col(side) - reach), cell(F.col(side)), cell(F.col(side) + reach)))

    cells = F.flatten(F.transform(reached("x1"), lambda i: F.transform(reached("y1"), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    asked = reference.select(
        F.col(page).alias("__page"), F.col(place).alias("__place"), *(F.col(c).alias(f"__{c}") for c in SIDES), F.explode_outer(cells).alias("__n"),
    ).select("__page", "__place", *(f"__{c}" for c in SIDES), F.col("__n.i").alias("__i"), F.col("__n.j").alias("__j"))
    there = candidates.select(page, F.col(place).alias("__match"), *SIDES, cell(F.col("x1")).alias("__i"), cell(F.col("y1")).alias("__j"))
    close = reduce(lambda x, y: x & y, (F.abs(F.col(c) - F.col(f"__{c}")) <= tolerance for c in SIDES))
    met = asked.join(there, (F.col("__page") == F.col(page)) & (asked["__i"] == there["__i"]) & (asked["__j"] == there["__j"]) & close, "left")
    return met.groupBy(F.col("__page").alias(page), F.col("__place").alias(place)).agg(F.min("__match").alias("match"))
