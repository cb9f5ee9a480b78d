"""Degradations, crops and frames as DataFrame operators; annotation exports of different sizes behind a shuffle."""

import json

import numpy as np
from pyspark.sql import functions as F

from folimetry.operators import crops, degrade, raster
from folimetry.sources import files


def test_sweep_of_all_six_steps(spark):
    page = np.random.default_rng(0).integers(0, 256, (20, 30, 3)).astype(np.uint8)
    steps = [{"name": n} for n in degrade.KNOWN] + [{"name": "jpeg", "params": {"quality": [10, 90]}}, {"name": "nothing"}]
    rows = [(1, page.tobytes(), 30), (2, None, 30), (3, page.tobytes()[:-1], 30), (4, b"", 30), (5, b"abcdef", None)]
    got = {(r.k, r.degradation_label): r.pixels for r in degrade.sweep(spark.createDataFrame(rows, "k int, pixels binary, w int"), steps, width="w").collect()}
    assert len(got) == 5 * 9
    want = {
        "": page, "blur()": raster.blurred(page, 2), "jpeg()": raster.recompressed(page, 50), "jpeg_quality=10": raster.recompressed(page, 10), "jpeg_quality=90": raster.recompressed(page, 90),
        "rotate()": raster.rotated(page, 5), "dpi_reduction()": raster.coarsened(page, 0.5), "noise()": degrade.gaussian(page, 25.0), "salt_and_pepper()": degrade.salt_pepper(page, 0.02),
    }
    for label, p in want.items():
        assert bytes(got[1, label]) == p.tobytes(), label
        assert got[2, label] is None and bytes(got[3, label]) == page.tobytes()[:-1] and bytes(got[4, label]) == b"" and len(got[5, label]) == 6


def test_step_lists_that_are_data(spark):
    lists = [
        [{"name": "noise", "params": {"sigma": [10, 25.5], "seed": 3, "mode": ["a", "b"]}}, {"name": "unknown", "params": {"x": [1]}}, {"name": "blur"}],
        [{"name": "jpeg", "params": {"quality": []}}, {"name": "rotate", "params": {}}], [], [{}],
    ]
    rows = [(i, json.dumps(x)) for i, x in enumerate(lists)] + [(9, "{broken"), (10, None), (11, "")]
    got = degrade.variants_of(spark.createDataFrame(rows, "label_of int, steps string")).collect()
    want = sorted((i, label, name, len(params)) for i, x in enumerate(lists) for label, name, params in degrade.grid(x))
    assert sorted((r.label_of, r.label, r.name, len(r.params)) for r in got) == want and len(want) == 6


def test_crops_and_frames(spark):
    page = np.random.default_rng(1).integers(0, 255, (40, 50, 3)).astype(np.uint8)
    star = [[500.0, 0.0], [1000.0, 1000.0], [0.0, 300.0]]
    rows = [(1, page.tobytes(), 50, [0.0, 0.0, 1000.0, 1000.0], star), (2, page.tobytes(), 50, [100.0, 250.0, 500.0, 750.0], None), (3, None, 50, [0.0] * 4, None), (4, b"abcd", 50, [0.0] * 4, None), (5, page.tobytes(), 50, None, star), (6, page.tobytes(), 50, [1.0, None, 2.0, 3.0], star)]
    table = spark.createDataFrame(rows, "k int, pixels binary, w int, box array<double>, polygon array<array<double>>")
    got = {r.k: r.crop for r in crops.crop_regions(table, "pixels", "w", F.col("box"), F.col("polygon")).collect()}
    assert bytes(got[1].pixels) == raster.cropped(page, (0, 0, 1000, 1000), [tuple(p) for p in star]).tobytes() and (got[1].width, got[1].height) == (50, 40)
    assert bytes(got[2].pixels) == page[10:30, 5:25].tobytes() and [got[k] for k in (3, 4, 5, 6)] == [None] * 4
    boxes = F.when(F.col("k") == 1, F.expr("array(named_struct('x1', 2D, 'y1', 3D, 'x2', 20D, 'y2', 30D), null)"))
    drawn = {r.k: r.pixels for r in crops.draw_boxes(table, "pixels", "w", boxes).collect()}
    assert bytes(drawn[1]) == raster.outlined(page, [(2, 3, 20, 30)], (255, 0, 0), 2).tobytes() and bytes(drawn[2]) == page.tobytes() and drawn[3] is None and bytes(drawn[4]) == b"abcd"


def test_annotations_keep_their_own_sizes_behind_a_shuffle(spark):
    item = F.format_string(
        '{"id":"%s","type":"rectanglelabels","original_width":%s,"original_height":7,"value":{"x":0,"y":0,"width":100,"height":100,"rectanglelabels":["Text"]}}', F.col("id") % 3, F.col("id") + 1,
    )
    words = F.format_string('{"id":"%s","type":"textarea","value":{"text":["t%s"]}}', F.col("id") % 3, "id")
    tasks = spark.range(4000).select("id", F.concat(F.lit('{"annotations":[{"result":['), item, F.lit(","), words, F.lit("]}]}")).alias("json")).repartition(4)
    got = files.annotations(tasks).collect()
    assert len(got) == 4000 and all(r.width == r.id + 1 and r.bbox.x2 == r.id + 1 and r.text == f"t{r.id}" for r in got)


def test_annotations_by_id(spark):
    def box(i, label, x=0):
        return {"id": i, "type": "rectanglelabels", "original_width": 100, "original_height": 50, "value": {"x": x, "y": 0, "width": 1, "height": 1, "rectanglelabels": [label]}}

    def words(i, *t):
        return {"id": i, "type": "textarea", "value": {"text": list(t)}}

    results = [words("b", "B1"), box("b", "One"), box("a", "Two"), words(None, "no id"), words("a", "A1"), box(None, "Three"), words("b", "B2", "B3"), box("b", "Four", 9), words("c", "alone"), {"id": "d", "type": "choices"}, None]
    task = json.dumps({"annotations": [{"result": results}, {"result": [box("z", "Late")]}]})
    got = files.annotations(spark.createDataFrame([(1, task), (1, task)], "k long, json string")).collect()
    one = [("four", "B2\nB3", 0, 9.0), ("two", "A1", 1, 0.0), ("three", "no id", 2, 0.0)]
    assert sorted((r.order, r.category, r.text, r.bbox.x1) for r in got) == sorted((k, c, t, x) for c, t, k, x in one * 2)
    assert {r.width for r in got} == {None}  # the first item has no size


def test_limited_images(spark):
    page = np.random.default_rng(2).integers(0, 256, (10, 40, 3)).astype(np.uint8)
    rows = [(1, page.tobytes(), 40), (2, page.tobytes(), 30), (3, None, 40), (4, b"", 40), (5, b"abc", 1)]
    got = {r.k: r for r in crops.limit_images(spark.createDataFrame(rows, "k int, pixels binary, w int"), "pixels", "w", 20).collect()}
    assert bytes(got[1].pixels) == raster.resampled(page, 20, 5).tobytes() and got[1].w == 20 and bytes(got[2].pixels) == page.tobytes() and got[2].w == 30
    assert got[3].pixels is None and bytes(got[4].pixels) == b"" and bytes(got[5].pixels) == b"abc"


def test_first_close_box_by_all_pairs(spark):
    from folimetry.operators import layout

    rng = np.random.default_rng(3)

    def boxes(n):
        return [(int(rng.integers(3)), i, *(float(v) for v in rng.integers(-6, 7, 4) / 2)) for i in range(n)] + [(0, 900 + n, None, 1.0, 2.0, 3.0)]

    schema = "page long, idx long, x1 double, y1 double, x2 double, y2 double"
    for tolerance in (0.5, 1.0, 3.0):
        a, b = boxes(60), boxes(200)
        got = {(r.page, r.idx): r.match for r in layout.first_close(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), tolerance=tolerance).collect()}
        want = {(x[0], x[1]): min((y[1] for y in b if y[0] == x[0] and None not in x + y and all(abs(p - q) <= tolerance for p, q in zip(x[2:], y[2:]))), default=None) for x in a}
        assert got == want and any(v is not None for v in want.values())


def test_first_close_box_at_borders_of_cells_and_of_repeated_rows(spark):
    from folimetry.operators import layout

    schema = "page long, idx long, x1 double, y1 double, x2 double, y2 double"
    for tolerance in (0.1, 1.0):
        side = layout.CELL * tolerance
        places = [k * side + e * tolerance for k in (-1, 0, 1, 3) for e in (-1, -0.5, 0, 0.5, 1)]
        a = [(0, i, x, y, x, y) for i, (x, y) in enumerate((x, y) for x in places for y in places[:7])]
        b = [(0, i, x + tolerance / 2, y - tolerance / 2, x, y) for i, (_, _, x, y, _, _) in enumerate(reversed(a))]
        got = layout.first_close(spark.createDataFrame(a + a[:3], schema), spark.createDataFrame(b, schema), tolerance=tolerance).collect()
        want = {(x[0], x[1]): min((y[1] for y in b if all(abs(p - q) <= tolerance for p, q in zip(x[2:], y[2:]))), default=None) for x in a}
        assert len(got) == len(a) and {(r.page, r.idx): r.match for r in got} == want
