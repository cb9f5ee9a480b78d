"""Hand-computed values and brute force for the evaluation operators."""

import math
import random
import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from folimetry.functions import formatting, layouts, parse
from folimetry.functions import text as tx
from folimetry.operators import alignment, degrade, layout, metrics, statistics, trees
from folimetry.sources import files, settings


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        after = [i]
        for j, y in enumerate(b, 1):
            after.append(min(row[j] + 1, after[-1] + 1, row[j - 1] + (x != y)))
        row = after
    return row[-1]


def test_edit_counts_are_those_of_a_shortest_alignment():
    rng = random.Random(1)
    for _ in range(2000):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(9))) for _ in range(2))
        hits, subs, dels, ins = alignment.edit_counts(a, b)
        assert subs + dels + ins == _distance(a, b) and hits + subs + dels == len(a) and hits + subs + ins == len(b)


def test_assignment_is_optimal():
    for seed in range(200):
        rng = np.random.default_rng(seed)
        scores = rng.random((rng.integers(1, 5), rng.integers(1, 5)))
        small, large = sorted(scores.shape)
        table = scores if scores.shape[0] == small else scores.T
        best = max(sum(table[i, p[i]] for i in range(small)) for p in permutations(range(large), small))
        assert sum(scores[i, j] for i, j in alignment.assign(scores)) == pytest.approx(best)


def test_tables():
    one = "<table><tr><td>a</td></tr></table>"
    assert trees.table_similarity(one, one) == 1 and trees.table_similarity("", "") == 1 and trees.table_similarity(one, "") == 0
    assert math.isnan(alignment.teds([], [one])) and alignment.teds([one], []) == 0 and alignment.teds([one, one], [one]) == 0.5


def test_char_f1_of_empties():
    assert alignment.char_f1("", "") == (1, 1, 1) and alignment.char_f1("", "a") == (0, 0, 0)


def test_text_metrics(spark):
    rows = [("abc", "abc"), ("abc", "xyz"), ("", "x"), ("x", ""), ("a a a b", "a a b b"), ("a b", "a b c d e f")]
    df = spark.createDataFrame(rows, "r string, h string")
    r, h = F.split("r", " "), F.split("h", " ")
    bag = metrics.bag_of_words(r, h)
    got = df.select(metrics.cer(F.col("r"), F.col("h")).alias("cer"), bag["bow_precision"].alias("p"), metrics.bleu(r, h, 1).alias("bleu"), metrics.wer(r, h).alias("wer")).collect()
    assert got[0].cer == 0 and got[1].cer == 1 and math.isnan(got[2].cer) and got[3].cer == 1
    assert got[4].p == 0.75 and got[5].bleu == pytest.approx(2 / 6) and got[5].wer == 2


def test_normalisation(spark):
    df = spark.createDataFrame([("  Ｈello, World!  @home  ",), ("你好世界",), (None,), ("",)], "t string")
    how = tx.Normalisation(replacements={"@": "at"}, lowercase=True, remove_punctuation=True)
    got = df.select(tx.normalise(F.col("t"), how).alias("n"), tx.words(tx.normalise(F.col("t"))).alias("w"), tx.has_cjk(F.col("t")).alias("c")).collect()
    assert got[0].n == "hello world athome" and got[1].w == list("你好世界") and got[1].c and not got[0].n == got[1].n
    assert got[2].n == "" and got[3].w == []


def test_boxes(spark):
    df = spark.createDataFrame([(0, 0, 100, 100, 25, 25, 75, 75), (0, 0, 10, 10, 10, 0, 20, 10)], "a_x1 long,a_y1 long,a_x2 long,a_y2 long,b_x1 long,b_y1 long,b_x2 long,b_y2 long")
    assert [x.i for x in df.select(layout.iou(layout.box("a_"), layout.box("b_")).alias("i")).collect()] == [0.25, 0]
    boxes = spark.createDataFrame([(1, 1, "A", 0.9, 0, 0, 10, 10), (1, 2, "A", 0.8, 0, 0, 10, 9), (1, 3, "B", 0.7, 50, 50, 60, 60)], "page long,idx long,category string,score double,x1 long,y1 long,x2 long,y2 long")
    assert sorted(x.idx for x in layout.nms_class_aware(boxes).collect()) == [1, 3]
    assert sorted(x.idx for x in layout.nms_greedy(boxes).collect()) == [1, 3]
    assert sorted(x.idx for x in layout.merge_boxes(boxes, "large").select("idx").collect()) == [3]
    assert layout.concordance(np.array([1, 2, 3, 4]), np.array([1, 3, 2, 4])) == pytest.approx(4 / 6)


def test_statistics(spark):
    assert statistics.interval(np.array([])) == (0, 0) and statistics.interval(np.array([3.0])) == (3, 3)
    assert statistics.paired_p(np.ones(3), np.ones(3)) == 1 and statistics.paired_p(np.full(20, 0.1), np.full(20, 0.9)) < 0.05
    with pytest.raises(ValueError):
        statistics.paired_p(np.ones(2), np.ones(3))
    df = spark.createDataFrame([(1, 0.1), (1, float("nan")), (1, 0.3), (2, float("nan"))], "run long, score double")
    got = {r.run: r.mean for r in statistics.run_means(df, ["run"]).collect()}
    assert got[1] == pytest.approx(0.2) and math.isnan(got[2])
    assert df.filter("run = 2").agg(*statistics.summary_columns(F.col("score"))).first().asDict() == {"mean": 0, "std": 0, "median": 0, "min": 0, "max": 0, "n": 0}


def test_parsers(spark):
    unit = "0123456789ab"
    df = spark.createDataFrame([("x" + unit * 12 + "tail", "---\na: 1\n---\nbody"), (unit * 3, "plain")], "t string, f string")
    head, body = parse.front_matter(F.col("f"))
    got = df.select(parse.repeat_guard(F.col("t")).alias("t"), head.alias("h"), body.alias("b")).collect()
    assert got[0].t == "x" + unit and got[1].t == unit * 3 and got[0].h == "\na: 1\n" and got[0].b == "\nbody" and got[1].b == "plain"


def test_repeats_of_any_length(spark):
    rng = random.Random(0)
    unit = "".join(rng.choice("abcdefgh \n") for _ in range(300))
    texts = [("head " + unit * 10 + "tail",), (unit * 9 + "tail",), (None,), ("",)]
    got = [r.t for r in spark.createDataFrame(texts, "t string").select(parse.repeat_guard(F.col("t")).alias("t")).collect()]
    assert got == ["head " + unit, unit * 9 + "tail", None, ""]
    for _ in range(600):
        word = "".join(rng.choice("ab") for _ in range(rng.randint(1, 30)))
        t = "".join(rng.choice("ab") for _ in range(rng.randint(0, 40))) + word * rng.randint(1, 25) + "".join(rng.choice("ab") for _ in range(rng.randint(0, 40)))
        found = re.search(rf"(?s)(.{{10,{max(10, len(t) // 10)}}}?)\1{{9,}}", t)
        assert parse.without_repeats(t) == (t[: found.end(1)] if found else t)


def test_clean_content(spark):
    filler, line = " ".join(map(str, range(800))), "the same line"
    few = "\n".join(["head", *[line] * 200])
    spread = "\n".join(["head", *[f"{line}" if k % 6 else f"other {k}" for k in range(200)]])
    unit = "".join(chr(0x4E00 + k) for k in range(300))
    want = {
        r"\t\t a....b\____c\_\_\_\_\_d ·····\t": r"a...b\___c\_\_\_d ···",
        "x$ a + b $y $$ z $$": "x $a + b$ y $$ z $$",
        filler + unit * 10 + "tail": filler + unit,
        "short " + unit * 5: "short " + unit * 5,
        few: "head\n" + line,
        spread: "head\nother 0\n" + line,
        "\n".join([line] * 50): "\n".join([line] * 50),
        " ": "",
    }
    df = spark.createDataFrame([(k, t) for k, t in enumerate([*want, None])], "k long, t string").orderBy("k")
    got = [r.t for r in df.select(parse.clean_content(F.col("t")).alias("t")).collect()]
    assert got == [*want.values(), ""]


def test_ground_truth(spark):
    df = spark.createDataFrame([(f"Page one\n{files.PAGE_BREAK}\n \n{files.PAGE_BREAK}\nPage two",), ("",), ("Hello",)], "t string")
    assert [r.p for r in df.select(files.text_pages(F.col("t")).alias("p")).collect()] == [["Page one", "Page two"], [""], ["Hello"]]
    docs = spark.createDataFrame([(1, '{"pages":[{"page":3,"regions":[{"text":"x","bbox":[1,2,3,4],"children":[{"text":"y"}]}]}]}'), (2, "{broken")], "id long, json string")
    got = files.json_pages(docs).collect()
    assert len(got) == 1 and got[0].page == 3 and got[0].regions[0].bbox.y2 == 4 and got[0].regions[0].order == -1


def test_degradations(spark):
    pixels = np.full((20, 50, 3), 128, np.uint8)
    assert (degrade.gaussian(pixels, 25) == degrade.gaussian(pixels, 25)).all()
    salted = degrade.salt_pepper(pixels, 0.5)
    assert set(salted.ravel()) == {0, 128, 255} and (salted == salted[:, :, :1]).all()
    labels = [x[0] for x in degrade.grid([{"name": "noise", "params": {"sigma": [1, 2], "seed": [3, 4]}}, {"name": "nothing"}, {}, {"name": "blur"}, {"name": "jpeg", "params": {"quality": 10}}])]
    assert labels == ["noise_sigma=1_seed=3", "noise_sigma=1_seed=4", "noise_sigma=2_seed=3", "noise_sigma=2_seed=4", "blur()", "jpeg(quality=10)"]
    rows = [(pixels.tobytes(), "salt_and_pepper", 0.5, 50), (pixels.tobytes(), "other", 0.5, 50), (b"abc", "noise", 25.0, None), (None, "noise", 1.0, 1)]
    got = [r.p for r in spark.createDataFrame(rows, "p binary, n string, a double, w int").select(degrade.degraded(F.col("p"), F.col("n"), F.col("a"), F.col("w")).alias("p")).collect()]
    assert bytes(got[0]) == salted.tobytes() and bytes(got[1]) == pixels.tobytes() and len(got[2]) == 3 and got[3] is None


def test_edit_distance_of_long_and_varied_sequences(spark):
    rng = random.Random(3)
    for _ in range(1500):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(12))) for _ in range(2))
        assert alignment.edit_distance(a, b) == alignment.edit_distance(list(a), list(b)) == _distance(a, b)
    words = [f"w{i}" for i in range(60_000)]
    changed = [w if i % 100 else "other" for i, w in enumerate(words)]
    text = "".join(rng.choice("漢字仮名abc ") for _ in range(3000))
    rows = [(words, changed, text, text.replace("漢", "x")), ([], [], "", ""), (["a"], [], "ab", "")]
    got = spark.createDataFrame(rows, "r array<string>, h array<string>, s string, t string").select(metrics.wer(F.col("r"), F.col("h")).alias("w"), metrics.cer(F.col("s"), F.col("t")).alias("c")).collect()
    assert got[0].w == pytest.approx(0.01) and got[0].c == pytest.approx(text.count("漢") / 3000) and len(text) ** 2 > metrics.LONG_PAIR
    assert math.isnan(got[1].w) and math.isnan(got[1].c) and got[2].w == got[2].c == 1


def _tree_distance(a, b, x=0, y=0):
    def size(t, k):
        return 1 + sum(size(t, c) for c in range(t.first[k], t.first[k + 1]))

    mine, other = range(a.first[x], a.first[x + 1]), range(b.first[y], b.first[y + 1])
    row = [0]
    for d in other:
        row.append(row[-1] + size(b, d))
    for c in mine:
        after = [row[0] + size(a, c)]
        for j, d in enumerate(other):
            after.append(min(row[j + 1] + size(a, c), after[-1] + size(b, d), row[j] + _tree_distance(a, b, c, d)))
        row = after
    return (a.tags[x] != b.tags[y]) + (a.texts[x] != b.texts[y]) + row[-1]


@pytest.mark.parametrize("few", [trees.FEW, 0])
def test_tree_distance_by_recursion(monkeypatch, few):
    monkeypatch.setattr(trees, "FEW", few)  # pair by pair, and in arrays
    rng, met = random.Random(0), 0
    for _ in range(600):
        x, y = (trees.parse_tree("".join(rng.choice(["<a>", "<b>", "</a>", "</b>", "<a/>", "x", "y ", "<br>"]) for _ in range(rng.randrange(1, 16)))) for _ in range(2))
        if x and y:
            met += 1
            assert trees.tree_distance(x, y) == _tree_distance(x, y)
    assert met > 300


def test_trees_of_any_depth():
    deep = trees.parse_tree("<p>" + "<br>x" * 100_000)
    assert len(deep) == 100_001 and trees.tree_distance(deep, deep) == 0
    both = trees.parse_tree("<a/><b/>")
    assert both.tags == ["a", "b"] and trees.parse_tree("<a></a><b/>").tags == ["root", "a", "b"] and trees.parse_tree("<a></a><b></b>").tags == ["b"]
    assert trees.parse_tree("plain") is None and trees.parse_tree(None) is None and trees.parse_tree("<a>x<c> y </c></a>z").texts == ["x", "y"]


def test_long_tables_are_compared_in_arrays(monkeypatch):
    rng = random.Random(5)

    def table(rows):
        return "<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + "</table>"

    for size in (3, 9):
        rows = [[rng.randrange(6) for _ in range(rng.randrange(1, 5))] for _ in range(size)]
        other = [list(r) for r in rows if rng.random() < 0.8] + [[1, 2]]
        other[0][0] = 99
        monkeypatch.setattr(trees, "CELLS", 16)  # several slices a level
        monkeypatch.setattr(trees, "FEW", 0)
        x, y = trees.parse_tree(table(rows)), trees.parse_tree(table(other))
        assert trees.tree_distance(x, y) == _tree_distance(x, y)
    long = [[rng.randrange(1000) for _ in range(20)] for _ in range(300)]
    changed = [r if k % 50 else [0] * 20 for k, r in enumerate(long)]
    assert trees.table_similarity(table(long), table(changed)) == 1 - 6 * 20 / (1 + 300 * 21)


def test_diff_by_longest_blocks():
    from difflib import SequenceMatcher

    rng = random.Random(7)
    for _ in range(400):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(25))) for _ in range(2))
        assert alignment.diff_ops(a, b) == [(k, a[p:q], b[r:s]) for k, p, q, r, s in SequenceMatcher(None, a, b, autojunk=False).get_opcodes()]
    long = "".join(rng.choice("abcdefgh ") for _ in range(40_000))
    other = "".join(rng.choice("abcdefgh ") for _ in range(40_000))
    ops = alignment.diff_ops(long, other)
    assert "".join(x for _, x, _ in ops) == long and "".join(y for _, _, y in ops) == other


def test_alignment_of_long_texts_in_little_memory():
    import tracemalloc

    rng = random.Random(6)
    a = "".join(rng.choice("abcdefgh ") for _ in range(30_000))
    b = "".join(c if rng.random() > 0.1 else "z" for c in a)[:-50]
    tracemalloc.start()
    hits, subs, dels, ins = alignment.edit_counts(a, b)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 20e6 and hits + subs + dels == len(a) and hits + subs + ins == len(b) and subs + dels + ins == alignment.edit_distance(a, b)


def test_concordance_by_pairs():
    for seed in range(40):
        rng = np.random.default_rng(seed)
        n = int(rng.integers(0, 160))
        x, y = rng.integers(0, 30, n).astype(float), rng.integers(0, 30, n).astype(float)
        signs = [np.sign((x[i] - x[j]) * (y[i] - y[j])) for i in range(n) for j in range(i)]
        untied = sum(map(abs, signs))
        assert layout.concordance(x, y) == pytest.approx(sum(signs) / untied if untied else 1)


def _boxes(spark, rng, pages, n):
    rows = [(p, i, rng.choice("AN"), round(rng.random(), 2), *(x := rng.randrange(60), y := rng.randrange(60)), x + rng.randrange(1, 40), y + rng.randrange(1, 40)) for p in range(pages) for i in range(n)]
    return rows, spark.createDataFrame(rows, "page long,idx long,category string,score double,x1 long,y1 long,x2 long,y2 long")


def _iou(a, b, pixel=0):
    both = max(0, min(a[6], b[6]) - max(a[4], b[4]) + pixel) * max(0, min(a[7], b[7]) - max(a[5], b[5]) + pixel)
    sizes = [(r[6] - r[4] + pixel) * (r[7] - r[5] + pixel) for r in (a, b)]
    return both / (sum(sizes) - both)


@pytest.mark.parametrize(("pages", "n"), [(6, 12), (2, 150)])
def test_suppression_one_by_one(spark, pages, n):
    rows, df = _boxes(spark, random.Random(n), pages, n)
    for found, keeps in ((layout.nms_class_aware(df), lambda y, x: _iou(y, x, 1) < (0.6 if y[2] == x[2] else 0.98)), (layout.nms_greedy(df), lambda y, x: _iou(y, x) <= 0.5)):
        want = []
        for p in range(pages):
            kept = []
            for r in sorted((r for r in rows if r[0] == p), key=lambda r: (-r[3], r[1])):
                if all(keeps(y, r) for y in kept):
                    kept.append(r)
            want += [(r[0], r[1]) for r in kept]
        assert sorted((r.page, r.idx) for r in found.collect()) == sorted(want)


def test_matching_layout_and_order(spark):
    rng = random.Random(5)
    gt, g = _boxes(spark, rng, 8, 4)
    pr, p = _boxes(spark, rng, 8, 4)
    greedy = {}
    for r in layout.greedy_pairs(layout.iou_matrix(g, p)).collect():
        greedy.setdefault(r.page, []).append((r.i, r.j))
    scores = {r.page: r for r in layout.layout_scores(g, p).collect()}
    taus = {r.page: r.tau for r in layout.reading_order(g, p).collect()}
    for page in range(8):
        a, b = ([r for r in rows if r[0] == page] for rows in (gt, pr))
        pairs, taken = sorted(((_iou(x, y), x[1], y[1]) for x in a for y in b), reverse=True), []
        for _, i, j in pairs:
            if all(i != u and j != v for u, v in taken):
                taken.append((i, j))
        assert sorted(greedy[page]) == sorted(taken)
        best = max(permutations(range(4)), key=lambda o: sum(_iou(a[i], b[o[i]]) for i in range(4)))
        assert scores[page].mean_iou == pytest.approx(sum(_iou(a[i], b[best[i]]) for i in range(4)) / 4)
        hits = sum(_iou(a[i], b[best[i]]) >= 0.5 and a[i][2] == b[best[i]][2] for i in range(4))
        assert scores[page].precision == hits / 4 == scores[page].recall
        met = [(i, best[i]) for i in range(4) if _iou(a[i], b[best[i]]) > 0]
        signs = [1 if (x[0] - y[0]) * (x[1] - y[1]) > 0 else -1 for k, x in enumerate(met) for y in met[:k]]
        assert math.isnan(taus[page]) if len(met) < 2 else taus[page] == pytest.approx(sum(signs) / len(signs))
    lone = g.filter("page = 0 and idx = 0")
    assert layout.layout_scores(lone, p.filter("page = 9")).first().mean_iou == 0 and math.isnan(layout.reading_order(lone, p).first().tau)


def test_resampling_of_groups(spark):
    values = [0.1, 0.4, 0.35, 0.8, 0.55]
    df = spark.createDataFrame([("m", i, v) for i, v in enumerate(values)] + [("one", 0, 0.5)], "model string, i long, score double")
    got = {r.model: r for r in statistics.bootstrap(df, ["model"], "score", ["i"]).collect()}
    drawn = np.array(values)[np.random.default_rng(42).integers(0, 5, size=(10_000, 5))].mean(axis=1)
    assert (got["m"].ci_lower, got["m"].ci_upper) == pytest.approx(tuple(np.percentile(drawn, [2.5, 97.5]))) and got["one"].ci_lower == 0.5 == got["one"].ci_upper
    pairs = spark.createDataFrame([("x", i, v, v + 0.3) for i, v in enumerate(values)] + [("y", 0, 0.1, 0.2)], "g string, i long, a double, b double")
    test = {r.g: r for r in statistics.paired_test(pairs, ["g"], ["i"]).collect()}
    assert test["x"].significant and test["x"].n == 5 and test["y"].p_value is None


def test_merged_resampling_agrees(spark):
    rng = np.random.default_rng(7)
    rows = [(g, i, float(v)) for g, n in (("a", 2000), ("b", 500)) for i, v in enumerate(rng.normal(5, 2, n))] + [("a", 9000, None), ("c", 1, 0.5)]
    df = spark.createDataFrame(rows, "g string, i long, x double").repartition(3)
    got = {r.g: r for r in statistics.bootstrap_merged(df, ["g"], "x", "i").collect()}
    again = {r.g: r for r in statistics.bootstrap_merged(df.repartition(5), ["g"], "x", "i").collect()}
    for g in "ab":
        low, high = statistics.interval(np.array([x for k, _, x in rows if k == g and x is not None]))
        assert abs(got[g].ci_lower - low) < 0.15 * (high - low) and abs(got[g].ci_upper - high) < 0.15 * (high - low) and got[g].ci_lower == pytest.approx(again[g].ci_lower)
    assert got["c"].ci_lower == got["c"].ci_upper == 0.5


def test_diff_and_inline_formulas(spark):
    for old, new in (("kitten", "sitting"), ("", "a"), ("same", "same")):
        ops = alignment.diff_ops(old, new)
        assert "".join(o for _, o, _ in ops) == old and "".join(n for _, _, n in ops) == new and all((k == "equal") == (o == n) for k, o, n in ops)
    got = spark.createDataFrame([("see $ x + y $here, a$b$c",)], "t string").select(parse.inline_formulas(F.col("t")).alias("t")).first().t
    assert got == "see $x + y$ here, a $b$ c"


# --- layouts and the formatter


def test_layout_dialects(spark):
    items = '[{"bbox":[0.1,0.2,0.5,0.4],"type":"Title","text":"T","score":0.5},7,{"bbox":[9,8,1,2],"category":"Weird","text":5},{"category":"Picture","text":"p"},{"category":3}]'
    df = spark.createDataFrame([(items,), ("{broken",), ('{"category":"Text","text":"x"}',), ('{"layout":[]}',), ("3",)], "j string")
    got = [r.p for r in df.select(layouts.layout_page(F.col("j"), F.lit(100), F.lit(200)).alias("p")).collect()]
    r = got[0].regions
    assert [x.order for x in r] == [0, 2, 3, 4] and [x.category for x in r] == ["title", "weird", "picture", "text"] and got[0].full_text == "T\n\n5"
    assert tuple(r[0].bbox) == (10, 40, 50, 80) and tuple(r[1].bbox) == (1, 2, 9, 8) and r[2].bbox is None and r[0].confidence == 0.5
    assert (got[1].full_text, got[1].regions) == ("{broken", []) and got[2].regions[0].text == "x" and got[3].regions == [] and got[4].regions == []
    snake = spark.createDataFrame([('{"data":[{"bbox":[-5,10,500,20],"category":" Figure_Caption ","text":"c"},{"bbox":[3,3,3,9],"category":"footer","text":"f"}]}',), ('{"x":1}',)], "j string")
    got = [r.p for r in snake.select(layouts.layout_page(F.col("j"), F.lit(100), F.lit(200), "snake").alias("p")).collect()]
    assert tuple(got[0].regions[0].bbox) == (0, 10, 100, 20) and got[0].regions[1].bbox is None and got[0].full_text == "c" and got[0].regions[0].text_format == "markdown" and got[1].regions == []


def test_first_json():
    cases = {"```json\n[1, [2]] x\n```": "[1, [2]]", 'a {"k": "["} b': '{"k": "["}', "none": "none", "[1, 2": "[1, 2", None: "", "{]}": "{]}"}
    assert {k: layouts.first_json(k) for k in cases} == cases


def test_html_blocks():
    html = '<p>no</p><div data-bbox="100 200 900 1500" data-label="Text"><b data-bbox=\'1\'>x &amp; y</b><br><div>in</div></div><div>z</div><div data-label="Blank-Page">b</div><div data-bbox="1 2 3">q'
    got = layouts.blocks_of(html, 1000, 500)
    assert got[0] == {"bbox": [100, 100, 900, 500], "label": "Text", "content": "<b>x &amp; y</b><br><div>in</div>"}
    assert [(b["bbox"], b["label"], b["content"]) for b in got[1:]] == [([0, 0, 1000, 500], "block", "z"), ([0, 0, 1000, 500], "block", "q")] and layouts.blocks_of(None, 1, 1) == []


def _block(label, content, left=0.0):
    return {"index": 0, "label": label, "content": content, "left": left}


def test_formatting():
    cases = {
        ("## - x", "doc_title"): "# - x", ("- ## x", "paragraph_title"): "## x", ("·item", "text"): "- item", ("（a）b", "text"): "(a) b", ("12.x", "text"): "12. x", ("a\nb\n\nc", "text"): "a\n\nb\n\nc",
        ("\\(x\\)", "inline_formula"): "$$\nx\n$$", ("$$ x $$", "display_formula"): "$$\nx\n$$", ("<table> </table>", "table"): "<table> </table>", ("```\nx", "text"): "```\n\nx\n\n```", (None, "text"): None,
    }
    assert {k: formatting.formatted(*k) for k in cases} == cases
    f, n = _block("display_formula", "$$\nx\n$$"), _block("formula_number", "(1)")
    assert [b["content"] for b in formatting.with_numbers([n, f, n, f, n, n])] == ["$$\nx \\tag{1}\n$$"] * 2
    assert [b["content"] for b in formatting.with_numbers([n, _block("text", "t"), f, n])] == ["t", "$$\nx \\tag{1}\n$$"]
    texts = [_block("text", t) for t in ("a in-", "ter b-", "next", "X-", "Y")]
    assert [b["content"] for b in formatting.with_whole_words(texts)] == ["a inter b-", "next", "X-", "Y"]
    bullets = [_block("text", t, x) for t, x in (("- a", 0), ("b", 9), ("- c", 1), ("d", 2), ("- e", 30))]
    assert [b["content"] for b in formatting.with_bullets(bullets)] == ["- a", "- b", "- c", "d", "- e"]
    assert formatting.with_bullets([]) == [] and formatting.assembled([_block("text", " "), _block("image", None)])[0]["index"] == 0


def test_resizing_keeps_its_bounds():
    rng = random.Random(1)
    for _ in range(300):
        w, h = rng.randrange(1, 9000), rng.randrange(1, 9000)
        a, b = layout.sides_by_steps(w, h, 28, 3136, 11_289_600)
        assert a % 28 == b % 28 == 0 and 3136 <= a * b <= 11_289_600
        a, b = layout.sides_by_blocks(w, h, 28, 50_176, 6_291_456)
        assert a % 28 == b % 28 == 0 and a * b <= 6_291_456
    assert layout.sides_by_steps(56, 56, 28, 3136, 10**7) == (56, 56) and layout.sides_by_steps(100, 50, 28, 3136, 10**7) == (112, 56) and layout.sides_by_blocks(0, 5, 28, 1, 9) == (0, 5)


# --- sources and sinks


def test_annotations_of_odd_tasks(spark):
    box = '{"id":"a","type":"rectanglelabels","original_width":200,"original_height":100,"value":{"x":10,"y":10,"width":20,"height":10,"rotation":90,"rectanglelabels":["Picture"]}}'
    last = box.replace("Picture", "Table").replace('"rotation":90,', "")
    words = '{"id":"a","type":"textarea","original_width":200,"original_height":100,"value":{"text":["x","y"]}}'
    tasks = [(1, f'{{"file_upload":"0a1b2c3d-p.png","annotations":[{{"result":[{box},{words},{last}]}}]}}'), (2, '{"annotations":[]}'), (3, "{"), (4, f'{{"annotations":[{{"result":[{box}]}}]}}'), (5, None)]
    found = files.annotations(spark.createDataFrame(tasks, "id long, json string"))
    got = {r.id: r for r in found.collect()}
    assert set(got) == {1, 4} and (got[1].file, got[1].category, got[1].text, got[1].text_format) == ("p.png", "table", "x\ny", "html") and tuple(got[1].bbox) == (20, 10, 60, 20)
    assert tuple(got[4].bbox) == (35, -5, 45, 35) and got[4].text == ""
    pages = {r.id: r for r in files.annotated_pages(found, ["id"]).collect()}
    assert pages[1].full_text == "x\ny" and pages[4].full_text == "" and pages[4].width == 200


def test_summary_upsert_on_disk(spark, tmp_path):
    path = f"{tmp_path}/summary"
    row = "`Model` string, `Test Set` string, `Device` string, `CER` double"
    files.upsert_summary(spark.createDataFrame([("a", "t, \"x\"", "cpu", 0.25), ("b", "N/A", "cpu", None)], row), path)
    files.upsert_summary(spark.createDataFrame([("a", "t, \"x\"", "cpu", 0.5)], row).withColumn("Pages", F.lit(3)), path)
    got = {r.Model: r for r in files.read_summary(spark, path).collect()}
    assert got["a"]["Test Set"] == 't, "x"' and got["a"].CER == "0.5" and got["a"].Pages == "3" and got["b"]["Test Set"] == "N/A" and not got["b"].Pages and len(got) == 2
    assert files.metric_columns(spark.createDataFrame([(1.0, 2, 3.0, "x")], "CER double, Runs int, `CER CI low` double, s string")) == ["CER"]
    files.write_results(spark.createDataFrame([('{"é":1}',)], "document string"), f"{tmp_path}/results")
    assert spark.read.text(f"{tmp_path}/results").first().value == '{"é":1}'


def test_worker_files(spark, tmp_path):
    images = spark.createDataFrame([("m", 1, "b.png"), ("m", 0, "a.png")], "model string, position long, path string")
    task = files.task_documents(images, ["model"], "cuda", '{"dpi":200}')
    files.write_results(task, f"{tmp_path}/tasks")
    assert spark.read.text(f"{tmp_path}/tasks").first().value == '{"image_paths":["a.png","b.png"],"device":"cuda","params":{"dpi":200}}'
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.json").write_text('{"model_load_time_seconds": 2,\n "pages": [{"image_path": "a.png", "result": {"page_number": 1}}, {"error": "x"}], "odd": 1}')
    (tmp_path / "r" / "b.json").write_text("{broken")
    got = {r.file: r for r in files.read_responses(spark, f"{tmp_path}/r").collect()}
    assert got["a.json"].model_load_time_seconds == 2 and got["a.json"].peak_ram_mb == 0 and got["a.json"].pages[0].result == '{"page_number":1}' and got["a.json"].pages[1].error == "x" and got["b.json"].pages is None
    (tmp_path / "i").mkdir()
    (tmp_path / "i" / "p.PNG").write_bytes(b"abc")
    (tmp_path / "i" / "t.txt").write_bytes(b"no")
    assert [bytes(r.content) for r in files.load_images(spark, f"{tmp_path}/i").collect()] == [b"abc"]
    assert [r.test_set for r in files.list_test_sets(spark, f"{tmp_path}").collect()] == ["i", "r", "tasks"] and files.list_test_sets(spark, f"{tmp_path}/none").count() == 0
    assert [r.file for r in files.list_files(spark, f"{tmp_path}").collect()] == ["p.PNG"]


def test_replaced_table_survives_a_crash(spark, tmp_path):
    path = f"{tmp_path}/t"
    files.replace_table(spark.range(3), path)
    files.replace_table(spark.read.parquet(path).filter("id > 0"), path)
    assert spark.read.parquet(path).count() == 2
    (tmp_path / "t").rename(tmp_path / "t-old")  # as if it stopped between the two renames
    files.restore_table(spark, path)
    assert spark.read.parquet(path).count() == 2 and not (tmp_path / "t-old").exists()


def test_settings(tmp_path):
    (tmp_path / "c.json").write_text('{"benchmark": {"runs": 2, "odd": 1}, "metrics": ["cer", {"name": "bleu", "params": {"max_n": 2}}], "data": {"pdf_dpi": 300}}')
    got = settings.load(f"{tmp_path}/c.json", {"data": {"input_dir": "x"}})
    assert got["benchmark"] == {"runs": 2, "warmup_runs": 0, "timeout_seconds": 3600} and got["data"]["pdf_dpi"] == 300 and got["data"]["input_dir"] == "x" and got["metrics"][1]["params"] == {"max_n": 2}
    with pytest.raises(settings.SettingsError) as bad:
        settings.load(None, {"benchmark": {"runs": 0}, "metrics": [{}], "models": {"m": {}}, "normalisation": {"unicode_form": "X"}})
    assert len(str(bad.value).splitlines()) == 5
    (tmp_path / ".env").write_text("# c\nexport A='1 2'\nB=5 # five\n")
    assert settings.overlay({"B": "7"}, {"A": "a.b", "B": "a.c", "C": "d"}, f"{tmp_path}/.env", {"a.c": int}) == {"a": {"b": "1 2", "c": 7}}
    with pytest.raises(FileNotFoundError):
        settings.overlay({}, {}, f"{tmp_path}/none")
    pytest.importorskip("yaml")
    (tmp_path / "c.yaml").write_text("benchmark:\n  runs: 4\n")
    assert settings.load(f"{tmp_path}/c.yaml")["benchmark"]["runs"] == 4


def test_small_trees_are_built_without_an_array_a_node(monkeypatch):
    from folimetry.operators import trees

    made, array = [], trees.np.array
    monkeypatch.setattr(trees.np, "ones", lambda *a, **k: made.append(a) or array([1] * a[0]))
    monkeypatch.setattr(trees, "parse_tree", lambda html, parse=trees.parse_tree: made.append(html) or parse(html))
    table = "<table><tr><td>1</td><td>2</td></tr><tr><td>3</td></tr></table>"
    assert trees.table_similarity(table, table) == 1.0 and made == [table]
    tree = trees.parse_tree(table)
    assert tree.size.tolist() == [6, 3, 2, 1, 1, 1] and tree.depth.tolist() == [0, 1, 1, 2, 2, 2] and tree.levels.tolist() == [0, 1, 3, 6]


def test_small_assignments_in_lists_are_those_in_arrays(monkeypatch):
    rng = np.random.default_rng(5)
    cases = [rng.random((n, m)) for n in range(1, 9) for m in range(1, 9)] + [rng.integers(0, 3, (n, m)) / 2 for n in range(1, 9) for m in range(1, 9)] + [np.zeros((3, 4)), np.eye(5)]
    few = [alignment.assign(x) for x in cases]
    monkeypatch.setattr(alignment, "_assign_few", None)
    monkeypatch.setattr(alignment, "FEW", 0)
    assert few == [alignment.assign(x) for x in cases]


def _order_tables(lines, page, line_order=sorted):
    """The reference and the predicted table of lines: line number, part, supplier, quantity."""

    def html(rows):
        return "<table>" + "".join(f"<tr><td>{r[0]}</td><td>{r[3]}</td></tr>" for r in rows) + "</table>"

    lines = line_order(lines)
    gt = html(lines)
    return gt, [gt.replace("<td>1", "<td>7"), html(lines[1:]), html(sorted(lines, key=lambda r: r[1])), gt][page % 4]


def _recursive_similarity(a, b):
    x, y = trees.parse_tree(a), trees.parse_tree(b)
    return max(0.0, 1 - _tree_distance(x, y) / max(len(x), len(y)))


def _order_lines(spark, tmp_path):
    """Lines of 60 orders as page, return flag and (line number, part, supplier, quantity), and their folder."""
    rng = random.Random(4)
    rows = [(page, rng.choice("ANR"), (rng.randrange(1, 8), part, rng.randrange(9), float(rng.randrange(1, 51)))) for page in range(60) for part in rng.sample(range(99), rng.randrange(1, 9))]
    flat = [(page, *line, flag) for page, flag, line in rows]
    spark.createDataFrame(flat, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    return rows


def test_page_tables_are_matched(spark, tmp_path):
    import __spark_entry__

    rows = _order_lines(spark, tmp_path)
    got = {r.page: r.teds for r in __spark_entry__.queries()["metric_teds"](spark, str(tmp_path)).collect()}

    def scores(page, spurious=True, line_order=sorted):
        """Of the best matching, and of tables as they come."""
        flags = sorted({f for p, f, _ in rows if p == page})
        gt, pred = zip(*[_order_tables([x for p, f, x in rows if (p, f) == (page, flag)], page, line_order) for flag in flags], strict=True)
        pred = list(pred)[::-1][page % 5 == 0 :] + ["<table><tr><td>1</td></tr></table>"] * (spurious and page % 5 == 1)
        each = [[_recursive_similarity(a, b) for b in pred] + [0.0] * len(gt) for a in gt]
        ways = [sum(e[j] for e, j in zip(each, p, strict=True)) / len(gt) for p in permutations(range(len(each[0])), len(gt))]
        return max(ways), ways[0]

    expected = {page: scores(page) for page in range(60)}
    assert got == pytest.approx({page: best for page, (best, _) in expected.items()})
    # every stage tells: the matching, references without a partner, predictions too many, the order of lines
    assert any(best > first + 1e-9 for best, first in expected.values())
    assert got[0] < 1 and any(got[page] == 0 for page in range(0, 60, 5))
    assert any(scores(page, spurious=False) != expected[page] for page in range(1, 60, 5))
    assert any(scores(page, line_order=lambda x: sorted(x)[::-1]) != expected[page] for page in range(2, 60, 4))


def test_a_pair_is_a_table_and_its_prediction(spark, tmp_path):
    import __spark_entry__

    rows = _order_lines(spark, tmp_path)
    got = {r.page: r.similarity for r in __spark_entry__.queries()["teds_pair"](spark, str(tmp_path)).collect()}

    def score(page, line_order=sorted):
        return _recursive_similarity(*_order_tables([x for p, _, x in rows if p == page], page, line_order))

    assert got == pytest.approx({page: score(page) for page in range(60)})
    assert all(got[page] == 1 for page in range(3, 60, 4)) and all(any(got[page] < 1 for page in range(kind, 60, 4)) for kind in range(3))
    assert any(score(page, lambda x: sorted(x)[::-1]) != score(page) for page in range(2, 60, 4))
