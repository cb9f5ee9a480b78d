"""Fill-in-middle against a plain rewriting of its rule, whitening against numpy's eigenvectors and exact integers."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("folimetry.llm.registry")
from folimetry.llm import fill_middle, whitening
from folimetry.llm.scratch import written

ODD = [None, "", "  \n", "a", "x<P>y", "<S", "P>", "é漢 😀\t\x00 ﬁ ▁▁", "ab12" * 9, "ab12" * 9, "a" * 5000, "1 " * 200_000]


def brute(doc_id, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(units)
    a, z = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    pre, mid, suf = ("".join(x) for x in (units[:a], units[a:z], units[z:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_fill_middle_is_its_rule_and_can_be_undone(spark):
    rng = random.Random(11)
    texts = ODD + ["".join(rng.choice(["ab", "C", " ", "<", "P>", "M", ">", "é", "\n", "7"]) for _ in range(rng.randrange(40))) for _ in range(600)]
    rows = [(None if i == 2 else i, t, "own", i) for i, t in enumerate(texts)]
    docs = written(spark.createDataFrame(rows, "doc_id long, text string, form string, Output long"))
    got = fill_middle.fill_in_middle(docs).withColumn("again", fill_middle.rebuilt(F.col("output"), F.col("form"))).collect()
    assert sorted(r.c3 for r in got) == list(range(len(texts)))
    forms = set()
    for r in got:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute(r.c0, r.c1) and r.again == (r.c1 or "")
        forms.add(r.form)
    assert forms == {"plain", "psm", "spm"}
    assert fill_middle.filled_texts(docs).columns == ["doc_id", "text", "form", "Output", "n", "_form", "prefix_chars", "middle_chars", "_output"]
    assert fill_middle.fill_in_middle(docs.limit(0)).count() == 0


def test_fill_middle_of_a_very_long_text(spark):
    text = "word 12, " * 2_400_000  # 21 MB
    got = fill_middle.fill_in_middle(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (got.n, got.form, got.prefix_chars, got.middle_chars, got.output) == brute(1, text)


@pytest.mark.parametrize("marks", [("a", "a", "b"), ("", "b", "c"), ("aba", "c", "d"), ("<x", "x>", "y"), ("a<P>b", "<P>", "c")])
def test_marks_that_cannot_be_told_apart(spark, marks):
    with pytest.raises(ValueError):
        fill_middle.checked(marks)


def test_jacobi_finds_small_eigenvalues():
    rng = np.random.default_rng(5)
    for d in (0, 1, 2, 3, 8, 33, 64):
        a = rng.normal(size=(d, d)) * np.exp(rng.normal(size=d))
        values, axes = whitening.jacobi(a.T @ a)
        assert np.allclose(values, np.linalg.eigvalsh(a.T @ a)[::-1], rtol=1e-9, atol=1e-12 * (values[0] if d else 1))
        assert np.allclose(axes.T @ axes, np.eye(d), atol=1e-13) and np.allclose(axes * values @ axes.T, a.T @ a, atol=1e-12 * (values[0] if d else 1))
    scale = np.diag([1e8, 1.0, 1e-8])
    graded = scale @ np.array([[1, 0.5, 0.2], [0.5, 1, 0.3], [0.2, 0.3, 1]]) @ scale
    exact = np.linalg.det(graded / 1)  # of the three, about 1e16, 1 and 1e-16
    values, _ = whitening.jacobi(graded)
    assert math.isclose(values[0] * values[1] * values[2], exact, rel_tol=1e-9) and values[2] > 0
    assert whitening.jacobi(np.zeros((3, 3)))[0].tolist() == [0, 0, 0]
    assert whitening.jacobi(np.ones((4, 4)))[0] == pytest.approx([4, 0, 0, 0], abs=1e-14)


def brute_whitening(vectors):
    x = np.floor(np.array(vectors, np.float64) * 1024).astype(np.int64) + 100_000
    n, sums = len(x), [sum(c) for c in x.T.tolist()]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(row, sums)) for row in x.tolist()]
    centred = x - np.array(sums) / n
    v = centred.T @ centred / n
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    return deviation, centred @ axes[:, :8] / np.sqrt(values[:8]), values[:8] / np.trace(v)


def test_whitening_by_brute_force(spark):
    rng = np.random.default_rng(1)
    vectors = (rng.normal(size=(700, 12)) * np.linspace(3, 0.05, 12) @ np.linalg.qr(rng.normal(size=(12, 12)))[0]).tolist()
    vectors[5] = vectors[6]
    bad = [None, [None] + [1.0] * 11, [math.nan] * 12, [math.inf] + [0.0] * 11]
    narrow = [[float(i), 2.0 * i] for i in range(10)]  # one of two components has no variance
    rows = [(i, v, "x") for i, v in enumerate(vectors + bad + narrow + [[]] + [[7.0, 7.0, 7.0]])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, n string").repartition(7)
    got = {r.c0: r for r in whitening.whiten(table).collect()}
    assert set(got) == set(range(700)) | set(range(704, 716)) and got[3].c2 == "x"
    deviation, whitened, explained = brute_whitening(vectors)
    found = np.array([got[i].whitened for i in range(700)])
    signs = np.sign((found * whitened).sum(axis=0))
    assert np.allclose(found, whitened * signs, atol=1e-8) and found[5].tolist() == found[6].tolist()
    assert [int(got[i].deviation) for i in range(700)] == deviation
    assert np.allclose(got[0].explained, explained, rtol=1e-9) and 0 <= got[0].identity_error < 1e-9 and got[0].n == 700
    assert got[704].n == 10 and got[704].whitened[1] is None and got[704].explained[1] == 0 and got[704].identity_error < 1e-9
    assert (got[714].n, got[714].whitened, got[714].identity_error) == (None, [], None)
    assert (got[715].n, got[715].whitened, got[715].identity_error, got[715].deviation) == (1, [None] * 3, None, 0)
    assert whitening.whiten(table.limit(0)).count() == 0


def test_whitening_of_large_and_far_entries(spark):
    """Exact sums beyond 64 bits, a mean far from zero, and an entry that has no exact whole number."""
    rng = np.random.default_rng(2)
    far = (1e9 + rng.normal(size=(400, 3))).tolist()
    got = {r.c0: r for r in whitening.whiten(spark.createDataFrame(list(enumerate(far)), "vec_id long, embedding array<double>").repartition(5)).collect()}
    deviation, whitened, _ = brute_whitening(far)
    found = np.array([got[i].whitened for i in range(400)])
    assert np.allclose(np.abs(found), np.abs(whitened), atol=1e-5) and got[0].identity_error < 1e-7 and [int(got[i].deviation) for i in range(400)] == deviation
    with pytest.raises(Exception, match="beyond"):
        whitening.whiten(spark.createDataFrame([(1, [1e30])], "vec_id long, embedding array<double>")).collect()


def test_deviations_beyond_long():
    x = np.array([[0, 5], [2**52, -3], [10**6, 10**6]], np.int64)
    for n, sums in ((3, [2**52 + 10**6, 10**6 + 2]), (10**9, [7 * 10**14 + 1, -5]), (10**13, [10**19 + 3, 1])):
        m = whitening.Whitening(n, np.array(sums, object), np.zeros(0), np.zeros((2, 0)), np.zeros(0))
        assert m.deviations(x).tolist() == [sum((n * c - s) ** 2 for c, s in zip(r, sums)) for r in x.tolist()]
