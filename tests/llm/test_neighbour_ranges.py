"""Nearest neighbours of vectors of any finite size: as many as are due, and the right ones."""

import numpy as np
import pytest

pytest.importorskip("folimetry.llm.registry")
from pyspark.sql import functions as F

from folimetry.llm import neighbours

RNG = np.random.default_rng(6)
PLAIN = RNG.normal(size=(500, 8))
TIGHT = np.repeat(RNG.normal(size=(5, 8)), 100, axis=0)
CASES = {
    "large": PLAIN * 1e19, "larger": PLAIN * 1e25, "doubles": PLAIN * 1e40, "largest": PLAIN * 1e307, "small": PLAIN * 1e-25, "smallest": PLAIN * 1e-300,
    "far from zero": 1e6 + PLAIN * 1e-3, "tight clusters": TIGHT + PLAIN * 1e-9, "mixed sizes": PLAIN * 10.0 ** RNG.integers(-30, 30, (500, 1)), "equal ones and close ones": np.where(np.arange(500)[:, None] < 250, PLAIN[:1], PLAIN * 1e-12),
}


def force(x, k=10):
    """(distance, row) of the nearest of every hundredth row, in extended precision."""
    wide, out = x.astype(np.longdouble), {}
    for q in range(0, len(x), 100):
        gap = np.sqrt(((wide - wide[q]) ** 2).sum(axis=1))
        gap[q] = np.inf
        order = np.lexsort((np.arange(len(x)), gap))[:k]
        out[q] = gap[order].astype(float), order
    return out


@pytest.mark.parametrize("name", list(CASES))
@pytest.mark.parametrize("shard", [8192, 130])
def test_neighbours_of_any_size(spark, monkeypatch, name, shard):
    monkeypatch.setattr(neighbours, "LEAST_SHARD", shard)
    x = CASES[name]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    rows = neighbours.nearest_rows(table, "vec_id", "embedding", F.col("vec_id") % 100 == 0).collect()
    assert len(rows) == 50
    hits = 0
    for q, (gaps, order) in force(x).items():
        got = sorted((r.rank, r.vec_id, r.score) for r in rows if r.query_id == q)
        assert [r for r, _, _ in got] == list(range(1, 11))
        for (_, i, score), gap in zip(got, gaps):
            hits += bool(np.isclose(score, gap, rtol=1e-9, atol=0))
            assert np.isclose(score, float(np.sqrt(((x[i].astype(np.longdouble) - x[q]) ** 2).sum())), rtol=1e-12, atol=0) or score == 0
    assert hits >= 48


def test_floats_of_the_given_schema(spark):
    x = (PLAIN * 1e19).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    assert neighbours.nearest_rows(table, "vec_id", "embedding", F.col("vec_id") % 100 == 0).count() == 50
