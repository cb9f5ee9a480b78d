"""Registered queries: each name has a DataFrame builder and, where SQL can say it, reference SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
#: Bytes of rows that a Python worker gets at once (or one row that is larger). Texts and images are several times as large
#: as objects, so that the default, 64 MB, takes some 300 MB a worker once tables fill it.
BATCH_BYTES = 4 << 20


def small_batches(query: Query) -> Query:
    """The query with its session's Arrow batches bounded, so that a worker's memory doesn't grow with the table."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
        return query(spark, sf_dir)

    return run


def register(name: str, build: Query, oracle: str | None = None) -> None:
    """Add a query; a name is given once."""
    if name in _QUERIES:
        raise ValueError(f"query {name} is registered twice")
    _QUERIES[name] = small_batches(build)
    if oracle:
        _ORACLES[name] = oracle


def _load() -> None:
    from folimetry import plans  # noqa: F401


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
