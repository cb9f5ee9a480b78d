"""Calls of a worker over rows in tasks: batches, retries, and an error column instead of a failed job."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH, TRIES = 8, 3


def _called(worker: Callable[[list], list], batch: list, tries: int, pause: float) -> tuple[list | None, str | None, int]:
    """(results, error, calls) of one batch: the first call of at most so many that returns a result for each row."""
    wrong = None
    for call in range(1, tries + 1):
        try:
            out = list(worker(batch))
            if len(out) != len(batch):
                raise ValueError(f"{len(out)} results for {len(batch)} rows")
            return out, None, call
        except Exception as e:  # noqa: BLE001 a worker may raise anything; it becomes a row's error
            wrong = f"{type(e).__name__}: {e}"
            if pause and call < tries:
                time.sleep(pause)
    return None, wrong, tries


def call_worker(
    rows: DataFrame, column: str, worker: Callable[[list], list], result: str = "string", batch: int = BATCH, tries: int = TRIES, pause: float = 0.0, setup: Callable[[], Callable[[list], list]] | None = None,
) -> DataFrame:
    """The columns of `rows` with result, error, calls and seconds of a worker that takes a list of values of `column` and
    returns as many results of the type `result`.

    A batch that fails is called again, row by row, up to `tries` times each; a row that fails each time has a null result
    and its last error, and the others keep their results. `setup` makes the worker once a task (a model to load) in place
    of `worker`; if it fails, the task does, and Spark repeats it. Null values are passed on like others. A lost task is
    repeated as a whole, so that a worker must bear repeated calls. Batches don't reach across tasks.
    """
    clash = {"result", "error", "calls", "seconds"} & {c.lower() for c in rows.columns}
    if clash:
        raise ValueError(f"columns {sorted(clash)} are in the way")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready = setup() if setup else worker
        for part in parts:
            values, made = part[column].tolist(), []
            for a in range(0, len(values), batch):
                here = values[a : a + batch]
                began = time.perf_counter()
                out, wrong, calls = _called(ready, here, 1, 0)
                if wrong is None:
                    took = (time.perf_counter() - began) / len(here)
                    made += [(x, None, calls, took) for x in out]
                    continue
                for value in here:
                    began = time.perf_counter()
                    out, wrong, calls = _called(ready, [value], tries, pause)
                    made.append((out[0] if wrong is None else None, wrong, calls + 1, time.perf_counter() - began))
            results = pd.DataFrame(made, columns=["result", "error", "calls", "seconds"], index=part.index, dtype=object).astype({"calls": "int32", "seconds": "float64"})
            yield pd.concat([part, results], axis=1)

    head = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema)
    return rows.mapInPandas(run, f"{head}result {result}, error string, calls int, seconds double")


def failures(called: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rows, failed, calls) of call_worker()'s rows, and the commonest error (the smallest of equally common ones)."""
    counted = called.groupBy(*keys, "error").agg(F.count("*").alias("n"), F.sum("calls").alias("calls"))
    worst = F.min_by(F.col("error"), F.struct(-F.col("n"), F.col("error"))).alias("commonest_error")
    return counted.groupBy(*keys).agg(F.sum("n").alias("rows"), F.sum(F.when(F.col("error").isNotNull(), F.col("n")).otherwise(0)).alias("failed"), F.sum("calls").alias("calls")).join(
        counted.filter("error is not null").groupBy(*keys).agg(worst), keys, "left",
    )
