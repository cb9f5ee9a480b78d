"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folimetry.llm.scratch import release, shared_folder, written


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of links(u, v): the smallest node that links lead to.

    Each round hangs every node below the smallest neighbour seen, so that rounds grow with the logarithm of the longest
    chain. Links stay as many rows as there are nodes; none go to the driver, and a round's tables are deleted after the
    next. Joins on a node with very many links are split by AQE. Self-links and repeated ones are harmless; a table
    without links has no components.
    """
    folder = shared_folder(links.sparkSession)
    pair = [F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")]
    now = written(links.filter("u <> v").select(*pair).distinct(), folder, links.count())
    state = _state(now)
    while state[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = written(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), folder, 2 * state[0])
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("x"))
        earlier, now = now, written(small.select(F.col("x.u").alias("u"), F.col("x.m").alias("v")).filter("u <> v").distinct(), folder, 2 * state[0])
        release(earlier, large)
        before, state = state, _state(now)
        if state == before:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
