"""Connected components of a link table, by alternating large-star and small-star steps.

Every step is a minimum per node, which combines before it shuffles, and a join of two written tables, whose large
keys adaptive execution can split. Each step's table is written to the shared folder and the one before is deleted.
"""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drop_table, write_table


#: Edges of a written part.
ROWS = 200_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo")), F.sum(F.pmod(F.xxhash64("lo", "hi"), F.lit(1 << 31)))).first())


def _least(pairs: DataFrame, node: str, other: str, parts: int) -> tuple[DataFrame, str]:
    return write_table(pairs.groupBy(F.col(node).alias("node")).agg(F.least(F.min(other), F.first(node)).alias("least")).coalesce(parts), "least")


def connected(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for every node of the links, component being the smallest node it reaches.

    Links have no direction; repeated links and links of a node to itself change nothing; null ends are dropped.
    """
    spark = links.sparkSession
    ends = links.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    edges, path = write_table(ends.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct(), "links")
    before = None
    while (now := _state(edges)) != before:
        before = now
        parts = 4 + now[0] // ROWS
        both = edges.where("hi <> lo").select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least, used = _least(both, "u", "v", parts)
        large = both.where("v >= u").join(least, F.col("u") == F.col("node")).select(F.col("v").alias("hi"), F.col("least").alias("lo")).distinct()
        large, large_path = write_table(large.coalesce(parts), "links")
        low, used_low = _least(large, "hi", "lo", parts)
        joined = large.join(low, F.col("hi") == F.col("node"))
        small = joined.select(F.col("lo").alias("hi"), F.col("least").alias("lo")).unionAll(low.select(F.col("node").alias("hi"), F.col("least").alias("lo")))
        edges, new = write_table(small.distinct().coalesce(parts), "links")
        for old in (path, used, large_path, used_low):
            drop_table(spark, old)
        path = new
    return edges.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("component"))


def spanning(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Links (node, smallest node) that join what the pairs left[i] - right[j] join."""
    nodes, back = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = back[: len(left)][i], back[len(left) :][j]
    least = np.arange(len(nodes))
    while True:
        low = np.minimum(least[a], least[b])
        new = least.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, least):
            break
        least = new
    return [(int(nodes[k]), int(nodes[least[k]])) for k in np.unique(np.concatenate([a, b])).tolist() if least[k] != k]
