"""Smallest linked id: connected components of a pair table by minimum propagation with pointer jumping."""

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir.

    A local session that names none gets a new folder under /tmp; on a cluster that is an error, since every executor
    would write to a disk of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage in shared_folder()."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def smallest_linked(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component) of every id in the pairs.

    Each turn replaces an edge by edges to the smaller end's least neighbour, until every id points at its
    component's least id; turns grow with the logarithm of the longest chain.
    """
    edges = checkpointed(pairs.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).distinct())
    before = None
    while (now := tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first())) != before:
        before = now
        both = edges.unionAll(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = checkpointed(both.groupBy(F.col("hi").alias("u")).agg(F.least(F.min("lo"), F.first("hi")).alias("m")))
        large = both.where("lo > hi").join(least, F.col("hi") == F.col("u")).select(F.col("lo").alias("hi"), F.col("m").alias("lo")).unionAll(least.where("u <> m").select(F.col("u").alias("hi"), F.col("m").alias("lo"))).distinct()
        low = checkpointed(large.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m")))
        small = large.join(low, F.col("hi") == F.col("u")).where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        edges = checkpointed(small.unionAll(low.select(F.col("u").alias("hi"), F.col("m").alias("lo"))).where("hi <> lo").distinct())
    found = edges.groupBy(F.col("hi").alias("id")).agg(F.min("lo").alias("component"))
    roots = edges.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct()
    return found.unionAll(roots.join(found, "id", "left_anti"))
