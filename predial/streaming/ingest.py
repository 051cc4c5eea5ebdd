"""Scraped rows that keep arriving, merged batch by batch."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..config import DEFAULT, Config
from ..operators.components import checkpointed
from ..operators.ingest import upsert
from ..operators.quality import expire
from ..sources.store import Store


def stream_upserts(spark: SparkSession, source: str, schema: str, read: Callable[[], DataFrame], write: Callable[[DataFrame, DataFrame, int], None], as_of: str, checkpoint: str) -> StreamingQuery:
    """Merge each new file of ``source`` into the snapshot that read() gives; write(snapshot, log, epoch) stores both.

    write() must be idempotent per epoch (a snapshot folder per epoch is), because Spark may repeat an epoch.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        snapshot, log = upsert(read(), batch, as_of)
        write(snapshot, log, epoch)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_epoch(store: Store, batch: DataFrame, epoch: int, as_of: str, cfg: Config = DEFAULT) -> int:
    """Merge one epoch's rows into the store's listings and log as a new version; an epoch that is there has no effect.

    Snapshot and log become visible together, so an epoch that Spark repeats after a failure is either whole or undone.
    """
    if (done := [n for n, c in store.commits().items() if c["epoch"] == epoch]) or batch.isEmpty():
        return done[-1] if done else max(store.commits())
    listings, history = store.read("listings"), store.read("log")
    snapshot, log = upsert(listings, checkpointed(batch), as_of, cfg, history=history)
    log = history.unionByName(log.select(history.columns))
    return store.write({"listings": snapshot, "log": log}, epoch)


def stream_into(store: Store, source: str, schema, as_of: str, files: int, checkpoint: str, cfg: Config = DEFAULT, timeout: int = 3600) -> int:
    """Merge the files of ``source``, ``files`` an epoch in their order, until none is left; then listings not seen expire. The last version.

    Rows carry ``arrival``. Run again, only files that are new are merged.
    """
    spark = store.spark
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(source)
    running = stream.writeStream.foreachBatch(lambda batch, epoch: merge_epoch(store, batch, epoch, as_of, cfg) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    if not running.awaitTermination(timeout):
        running.stop()
        raise TimeoutError("the stream did not end")
    last = store.read("listings")
    return store.write({"listings": expire(last, as_of, cfg), "log": store.read("log")}, counts={"listings": last.count()})
