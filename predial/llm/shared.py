"""Tables written to the folder that driver and executors share, and small schema helpers."""

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"
_PATHS: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where a local session has none (tests), a new folder that is then set."""
    folder = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{KEY} must name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set(KEY, folder)
    return folder.rstrip("/")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hand texts to Python a thousand rows at a time, unless the session already asks for fewer.

    Whole texts are wide: ten thousand of them, in the JVM, in Python and on the way back, are much of an executor.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def write_table(df: DataFrame, name: str, compression: str = "lz4") -> tuple[DataFrame, str]:
    """Write ``df`` under the shared folder and return it reread, with its path.

    The reread table has no lineage behind it, so a lost executor costs no more than rereading.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    _PATHS[table] = path
    return table, path


def release(*tables: DataFrame) -> None:
    """Delete tables of write_table() that nothing reads any more."""
    for table in tables:
        drop_table(table.sparkSession, _PATHS.pop(table))


def drop_table(spark: SparkSession, path: str) -> None:
    """Delete a table of write_table() that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of the frame has it (case aside)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
