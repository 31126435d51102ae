"""Tables written to the folder that driver and executors share.

The folder is the session's ``spark.checkpoint.dir``. Only where that is unset (tests, a laptop)
is a folder of our own made, and set as the checkpoint folder for the session.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


BATCH_BYTES = 4 << 20
BROADCAST_BYTES = 64 << 20
#: Whether Spark removes the shuffle files of a query when it ends.
REMOVES_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext.getCheckpointDir()
        if current:
            return current.rstrip("/")
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(folder)
        return spark.sparkContext.getCheckpointDir().rstrip("/")
    return folder.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """Let Spark hand rows to Python workers in batches of BATCH_BYTES at most, whatever the length of
    the texts; a lower setting of the session's own stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    size = re.fullmatch(r"(\d+)([kmg]?)b?", spark.conf.get(key).lower())
    if size is None or int(size[1]) << {"": 0, "k": 10, "m": 20, "g": 30}[size[2]] > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def cut(df: DataFrame, label: str, codec: str = "lz4") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends here, and a
    lost executor costs a re-read instead of a re-run. Shuffle files of the write go when it ends, as nothing
    reads them again."""
    spark = df.sparkSession
    path = new_path(spark, label)
    before = spark.conf.get(REMOVES_SHUFFLES, "false")
    spark.conf.set(REMOVES_SHUFFLES, "true")
    try:
        df.write.option("compression", codec).parquet(path)
    finally:
        spark.conf.set(REMOVES_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_table(df: DataFrame) -> None:
    """Remove the files of a table made by ``cut`` which nothing reads any more."""
    spark = df.sparkSession
    jvm, root = spark._jvm, shared_dir(spark).removeprefix("file://").removeprefix("file:")
    folders = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        if root in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bounded_broadcast(df: DataFrame, max_rows: int, width: Column | None = None) -> DataFrame:
    """Mark ``df`` for broadcast only if a count proves it small; otherwise Spark shuffles it. ``width``
    gives the bytes of a row where rows have no bound of their own."""
    some = df.limit(max_rows + 1).agg(F.count("*"), F.sum(F.lit(0) if width is None else width)).first()
    return F.broadcast(df) if some[0] <= max_rows and (some[1] or 0) <= BROADCAST_BYTES else df
