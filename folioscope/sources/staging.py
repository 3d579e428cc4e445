"""Cutting lineage on storage that every executor can reach."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType

#: A side of a join is broadcast only when it was measured and found to take at most this many bytes.
BROADCAST_BYTES = 48 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, one of our own is set in local mode; on a cluster,
    whose machines share no such folder, that is an error."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors reach")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="folioscope-"))
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
    return current.get().rstrip("/")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df as a parquet table in the shared folder and read it back.

    The table is columnar and compressed, survives lost executors, and gives the planner its true size.
    """
    path = f"{shared_dir(df.sparkSession)}/stage-{label}-{uuid.uuid4().hex}"
    _staged.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage_by(df: DataFrame, key: str, label: str) -> DataFrame:
    """As stage, but in one bucket for each shuffle partition of the key, so joins on the key read the table as it lies
    and never shuffle it, however large it and the other side are. A df that was just grouped by the key isn't shuffled
    for it either.

    Only a table of the catalog can have buckets; it leaves the catalog as soon as it is read, the files stay.
    """
    spark, name = df.sparkSession, uuid.uuid4().hex
    path, table = f"{shared_dir(spark)}/stage-{label}-{name}", f"stage_{name}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    _staged.append(path)
    df.repartition(parts, key).write.format("parquet").bucketBy(parts, key).option("path", path).saveAsTable(table)
    try:
        return spark.table(table)
    finally:
        spark.sql(f"drop table {table}")


_staged: list[str] = []


@atexit.register
def _tidy() -> None:
    """What a process staged goes when it ends in order."""
    context = SparkContext._active_spark_context
    if _staged and context is not None and context._jsc is not None:
        try:
            release(SparkSession(context))
        except Exception:  # noqa: BLE001
            pass


def release(spark: SparkSession) -> int:
    """Delete the staged tables of this process, once the results that read them are written; how many there were."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    n = len(_staged)
    while _staged:
        path = jvm.org.apache.hadoop.fs.Path(_staged.pop())
        path.getFileSystem(conf).delete(path, True)
    return n


def measured(df: DataFrame) -> int:
    """About how many bytes the rows of a staged df take in memory: fixed widths, and the lengths of texts and lists."""
    fixed, loose = 16, []
    for f in df.schema.fields:
        kind = f.dataType
        if isinstance(kind, (StringType, BinaryType)):
            loose.append(F.coalesce(F.octet_length(f.name), F.lit(0)))
            fixed += 16
        elif isinstance(kind, ArrayType):
            loose.append(F.greatest(F.size(f.name), F.lit(0)) * 16)
            fixed += 24
        else:
            fixed += 8
    more = sum(loose[1:], loose[0]) if loose else F.lit(0)
    rows, extra = df.agg(F.count("*"), F.sum(more.cast("long"))).first()
    return rows * fixed + (extra or 0)


def small_or_shuffled(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """A staged df with a broadcast hint if it was measured to be small, else as it is for a shuffled join."""
    return df.hint("broadcast") if measured(df) <= most else df.hint("merge")
