"""What changed between consecutive full snapshots of a table.

All snapshots lie in one range partitioning by record key and are sorted by key and snapshot inside
each range. One streaming pass over a range then plays the two-pointer merge of every snapshot with
its successor: the window below keeps the pointer of the older snapshot one row behind the newer one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The address up to the end of its host, whose letter case says nothing.
HOST = r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)"


def record_url(url: Column) -> Column:
    """url without its fragment and with scheme and host in lower case; null stays null."""
    bare = F.regexp_replace(url, r"(?s)#.*$", "")
    host = F.regexp_extract(bare, HOST, 1)
    return F.concat(F.lower(host), bare.substr(F.length(host) + 1, F.length(bare)))


def snapshot_states(rows: DataFrame, value: str = "normalized_sha256") -> DataFrame:
    """One row for each record and snapshot: the row with the latest stored_at, brought into range order.

    Rows with a null snapshot_no belong to no snapshot. Null parts of a key equal each other. Of rows with
    equal stored_at the one with the largest (value, availability) counts, so repeated rows change nothing.
    A null stored_at is older than any other.
    """
    keyed = rows.where("snapshot_no is not null").select(
        "snapshot_no",
        "source_id",
        record_url(F.col("document_url")).alias("document_url"),
        F.struct("stored_at", F.lower(value).alias("value"), "availability").alias("state"),
    )
    key = ["source_id", "document_url"]
    ranged = keyed.repartitionByRange(*key).sortWithinPartitions(*key, "snapshot_no")
    latest = ranged.groupBy(*key, "snapshot_no").agg(F.max("state").alias("state"))
    present = F.coalesce(F.col("state.availability"), F.lit("active")) != "removed"
    return latest.select(*key, "snapshot_no", F.col("state.value").alias("value"), present.alias("present"))


def snapshot_changes(rows: DataFrame, value: str = "normalized_sha256") -> DataFrame:
    """snapshot_no, source_id, document_url, change_kind (added, removed, changed) of consecutive snapshots.

    The snapshots compared are those that occur in rows, in order of their number; the first gives no rows.
    An empty table gives no rows. Columns beyond those read are ignored, whatever their names.
    """
    rows = rows.select("snapshot_no", "source_id", "document_url", "stored_at", "availability", F.col(value).alias(value))
    return state_changes(snapshot_states(rows, value), rows.where("snapshot_no is not null").select("snapshot_no").distinct())


def state_changes(states: DataFrame, numbers: DataFrame) -> DataFrame:
    """The same from resolved states and the numbers of all snapshots (one row for each delivery, however many records it has)."""
    calendar = numbers.withColumn("earlier", F.lag("snapshot_no").over(Window.orderBy("snapshot_no"))).withColumn(
        "later", F.lead("snapshot_no").over(Window.orderBy("snapshot_no"))
    )
    merged = Window.partitionBy("source_id", "document_url").orderBy("snapshot_no")
    walked = (
        states.withColumn("old", F.lag(F.struct("snapshot_no", "value", "present")).over(merged))
        .withColumn("next_no", F.lead("snapshot_no").over(merged))
        .join(F.broadcast(calendar), "snapshot_no")
    )
    was_there = F.coalesce((F.col("old.snapshot_no") == F.col("earlier")) & F.col("old.present"), F.lit(False))
    here = (
        F.when(F.col("earlier").isNull(), None)
        .when(F.col("present") & ~was_there, "added")
        .when(~F.col("present") & was_there, "removed")
        .when(F.col("present") & was_there & ~F.col("old.value").eqNullSafe(F.col("value")), "changed")
    )
    # A record without a row in the next snapshot is removed there.
    ends = F.col("present") & F.col("later").isNotNull() & ~F.col("next_no").eqNullSafe(F.col("later"))
    events = F.array(
        F.struct(F.col("snapshot_no").alias("no"), here.alias("kind")),
        F.struct(F.col("later").alias("no"), F.when(ends, "removed").alias("kind")),
    )
    return (
        walked.select("source_id", "document_url", F.explode(F.filter(events, lambda e: e["kind"].isNotNull())).alias("e"))
        .select(F.col("e.no").alias("snapshot_no"), "source_id", "document_url", F.col("e.kind").alias("change_kind"))
    )


def keep_snapshot(rows: DataFrame, path: str, value: str = "normalized_sha256") -> None:
    """Add the resolved states of new snapshots to a kept table: a folder for each snapshot, cut into key ranges and sorted
    by key inside each."""
    states = snapshot_states(rows, value)
    states.sortWithinPartitions("snapshot_no", "source_id", "document_url").write.mode("append").partitionBy("snapshot_no").parquet(path)


def newest_changes(spark: SparkSession, path: str) -> DataFrame:
    """What the newest kept snapshot changed; of the table, only the newest two snapshots are read."""
    kept = spark.read.parquet(path)
    numbers = kept.select("snapshot_no").distinct().orderBy(F.desc("snapshot_no")).limit(2)
    two = [r[0] for r in numbers.collect()]
    states = kept.where(F.col("snapshot_no").isin(two)).select("source_id", "document_url", "snapshot_no", "value", "present")
    return state_changes(states, numbers)
