"""Rows with versions: what a snapshot sees, the newest entry of a key, and cycles of waiting transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowmill.functions.names import unused
from rowmill.sources.shared import shared_folder


def visible(rows: DataFrame, transactions: DataFrame, snapshot: int, me: int | None = None, created: str = "xmin", deleted: str = "xmax") -> DataFrame:
    """Rows that were created by a transaction the snapshot sees and not deleted by one it sees.

    transactions: (txn, status) with status `committed`, `aborted` or `running`. A snapshot sees the committed ones with
    numbers below it, and `me`; deleted is 0 or null for rows that nobody deleted."""
    seen = transactions.filter((F.col("status") == "committed") & (F.col("txn") < snapshot) | (F.col("txn") == F.lit(me))).select("txn").distinct()
    (number,) = unused(rows.columns, "number")
    seen = seen.withColumnRenamed("txn", number)
    live = rows.join(seen, F.col(created) == F.col(number), "left_semi")
    return live.join(seen, (F.col(deleted) != 0) & (F.col(deleted) == F.col(number)), "left_anti")


def newest(entries: DataFrame, *key: str, order: str = "seq", tombstone: str = "tomb") -> DataFrame:
    """The entry with the largest order of each key, unless it is a tombstone. One aggregation, combined before its shuffle."""
    rest = [c for c in entries.columns if c not in key]
    (top,) = unused(entries.columns, "top")
    last = entries.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias(top))
    return last.select(*key, f"{top}.*").filter(~F.col(tombstone)).select(*entries.columns)


def range_count(df: DataFrame, name: str, low: int, high: int) -> DataFrame:
    return df.filter(F.col(name).between(low, high)).agg(F.count(F.lit(1)).alias("n"))


def _endless(edges: DataFrame) -> DataFrame:
    """txn of every waiter from which a walk along (waiter, holder) edges need not end.

    Each step drops the edges to those that wait for nobody, and leads the others past every holder with a single edge, so that
    chains halve. The edges only get fewer, and as long as some walk ends, at least one edge goes; the last step drops none."""
    now, before = edges.distinct(), -1
    while (n := (now := now.checkpoint()).count()) not in (0, before):
        before = n
        past = now.groupBy(F.col("waiter").alias("holder")).agg(F.count(F.lit(1)).alias("_n"), F.min("holder").alias("_next"))
        now = now.join(past, "holder").select("waiter", F.when(F.col("_n") == 1, F.col("_next")).otherwise(F.col("holder")).alias("holder")).distinct()
    return now.select(F.col("waiter").alias("txn")).distinct()


def deadlocked(waits: DataFrame) -> DataFrame:
    """txn of every transaction on a cycle of (waiter, holder) edges, or between two: those from which neither the walk along the edges nor the one against them need end."""
    spark, edges = waits.sparkSession, waits.select("waiter", "holder")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    against = edges.select(F.col("holder").alias("waiter"), F.col("waiter").alias("holder"))
    return _endless(edges).join(_endless(against), "txn", "left_semi")
