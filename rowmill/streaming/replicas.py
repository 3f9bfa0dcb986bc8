"""A replica that follows a table's commits with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowmill.sources.tables import Conflict, Table


def follow(source: Table, replica: Table, checkpoint: str):
    """Starts a query that applies the source's new commits to the replica, in order, and stops when it has caught up.

    A commit is applied once: those that the replica's log has are skipped, so a restart or a repeated batch changes nothing, and
    one that arrives before an earlier one brings that along. Where a vacuum has taken folders of earlier commits, the replica
    goes on from the compaction that replaced them; those versions alone cannot be read there."""
    spark = source.spark
    stream = spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", "*.json").load(f"{source.path}/log").select(F.regexp_extract(F.input_file_name(), r"(\d+)\.json$", 1).cast("int").alias("n"))

    def apply(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        todo = {n: source._entry(n) for n in range(replica.version() + 1, source.version() + 1)}
        base = max((n for n, e in todo.items() if e.get("replace")), default=0)
        there = lambda e: all(source._fs.exists(source._path(x)) for kind in ("add", "delete") for x in e[kind])
        gone = not all(there(e) for n, e in todo.items() if n < base)
        for n, entry in todo.items():
            kept = {k: entry[k] for k in ("replace", "time", "all") if k in entry}
            if n < base and gone:
                copied = {"add": [], "delete": [], "of": n, "skipped": True}
            else:
                copied = {"add": entry["add"], "delete": entry["delete"], "of": n, **kept}
                for folder in (*entry["add"], *entry["delete"]):
                    spark.read.parquet(f"{source.path}/{folder}").write.mode("overwrite").parquet(f"{replica.path}/{folder}")
            try:
                replica._create(f"log/{n}.json", copied)
            except Conflict:
                if replica._entry(n).get("of") != n:
                    raise

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def lag(source: Table, replica: Table) -> int:
    """Commits that the replica has not applied yet."""
    return source.version() - replica.version()
