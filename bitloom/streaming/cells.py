"""Keeping a matrix up to date from a stream of events: cells that are new are appended, each once."""

from __future__ import annotations

from pyspark.sql import DataFrame


def new_cells(events: DataFrame, row, col, time: str, delay: str = "1 hour") -> DataFrame:
    """(i, j, time) of a stream, without repeats within the watermark."""
    return events.select(row.alias("i"), col.alias("j"), time).withWatermark(time, delay).dropDuplicatesWithinWatermark(["i", "j"])


def maintained(events: DataFrame, row, col, time: str, path: str, checkpoint: str, delay: str = "1 hour"):
    """Starts the query that appends to the table at path; cells that are older than the watermark and come again are dropped by
    an anti-join with what is there. A batch that is run again rewrites its own folder."""

    def append(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = batch.select("i", "j").distinct()
        try:
            there = spark.read.option("basePath", path).parquet(f"{path}/batch=*").filter(f"batch <> {number}").select("i", "j")
            fresh = fresh.join(there, ["i", "j"], "left_anti")
        except Exception as e:  # noqa: BLE001  the first batch finds no table
            if "PATH_NOT_FOUND" not in str(e):
                raise
        fresh.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return new_cells(events, row, col, time, delay).writeStream.option("checkpointLocation", checkpoint).foreachBatch(append)
