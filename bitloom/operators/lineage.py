"""Cutting the lineage of iterative state, in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """The same rows, written to the checkpoint folder: plans of later rounds start here and survive lost executors. old: what an
    earlier cut returned and df takes the place of; its files are deleted, so nothing may still have to read it."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        path = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if path is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="spark-"))
    out = df.checkpoint()
    if old is not None:
        written = old._jdf.queryExecution().logical().rdd().getCheckpointFile()
        at = sc._jvm.org.apache.hadoop.fs.Path(written.get())
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
    return out
