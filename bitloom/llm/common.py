"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: `spark.checkpoint.dir`; a folder of its own only where that is unset and all runs in one
    process."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def _file(spark: SparkSession, path: str):
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(sc._jsc.hadoopConfiguration()), at


def written(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage: the table is written to the shared folder and read again, with the same schema. It goes with the
    session, or before by `discard`."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, at = _file(spark, path)
    fs.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    if _scopes:
        _scopes[-1].append(out)
    return out


_scopes: list[list[DataFrame]] = []


@contextmanager
def scratch():
    """What is written within is deleted at the end, but for the tables given to the function this yields."""
    made: list[DataFrame] = []
    kept: list[DataFrame] = []
    _scopes.append(made)
    try:
        yield kept.append
    finally:
        _scopes.pop()
        for df in made:
            if not any(df is k for k in kept):
                discard(df)


def discard(df: DataFrame) -> None:
    """Deletes what `written` wrote; nothing may still have to read it."""
    fs, at = _file(df.sparkSession, df._written_to)
    fs.delete(at, True)


def worker_state(name: str) -> dict:
    """A dict that lives as long as the Python worker. This package travels to the executors by value, so that its own globals
    are new in every task; a module that is registered under a name of its own stays."""
    module = sys.modules.setdefault("bitloom_worker_state", types.ModuleType("bitloom_worker_state"))
    return module.__dict__.setdefault(name, {})


def converted(batches: Iterator, made: Callable, trim: bool = False) -> Iterator:
    """made(batch) of every Arrow batch. A batch goes before the next one is read, and so does what Arrow's pool would keep for
    later: a Python worker outlives its task, and what it keeps adds to all that later stages take. trim: the C library gives back what it
    holds free, too, which many small objects leave behind."""
    import ctypes

    import pyarrow as pa

    pool = pa.default_memory_pool()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None) if trim else None  # glibc has it
    for out in map(made, batches):
        yield out
        del out
        pool.release_unused()
        if give_back is not None:
            give_back(0)


def matched(rows: DataFrame, keys: DataFrame, same: Column, how: str, most: int) -> DataFrame:
    """rows joined with keys, a written table. Keys of at most `most` rows are broadcast, so that rows stay where they are."""
    return rows.join(F.broadcast(keys) if keys.count() <= most else keys, same, how)


def let(value: Column, body) -> Column:
    """body(value), with value computed once a row however often body uses it."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def space_words(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text."""
    return F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")


def indices(last: Column) -> Column:
    """0..last, or nothing if last is negative."""
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def add(values: Column, kind: str = "bigint") -> Column:
    return F.aggregate(values, F.lit(0).cast(kind), lambda a, x: a + x)


def boxed(docs: DataFrame, **more: Column) -> DataFrame:
    """The rows as one column `row`, besides more: extra columns of any name clash with nothing."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(k) for k, c in more.items()])


def unboxed(df: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of docs again, in order, with those in changed replaced."""
    return df.select(*[changed.get(c, F.col(f"row.`{c}`")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns])
