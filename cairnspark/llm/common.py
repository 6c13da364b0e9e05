"""Helpers that every training-data operator shares."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(columns: list[str], *names: str) -> tuple[str, ...]:
    """Each name, with underscores added until no column has it; so what an operator adds replaces nothing."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return tuple(out)


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z and nothing else; null counts as the empty text."""
    return F.translate(F.coalesce(col.cast("string"), F.lit("")), UPPER, LOWER)


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, read from the session; only where it is unset in local mode (as in tests) is one made."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and spark.sparkContext.getCheckpointDir() is None:
        if not re.match(r"local(\[[^,]*(,[^,]*)?\])?$", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir names no folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cairn-checkpoint-"))
    return named or spark.sparkContext.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder that the cluster names."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def release() -> None:
    """Give memory that a task has freed back to the system, as the worker lives on for other tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` whose tasks give their memory back when they end."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return df.mapInArrow(whole, schema)


def per_batch(df: DataFrame, schema: str, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]]) -> DataFrame:
    """``mapInArrow`` with state that is made once per task: ``make()`` gives the function for each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            if (out := step(batch)) is not None:
                yield out

    return map_arrow(df, run, schema)


def spread_by_class(members: DataFrame, classes: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """Inner join of ``members`` with one row per ``key`` of ``classes`` that stands up to a hot key.

    ``hot`` holds the keys whose share of the members is at least a fixed fraction f, so it has at most 1/f rows:
    that bound is what makes the broadcast safe.  Every other key holds less than that fraction and is shuffled.
    """
    hot = F.broadcast(hot.select(key))
    few = F.broadcast(classes.join(hot, key, "left_semi"))
    return members.join(few, key).unionByName(members.join(hot, key, "left_anti").join(classes.join(hot, key, "left_anti"), key))


def slices(batch: pa.RecordBatch, column: str, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch that hold about ``most_bytes`` of the column each, one row at least; nothing is copied."""
    import numpy as np
    import pyarrow.compute as pc

    size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most_bytes, side="right")))
        yield batch.slice(at, end - at)
        at = end
