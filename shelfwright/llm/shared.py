"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..sources.folders import written as materialize  # noqa: F401

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 4000, size: int = 16 << 20) -> None:
    """Bounds the Arrow batches of this session by rows and bytes, so that very long texts can't fill a worker, and frees shuffle files early."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", True)  # shuffle files go when their query ends


def released(run: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """run for mapInPandas, after which the worker, which Spark keeps for other tasks, gives freed memory back to the system."""

    @functools.wraps(run)
    def inner(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
            ctypes.CDLL(None).malloc_trim(0)

    return inner
