"""Named sources of records: what a user adds is a function from a session to a DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Source = Callable[[SparkSession], DataFrame]
_sources: dict[str, Source] = {}


def register_source(name: str, source: Source) -> None:
    """Names count without regard to case; a later source of the same name replaces the earlier."""
    _sources[name.lower()] = source


def source_named(name: str) -> Source | None:
    return _sources.get(name.lower())


def union_sources(spark: SparkSession, names: Iterable[str]) -> DataFrame:
    """The records of the named sources with source_no, their place in the list; seq orders them inside a source."""
    out = None
    for k, name in enumerate(names):
        own = _sources[name.lower()](spark).withColumn("source_no", F.lit(k))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    if out is None:
        raise ValueError("no source is named")
    return out
