"""Counts and reports over titles, batches and crawls."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def source_counts(links: DataFrame, sources: DataFrame, item: str, key: str, name: str) -> DataFrame:
    """source and n: distinct items that links(item, key) has for each of sources(key, name)."""
    n = links.select(item, key).distinct().groupBy(key).agg(F.count("*").alias("n"))
    return sources.join(n, key).select(F.col(name).alias("source"), "n")


def duplicate_keys(df: DataFrame) -> DataFrame:
    """title_key, n and first_id of the keys that several titles have."""
    return df.groupBy("title_key").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).filter("n > 1")


def source_stats(df: DataFrame) -> DataFrame:
    """results, last_id and ok (whether any title has a rating) of each source."""
    return df.groupBy("source").agg(F.count("*").alias("results"), F.max("id").alias("last_id"), F.bool_or(F.col("rating") != "N/A").alias("ok"))


def sync_report(stats: DataFrame) -> DataFrame:
    """Sums of stats(source, items, inserted, updated) for each source and in all (a null source)."""
    return stats.rollup("source").agg(*[F.sum(c).alias(c) for c in ("items", "inserted", "updated")])


def action_counts(merged: DataFrame) -> DataFrame:
    """action and n of a merged snapshot."""
    return merged.groupBy("action").agg(F.count("*").alias("n"))


def pick_stale(df: DataFrame, n: int = 30, needs_backfill: bool = False) -> DataFrame:
    """The n titles with an address that were updated longest ago; with needs_backfill, those without a rating or description."""
    rows = df.filter("url <> ''")
    if needs_backfill:
        rows = rows.filter((F.coalesce("rating", F.lit("N/A")).isin("N/A", "")) | (F.length(F.coalesce("description", F.lit(""))) == 0))
    return rows.orderBy("updated_at", "id").limit(n)


def coverage(expected: DataFrame, have: DataFrame) -> DataFrame:
    """expected(source, expected) with how many titles of each source are missing in have(source)."""
    n = have.groupBy("source").agg(F.count("*").alias("have"))
    return expected.join(n, "source", "left").select("source", "expected", F.greatest(F.lit(0).cast("long"), F.col("expected") - F.coalesce("have", F.lit(0))).alias("missing"))


def find_missing(crawl: DataFrame, catalog: DataFrame, pattern: str) -> DataFrame:
    """The slugs that the addresses of crawl hold, and none of catalog does."""
    slug = F.lower(F.regexp_extract("url", pattern, 1)).alias("slug")
    return crawl.select(slug).filter("slug <> ''").distinct().join(catalog.select(slug), "slug", "left_anti")


def top_queries(log: DataFrame, n: int) -> DataFrame:
    """The n most frequent queries of log(query)."""
    return log.groupBy("query").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "query").limit(n)


def neighbors(chapters: DataFrame, key: str, at: str) -> DataFrame:
    """key, at and the ones before and behind in each title."""
    w = Window.partitionBy(key).orderBy(at)
    return chapters.select(key, at).distinct().select(key, at, F.lag(at).over(w).alias("previous"), F.lead(at).over(w).alias("next"))


def with_level(log: DataFrame) -> DataFrame:
    """log(status, ...) with level: warn for errors (a message, or a status of 400 and above), else info."""
    failed = F.col("status") >= 400
    if "error" in log.columns:
        failed = failed | (F.coalesce("error", F.lit("")) != "")
    return log.withColumn("level", F.when(failed, "warn").otherwise("info"))


def write_request_log(log: DataFrame, path: str) -> None:
    """Appends log as JSON lines, in a folder for each level."""
    with_level(log).write.mode("append").partitionBy("level").json(path)
