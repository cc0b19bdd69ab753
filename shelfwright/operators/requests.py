"""Request and crawl logs: limits, streaks, frequencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def rate_limit_audit(log: DataFrame, most: int, seconds: int, spans: int = 16) -> DataFrame:
    """Each request with how many its ip made on its endpoint in the window that ends with it, and whether that is too many.

    Time is cut into stretches of some windows; the requests of a stretch's last window are also seen by the
    next one. So a frequent ip's requests are dealt to many tasks.
    """
    at, window = F.unix_micros(F.col("ts").cast("timestamp")), seconds * 1_000_000
    stretch = F.floor(F.col("_at") / (window * spans))
    seen = log.withColumn("_at", at).withColumn("_own", stretch).withColumn("_stretch", F.explode(F.sequence(stretch, F.floor((F.col("_at") + window) / (window * spans)))))
    span = Window.partitionBy("ip", "endpoint", "_stretch").orderBy("_at").rangeBetween(-window, 0)
    counted = seen.withColumn("in_window", F.count("*").over(span)).filter("_own = _stretch").drop("_at", "_own", "_stretch")
    return counted.withColumn("limited", F.col("in_window") > most)


def empty_streaks(crawl: DataFrame, limit: int = 5) -> DataFrame:
    """Consecutive empty pages up to each page of a source, whether the chain is dead, and the next delay in seconds."""
    order = Window.partitionBy("source").orderBy("page")
    run = F.sum((F.col("items") > 0).cast("int")).over(order)
    streak = F.sum((F.col("items") == 0).cast("long")).over(Window.partitionBy("source", "run").orderBy("page"))
    out = crawl.withColumn("run", run).withColumn("streak", streak).drop("run")
    return out.withColumn("dead", F.col("streak") >= limit).withColumn("delay", F.when(F.col("streak") > 0, F.least(F.lit(120), 15 * F.col("streak"))).otherwise(4))


def query_frequency(log: DataFrame, gap: str) -> DataFrame:
    """Sessions of each lower-cased, trimmed query: its hits until it went unasked for the gap."""
    return log.groupBy(F.lower(F.trim("query")).alias("query"), F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("hits"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).drop("w")


def frequent_by_hour(log: DataFrame, kept: int = 1000) -> DataFrame:
    """A summary of each hour's queries, hour, query, hits and error: the `kept` most frequent, less what the next one has.

    A query's true count lies between hits and hits + error, and one that isn't there has at most error. The hour's
    rows are counted before they meet, and no task sees more than `kept` + 1 of each part. log(ts, query); queries
    count in lower case, trimmed; null ones don't.
    """
    counts = log.filter("query is not null").groupBy(F.date_trunc("hour", "ts").alias("hour"), F.lower(F.trim("query")).alias("query")).agg(F.count("*").alias("hits"))
    return _cut_to(counts.withColumn("error", F.lit(0).cast("long")), ["hour"], kept)


def _cut_to(counts: DataFrame, keys: list[str], kept: int) -> DataFrame:
    by = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    first = counts.withColumn("_n", F.row_number().over(by.orderBy(F.desc("hits"), "query"))).filter(F.col("_n") <= kept + 1)
    next_ = F.coalesce(F.max(F.when(F.col("_n") == kept + 1, F.col("hits"))).over(by), F.lit(0).cast("long"))
    cut = first.withColumns({"hits": F.col("hits") - next_, "error": F.col("error") + next_})
    # the first stays also without hits, as it tells of the error
    return cut.filter((F.col("_n") <= kept) & ((F.col("hits") > 0) | (F.col("_n") == 1))).drop("_n")


def frequent_queries(summaries: DataFrame, since, until, kept: int = 1000) -> DataFrame:
    """The summary of a span of whole hours, query, hits and error, from those of its hours.

    Hits of a query are summed, errors of all hours too, as it may have been cut from any; so an error is at most
    the span's requests divided by kept + 1.
    """
    span = summaries.filter((F.col("hour") >= F.lit(since)) & (F.col("hour") < F.lit(until)))
    errors = span.groupBy("hour").agg(F.max("error").alias("error")).agg(F.coalesce(F.sum("error"), F.lit(0).cast("long")).alias("error"))
    counts = span.groupBy("query").agg(F.sum("hits").alias("hits")).crossJoin(F.broadcast(errors))  # a single row
    return _cut_to(counts, [], kept)
