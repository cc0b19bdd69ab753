"""Lookups that complete records: details, fresh ratings, route rules, hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.pages import host_of, host_suffixes, is_private_host
from .catalog import least_of


def _given(c: Column) -> Column:
    """Null for what counts as not known."""
    return F.when(~c.isin("", "N/A", "Unknown"), c)


def _once(details: DataFrame, columns: list[str], on: str) -> DataFrame:
    """_on and _d, the columns of the least of the detail records of each key, so that repeated ones multiply no rows."""
    return details.groupBy(F.col(on).alias("_on")).agg(F.min(F.struct(*columns)).alias("_d"))


def overlay_details(listed: DataFrame, details: DataFrame, columns: list[str], on: str = "url") -> DataFrame:
    """listed with a detail record's columns where there is one with the same url, the least of several."""
    joined = listed.join(_once(details, columns, on), listed[on] == F.col("_on"), "left")
    return joined.select(*[F.when(F.col("_d").isNotNull(), F.col("_d")[c]).otherwise(listed[c]).alias(c) if c in columns else listed[c] for c in listed.columns])


def enrich(listed: DataFrame, details: DataFrame, columns: list[str], on: str = "url") -> DataFrame:
    """listed with the known ones of a detail record's columns; empty, N/A and Unknown replace nothing. Of several records the least counts."""
    joined = listed.join(_once(details, columns, on), listed[on] == F.col("_on"), "left")
    return joined.select(*[F.coalesce(_given(F.col("_d")[c]), listed[c]).alias(c) if c in columns else listed[c] for c in listed.columns])


def backfill_ratings(catalog: DataFrame, fresh: DataFrame) -> DataFrame:
    """catalog(title_key, rating) with fresh ratings other than N/A, the least of several, and whether each was updated."""
    new = fresh.groupBy("title_key").agg(F.min(F.when(F.col("rating") != "N/A", F.col("rating"))).alias("_new"))
    found = catalog.join(new, "title_key", "left")
    return found.withColumn("updated", F.col("_new").isNotNull()).withColumn("rating", F.coalesce("_new", "rating")).drop("_new")


def match_fresh(stale: DataFrame, fresh: DataFrame) -> DataFrame:
    """id and fresh_id of each stale title: by url, else the first of fresh with its key."""
    by_url = least_of(fresh.filter("url <> ''"), ["url"], "id").select("url", F.col("id").alias("by_url"))
    by_key = least_of(fresh.filter("title_key <> ''"), ["title_key"], "id").select("title_key", F.col("id").alias("by_key"))
    return stale.join(by_url, "url", "left").join(by_key, "title_key", "left").select("id", F.coalesce("by_url", "by_key").alias("fresh_id"))


def match_rule(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """paths(path) with the longest route_key that begins it, null without one.

    Prefixes of each distinct path at the lengths that rules have are joined by equality.
    """
    lengths = [r[0] for r in rules.select(F.length("route_key")).distinct().collect()]  # as many as there are lengths of route keys
    wanted = paths.select("path").distinct()
    cut = wanted.select("path", F.explode(F.array(*[F.left("path", F.lit(n)) for n in lengths]).cast("array<string>")).alias("route_key")).distinct()
    found = cut.join(rules, "route_key").groupBy("path").agg(F.max_by("route_key", F.length("route_key")).alias("route_key"))
    return paths.join(found, "path", "left")


def classify_urls(urls: DataFrame, allowed: DataFrame) -> DataFrame:
    """urls(url) with host and verdict: bad scheme, private host, unknown host or allowed; allowed(domain) holds for subdomains too."""
    hosts = urls.withColumn("host", host_of(F.col("url")))
    known = hosts.select("host").distinct().select("host", F.explode(host_suffixes(F.col("host"))).alias("domain")).join(allowed, "domain", "left_semi").select("host").distinct().withColumn("_ok", F.lit(True))
    verdict = F.when(~F.lower("url").startswith("https://"), "bad scheme").when(is_private_host(F.col("host")), "private host").when(F.col("_ok"), "allowed").otherwise("unknown host")
    return hosts.join(known, "host", "left").withColumn("verdict", verdict).drop("_ok")


def with_origin(urls: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """urls(url) with the origin of the first rule (part of the host, origin) that fits, else its own host."""
    host = host_of(F.col("url"))
    origin = F.concat(F.lit("https://"), host, F.lit("/"))
    for part, put in reversed(rules):
        origin = F.when(host.contains(part), put).otherwise(origin)
    return urls.withColumn("origin", origin)


def apply_blocks(log: DataFrame, blocks: DataFrame, stretch_s: int = 3600) -> DataFrame:
    """log(ip, ts) with blocked: whether a block of the ip (ts, duration_s) that began by then still holds; as-of by one window.

    Of blocks that overlap, the one that ends last holds. Time is cut into stretches, and a block goes to
    each that it reaches into, so that a frequent ip's requests are dealt to many tasks.
    """
    at, size = F.unix_micros(F.col("ts").cast("timestamp")), stretch_s * 1_000_000
    stretch = lambda t: F.floor(t / size)
    until = at + F.col("duration_s").cast("long") * 1_000_000
    marks = blocks.select("ip", "ts", until.alias("_until"), F.lit(0).alias("_kind"), F.explode(F.sequence(stretch(at), stretch(until))).alias("_stretch"))
    both = log.withColumns({"_kind": F.lit(1), "_stretch": stretch(at)}).unionByName(marks, allowMissingColumns=True)
    seen = Window.partitionBy("ip", "_stretch").orderBy("ts", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_end", F.max("_until").over(seen)).filter("_kind = 1")
    return both.withColumn("blocked", F.coalesce(at <= F.col("_end"), F.lit(False))).drop("_kind", "_until", "_end", "_stretch")


def pending_pages(done: DataFrame, last: DataFrame) -> DataFrame:
    """source and page of the pages 2 to last(source, last_page) that done(source, page) lacks."""
    wanted = last.filter("last_page >= 2").select("source", F.explode(F.sequence(F.lit(2), F.col("last_page"))).alias("page"))
    return wanted.join(done, ["source", "page"], "left_anti")


def failed_pages(crawl: DataFrame) -> DataFrame:
    """source and page whose last attempt (ts, attempt) brought no items."""
    last = crawl.groupBy("source", "page").agg(F.max_by("items", F.struct("ts", "attempt")).alias("items"))
    return last.filter("items = 0").select("source", "page")
