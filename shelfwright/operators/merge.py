"""Merging batches of records into snapshots of the catalog.

A snapshot has title_key, title, description, rating, status, type, genres, author, artist, cover_url, url, source,
chapters (array of title, url, date), chapter_count (text), sources (array of name, url, last_seen), published_at,
created_at and updated_at; a batch has seq, title_key and the same columns up to chapters.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chapters import chapter_key, latest_date

FIELDS = ["title", "description", "rating", "status", "type", "genres", "author", "artist", "cover_url", "url", "source", "chapters"]
SNAPSHOT = ["title_key", *FIELDS, "chapter_count", "sources", "published_at", "created_at", "updated_at"]
NO_TEXT = "No description available."
CHAPTERS, SOURCES = "array<struct<title:string,url:string,date:string>>", "array<struct<name:string,url:string,last_seen:timestamp>>"

SNAPSHOT_SCHEMA = (
    "title_key string, title string, description string, rating string, status string, type string, genres array<string>, author string, artist string, cover_url string, url string, source string, "
    f"chapters {CHAPTERS}, chapter_count string, sources {SOURCES}, published_at string, created_at timestamp, updated_at timestamp"
)


def _array(c: Column, kind: str) -> Column:
    return F.coalesce(c, F.array()).cast(kind)


def _keys(chapters: Column) -> Column:
    return F.transform(chapters, lambda c: chapter_key(c["title"], c["url"]))


def _joined(catalog: DataFrame, batch: DataFrame, kind: str) -> DataFrame:
    """old and new (structs) by key, one record of the batch for each; fresh_chapters: those whose keys the stored list lacks."""
    first = batch.filter(F.length("title_key") >= 3).groupBy("title_key").agg(F.min_by(F.struct(*FIELDS), "seq").alias("new"))
    both = catalog.select("title_key", F.struct(*SNAPSHOT[1:]).alias("old")).join(first, "title_key", kind)
    both = both.withColumn("came", _array(F.col("new.chapters"), CHAPTERS)).withColumn("stored", _array(F.col("old.chapters"), CHAPTERS))
    both = both.withColumns({"came_keys": _keys(F.col("came")), "stored_keys": _keys(F.col("stored"))})
    # stored keys come before those that came, by key and place: a key's first entry tells whether it is new
    entry = lambda k, i: F.struct(k.alias("k"), i.alias("i"))
    both = both.withColumn("keyed", F.array_sort(F.concat(F.transform("stored_keys", lambda k: entry(k, F.lit(-1))), F.transform("came_keys", entry))))
    new = F.filter("keyed", lambda x, j: (x["i"] >= 0) & ((j == 0) | ~F.get("keyed", j - 1)["k"].eqNullSafe(x["k"])))
    return both.withColumn("fresh_chapters", F.transform(F.array_sort(F.transform(new, lambda x: x["i"])), lambda i: F.get("came", i)))


def _better() -> dict[str, Column]:
    """Stored fields, replaced where the new record knows more."""
    old, new = (lambda c: F.col(f"old.{c}")), (lambda c: F.col(f"new.{c}"))
    none = F.lit("")
    text = lambda c: F.coalesce(c, none)
    return {
        "rating": F.when(text(new("rating")).isin("N/A", ""), old("rating")).otherwise(new("rating")),
        "status": F.when(text(new("status")).isin("Unknown", ""), old("status")).otherwise(new("status")),
        "cover_url": F.when((text(new("cover_url")) != "") & (F.length(text(old("cover_url"))) < 5), new("cover_url")).otherwise(old("cover_url")),
        "description": F.when((text(new("description")) != NO_TEXT) & (F.length(text(new("description"))) > F.length(text(old("description")))), new("description")).otherwise(old("description")),
        "genres": F.array_union(_array(old("genres"), "array<string>"), _array(new("genres"), "array<string>")),
        "chapters": F.concat("stored", "fresh_chapters"),
        "chapter_count": (F.size("stored") + F.size("fresh_chapters")).cast("string"),
    }


def upsert_titles(catalog: DataFrame, batch: DataFrame, now: datetime.datetime) -> DataFrame:
    """The new snapshot with action (insert, update or keep). Keys under three characters don't come in."""
    j = _joined(catalog, batch, "full_outer")
    stamp = F.lit(now).cast("timestamp")
    entry = F.struct(F.col("new.source").alias("name"), F.col("new.url").alias("url"), stamp.alias("last_seen"))
    inserted = {c: F.col(f"new.{c}") for c in FIELDS} | {
        "description": F.coalesce(F.nullif(F.col("new.description"), F.lit("")), F.lit(NO_TEXT)), "chapters": F.col("fresh_chapters"), "chapter_count": F.size("fresh_chapters").cast("string"),
        "sources": F.array(entry).cast(SOURCES), "published_at": latest_date(F.transform("came", lambda c: c["date"])), "created_at": stamp, "updated_at": stamp,
    }
    sources = _array(F.col("old.sources"), SOURCES)
    known = F.exists(sources, lambda s: s["name"] == F.col("new.source"))
    seen = F.transform(sources, lambda s: F.when(s["name"] == F.col("new.source"), entry).otherwise(s))
    updated = {c: F.col(f"old.{c}") for c in SNAPSHOT[1:]} | _better() | {"sources": F.when(known, seen).otherwise(F.concat(sources, F.array(entry))).cast(SOURCES), "updated_at": stamp}
    action = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNotNull(), "update").otherwise("keep")
    pick = lambda c: F.when(F.col("action") == "insert", inserted[c]).when(F.col("action") == "update", updated[c]).otherwise(F.col(f"old.{c}"))
    return j.withColumn("action", action).select("title_key", *[pick(c).alias(c) for c in SNAPSHOT[1:]], "action")


def refresh_titles(catalog: DataFrame, fresh: DataFrame, now: datetime.datetime) -> DataFrame:
    """The snapshot with what fresh records add to titles that are there; sources stay, nothing is inserted."""
    j = _joined(catalog, fresh, "left")
    better = _better() | {"updated_at": F.lit(now).cast("timestamp")}
    pick = lambda c: F.when(F.col("new").isNotNull(), better[c]).otherwise(F.col(f"old.{c}")) if c in better else F.col(f"old.{c}")
    return j.select("title_key", *[pick(c).alias(c) for c in SNAPSHOT[1:]], F.col("new").isNotNull().alias("refreshed"))


def append_new(catalog: DataFrame, batch: DataFrame, key: str = "title_key", order: str = "seq") -> DataFrame:
    """The rows of batch to append: the first of each key that the catalog lacks."""
    rest = [c for c in batch.columns if c != key]
    first = batch.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("_x")).select(key, "_x.*")
    return first.join(catalog.select(key), key, "left_anti")
