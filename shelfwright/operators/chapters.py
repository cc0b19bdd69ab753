"""Deduplication and order of chapters, and the merge of clusters, on exploded chapters (title_id, pos, label, url, date)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.chapters import chapter_key, chapter_number, chapter_quality, chapter_text, fix_chapter_label, number_value


def first_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The least row of each key in the given order, by an aggregate that combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_x"))
    return picked.select(*[F.col(c) if c in keys else F.col("_x")[c].alias(c) for c in df.columns])


def dedupe_chapters_by_url(chapters: DataFrame) -> DataFrame:
    """The first chapter of each url; those without one go."""
    named = chapters.withColumn("_url", F.trim("url")).filter("_url <> ''")
    return first_by(named, ["title_id", "_url"], ["pos"]).drop("_url")


def dedupe_chapters_by_key(chapters: DataFrame) -> DataFrame:
    return first_by(chapters.withColumn("key", chapter_key(F.col("label"), F.col("url"))), ["title_id", "key"], ["pos"])


def dedupe_chapters_for_display(chapters: DataFrame) -> DataFrame:
    """Of the chapters with the same number (or text), the one of best quality at the place of the first; place counts from 1.

    Numbered ones come first, by descending whole number and ascending decimals.
    """
    label, url = F.col("label"), F.col("url")
    once = dedupe_chapters_by_url(chapters).withColumn("number", chapter_number(label, url))
    once = once.withColumn("identity", F.coalesce(F.concat(F.lit("num:"), "number"), F.concat(F.lit("title:"), chapter_text(F.coalesce(F.nullif(label, F.lit("")), F.trim(url))))))
    once = once.withColumn("quality", chapter_quality(label, url, F.col("date")))
    best = once.groupBy("title_id", "identity").agg(F.min("pos").alias("first_pos"), F.max_by(F.struct("pos", "label", "url", "date", "number"), F.struct("quality", -F.col("pos"))).alias("x"))
    best = best.select("title_id", "first_pos", "x.*").withColumn("value", number_value(F.col("number")))
    order = Window.partitionBy("title_id").orderBy(F.col("value").isNull(), F.floor("value").desc_nulls_last(), F.asc_nulls_last("value"), "first_pos")
    return best.select("title_id", F.row_number().over(order).alias("place"), "pos", fix_chapter_label(F.col("label"), F.col("url")).alias("label"), "url", "date", "number")


def merge_clusters(records: DataFrame, genres: DataFrame, chapters: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Folds each cluster's records(cluster, seq, ...) in order: the winner's row, genres(cluster, genre, at) and chapters(cluster, key, label, url, at).

    genres(seq, pos, genre) and chapters(seq, pos, label, url) belong to the records. A record wins over those
    before it if it has more chapters than their merged list; until some later record brings chapters, that
    list is the first record's own, repeats included.
    """
    who = records.select("cluster", "seq")
    at = F.struct("seq", "pos")
    all_genres = who.join(genres, "seq").groupBy("cluster", "genre").agg(F.min(at).alias("at"))
    keyed = who.join(chapters, "seq").withColumn("key", chapter_key(F.col("label"), F.col("url")))
    merged = keyed.groupBy("cluster", "key").agg(F.min(at).alias("at"), F.min_by(F.struct("label", "url"), at).alias("x"))
    own = keyed.groupBy("seq").agg(F.count("*").alias("own"))
    fresh = merged.groupBy(F.col("at.seq").alias("seq")).agg(F.count("*").alias("fresh"))
    counted = records.join(own, "seq", "left").join(fresh, "seq", "left").fillna(0, ["own", "fresh"])
    before = Window.partitionBy("cluster").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumns({"first": F.first("own").over(before), "others": F.sum((F.col("own") > 0).cast("int")).over(before), "distinct": F.sum("fresh").over(before)})
    have = F.when(F.col("others") - (F.col("first") > 0).cast("int") == 0, F.col("first")).otherwise(F.col("distinct"))
    wins = counted.filter(F.col("first").isNull() | (F.col("own") > have))
    best = wins.groupBy("cluster").agg(F.max_by(F.struct(*records.columns), "seq").alias("x")).select("x.*")
    return best, all_genres, merged.select("cluster", "key", "x.label", "x.url", "at")


def neighbors(chapters: DataFrame, order: str = "pos") -> DataFrame:
    """chapters(title_id, ...) with previous and next in the given order; the first and the last are their own."""
    w = Window.partitionBy("title_id").orderBy(order)
    return chapters.withColumns({"previous": F.coalesce(F.lag(order).over(w), order), "next": F.coalesce(F.lead(order).over(w), order)})
