"""JSON feeds of series and chapters, read with declared schemas, and paged feeds put together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SERIES_1 = "title string, slug string, public_url string, cover string, rating string, status string, type string, author string, artist string, description string, genres array<struct<name:string>>, latest_chapters array<struct<number:string,published_at:string>>, chapter_count int"
CHAPTER_2 = "array<struct<chapter_name:string,chapter_title:string,chapter_slug:string,created_at:string>>"
SERIES_2 = f"title string, series_slug string, description string, rating string, status string, thumbnail string, author string, artist string, tags array<string>, meta struct<chapters_count:int>, free_chapters {CHAPTER_2}, paid_chapters {CHAPTER_2}"
PAGE = "slug string, offset int, data struct<chapters:array<struct<chapter_name:string,chapter_slug:string,updated_at:string>>,pagination:struct<total:int,limit:int,has_more:boolean>>"


def parsed(raw: DataFrame, column: str, schema: str) -> DataFrame:
    """raw with x, the JSON of a column; null where it can't be read."""
    return raw.withColumn("x", F.from_json(column, schema))


def _or(c: Column, default: str) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def _day(c: Column) -> Column:
    return F.coalesce(F.left(c, F.lit(10)), F.lit(""))


def series_feed_1(raw: DataFrame, base: str, column: str = "value") -> DataFrame:
    """Records of the first feed shape."""
    x = parsed(raw, column, SERIES_1).select("x.*")
    path = F.coalesce(F.nullif("public_url", F.lit("")), F.concat(F.lit("/comics/"), "slug"))
    url = F.when(path.startswith("http"), path).otherwise(F.concat(F.lit(base), path))
    capital = lambda c: F.concat(F.upper(F.left(c, F.lit(1))), F.substring(c, 2, 1 << 30))
    text = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce("description", F.lit("")), "<[^>]+>", " "), r"(?U)\s+", " "))
    none = F.array().cast("array<struct<number:string,published_at:string>>")
    chapters = F.transform(F.coalesce("latest_chapters", none), lambda c: F.struct(F.concat(F.lit("Chapter "), c["number"]).alias("title"), F.concat(url, F.lit("/chapter/"), c["number"]).alias("url"), _day(c["published_at"]).alias("date")))
    score = F.col("rating").try_cast("double")
    count = F.when(F.col("chapter_count") > 0, F.col("chapter_count")).otherwise(F.size(chapters))
    return x.select(
        F.coalesce("title", F.lit("")).alias("title"), _or(text, "No description available.").alias("description"), F.when(score != 0, F.format_string("%.1f", score)).otherwise("N/A").alias("rating"),
        capital(_or(F.col("status"), "Ongoing")).alias("status"), capital(_or(F.col("type"), "Manhwa")).alias("type"), F.coalesce(F.transform("genres", lambda g: g["name"]), F.array().cast("array<string>")).alias("genres"),
        chapters.alias("chapters"), count.cast("string").alias("chapter_count"), F.coalesce("cover", F.lit("")).alias("cover_url"), url.alias("url"), _or(F.col("author"), "Unknown").alias("author"), _or(F.col("artist"), "Unknown").alias("artist"),
    )


def series_feed_2(raw: DataFrame, base: str, column: str = "value") -> DataFrame:
    """Records of the second feed shape: free chapters, then paid ones, those with a slug; tags are names or objects with a name."""
    x = parsed(raw, column, SERIES_2).select("x.*")
    none = F.array().cast(CHAPTER_2)
    slug = F.coalesce("series_slug", F.lit(""))
    url = F.concat(F.lit(base), F.lit("/series/"), slug)
    listed = F.filter(F.concat(F.coalesce("free_chapters", none), F.coalesce("paid_chapters", none)), lambda c: c["chapter_slug"].isNotNull())
    label = lambda c: F.coalesce(F.nullif(F.concat_ws(" - ", F.nullif(c["chapter_name"], F.lit("")), F.nullif(c["chapter_title"], F.lit(""))), F.lit("")), c["chapter_slug"])
    chapters = F.transform(listed, lambda c: F.struct(label(c).alias("title"), F.concat(url, F.lit("/"), c["chapter_slug"]).alias("url"), _day(c["created_at"]).alias("date")))
    tags = F.filter(F.transform("tags", lambda t: F.when(t.startswith("{"), F.get_json_object(t, "$.name")).otherwise(t)), lambda t: t != "")
    count = F.when(F.col("meta.chapters_count") > 0, F.col("meta.chapters_count")).otherwise(F.size(chapters))
    return x.select(
        F.coalesce("title", F.lit("")).alias("title"), F.coalesce("description", F.lit("")).alias("description"), _or(F.col("rating"), "N/A").alias("rating"), _or(F.col("status"), "Unknown").alias("status"), F.lit("Manhwa").alias("type"),
        F.coalesce(tags, F.array().cast("array<string>")).alias("genres"), chapters.alias("chapters"), count.cast("string").alias("chapter_count"), F.coalesce("thumbnail", F.lit("")).alias("cover_url"), url.alias("url"), _or(F.col("author"), "Unknown").alias("author"), _or(F.col("artist"), "Unknown").alias("artist"),
    )


def stitch_pages(raw: DataFrame, base: str, column: str = "value", most: int = 12000) -> DataFrame:
    """slug, pos and the chapters of paged feeds by offset, up to the first page that is empty or the last; pages past `most` go."""
    x = parsed(raw, column, PAGE).select("x.slug", "x.offset", "x.data.chapters", F.coalesce("x.data.pagination.has_more", F.lit(False)).alias("more"))
    size = F.coalesce(F.nullif(F.size("chapters"), F.lit(-1)), F.lit(0))
    stops = F.min(F.when(~F.col("more") | (size == 0), F.col("offset"))).over(Window.partitionBy("slug"))
    kept = x.withColumn("stop", stops).filter((F.col("stop").isNull() | (F.col("offset") <= F.col("stop"))) & (F.col("offset") <= most))
    c = kept.select("slug", "offset", F.posexplode("chapters").alias("at", "c"))
    return c.select("slug", (F.col("offset") + F.col("at")).alias("pos"), F.col("c.chapter_name").alias("title"), F.concat(F.lit(base), F.lit("/manga/"), "slug", F.lit("/"), "c.chapter_slug").alias("url"), _day(F.col("c.updated_at")).alias("date"))


def chapter_feed_2(raw: DataFrame, base: str, request_slug: str, column: str = "value") -> DataFrame:
    """slug, title, url and date of a chapter feed's entries that have a slug of their own; the series' slug, else the one that was asked for."""
    item = "struct<chapter_slug:string,chapter_name:string,chapter_title:string,created_at:string,series:struct<series_slug:string>>"
    c = parsed(raw, column, f"data array<{item}>").select(F.explode("x.data").alias("c")).select("c.*").filter(F.coalesce("chapter_slug", F.lit("")) != "")
    label = F.concat_ws(" - ", F.nullif("chapter_name", F.lit("")), F.nullif("chapter_title", F.lit("")))
    slug = F.coalesce(F.nullif("series.series_slug", F.lit("")), F.lit(request_slug))
    title = F.coalesce(F.nullif(label, F.lit("")), F.col("chapter_slug"), F.lit("Chapter"))
    date = F.coalesce(F.date_format(F.try_to_timestamp("created_at"), "MMM d, yyyy"), F.lit(""))
    return c.select(slug.alias("slug"), title.alias("title"), F.concat(F.lit(base), F.lit("/series/"), slug, F.lit("/"), "chapter_slug").alias("url"), date.alias("date"))
