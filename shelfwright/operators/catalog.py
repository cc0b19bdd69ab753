"""Deduplication, listings, matching and reports over titles and records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ADULT_GENRES
from .matching import fuzzy_cluster, fuzzy_pairs, representatives, scan_leaders  # noqa: F401


def rating_number(rating: Column) -> Column:
    return rating.try_cast("double")


def of_genre(df: DataFrame, genre: str) -> DataFrame:
    """Titles of a genre, in any case; none of an adult genre, which isn't shown by name."""
    if genre.strip().lower() in ADULT_GENRES:
        return df.limit(0)
    return df.filter(F.exists("genres", lambda g: F.lower(g) == genre.strip().lower()))


def check_page(page: int, size: int, most: int = 660) -> None:
    if not 1 <= page <= most or not 1 <= size <= 60:
        raise ValueError(f"pages lie in 1 to {most}, sizes in 1 to 60")


def ordered(df: DataFrame, sort: str = "latest", legacy_string_order: bool = False) -> DataFrame:
    """df in one of the listings' orders; ties go by key and id. As text, "9.5" comes before "10"."""
    number = F.col("rating") if legacy_string_order else rating_number(F.col("rating"))
    count = F.col("chapter_count") if legacy_string_order else F.col("chapter_count").cast("int")
    recent = [F.desc("published_at"), F.desc("updated_at")]
    orders = {"latest": recent, "popular": [number.desc(), count.desc(), *recent], "rating": [number.desc(), *recent], "chapters": [count.desc(), *recent], "title": [F.asc("title")], "adult": [F.desc("updated_at"), number.desc()], "landing": [number.desc(), F.desc("updated_at")]}
    return df.orderBy(*orders[sort], "title_key", "id")


def listing(df: DataFrame, sort: str = "latest", *, genre: str | None = None, page: int = 1, size: int = 30, legacy_string_order: bool = False) -> DataFrame:
    """A page of titles; pages count from 1."""
    check_page(page, size)
    rows = ordered(df if genre is None else of_genre(df, genre), sort, legacy_string_order)
    return (rows.offset((page - 1) * size) if page > 1 else rows).limit(size)


def with_total(page_rows: DataFrame, all_rows: DataFrame, page: int, size: int) -> DataFrame:
    """page_rows with the total of all rows and whether more follow: one count, joined as a single row."""
    total = all_rows.agg(F.count("*").alias("total"))
    return page_rows.crossJoin(F.broadcast(total)).withColumn("has_more", F.lit(page * size) < F.col("total"))


def listing_page(df: DataFrame, sort: str = "latest", *, genre: str | None = None, page: int = 1, size: int = 30, legacy_string_order: bool = False) -> DataFrame:
    """A page of titles with total and has_more."""
    rows = df if genre is None else of_genre(df, genre)
    return with_total(listing(rows, sort, page=page, size=size, legacy_string_order=legacy_string_order), rows, page, size)


def first_of(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def least_of(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key whose order is least; combined before the shuffle, so that a frequent key fills no task."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_x")).select(*keys, "_x.*").select(*df.columns)


def dedupe_catalog(df: DataFrame) -> DataFrame:
    """One title for each key: the newest, then the largest count as text, then the smallest id; titles without a key stay."""
    keyed, rest = df.filter("title_key <> ''"), df.filter("title_key = '' or title_key is null")
    others = [c for c in df.columns if c != "title_key"]
    best = keyed.groupBy("title_key").agg(F.max_by(F.struct(*others), F.struct("updated_at", "chapter_count", -F.col("id"))).alias("_x")).select("title_key", "_x.*").select(*df.columns)
    return best.unionByName(rest)


def top_per(df: DataFrame, key: str, order: list, k: int) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter(F.col("_n") <= k).drop("_n")


def upsert(catalog: DataFrame, batch: DataFrame) -> DataFrame:
    """The merged snapshot of (title_key, rating, chapter_count, description, action): new keys are inserted; a rating
    that is not N/A and a longer description replace the stored ones, and the larger count stands."""
    b = first_of(batch.filter(F.length("title_key") >= 3), ["title_key"], [F.asc("id")]).select("title_key", F.col("rating").alias("b_rating"), F.col("chapter_count").alias("b_count"), F.col("description").alias("b_text"))
    m = catalog.join(b, "title_key", "full_outer")
    known, came = F.col("rating").isNotNull(), F.col("b_rating").isNotNull()
    rating = F.when(came & (~known | (F.col("b_rating") != "N/A")), F.col("b_rating")).otherwise(F.col("rating"))
    text = F.when(~known | (F.length("b_text") > F.length("description")), F.col("b_text")).otherwise(F.col("description"))
    return m.select("title_key", rating.alias("rating"), F.greatest("chapter_count", "b_count").alias("chapter_count"), text.alias("description"), F.when(~known, "insert").when(came, "update").otherwise("keep").alias("action"))


# What a valid entry's title does not hold.
NOT_ENTRIES = "manga lists|latest updates|home|search|scythe scans|demonic scans|page not found|404"


def valid_entry(df: DataFrame) -> DataFrame:
    return df.filter((F.length("title") >= 3) & ~F.lower("title").rlike(NOT_ENTRIES))


def browse(df: DataFrame, page: int = 1, size: int = 30, most: int = 17) -> DataFrame:
    """A page of the valid titles in order of id, one for each key, with has_more: whether any is left and pages go on."""
    check_page(page, size, most)
    first = least_of(valid_entry(df), ["title_key"], "id")
    rows = first.orderBy("id")
    shown = with_total((rows.offset((page - 1) * size) if page > 1 else rows).limit(size), first, page, size)
    return shown.withColumn("has_more", F.col("has_more") & F.lit(page < most)).drop("total")


def lookup_title(df: DataFrame, slug: str) -> DataFrame:
    """The title that a page's slug names: with that key first, else the first whose address holds the slug."""
    low = slug.lower()
    key = "".join(c for c in low if c in "abcdefghijklmnopqrstuvwxyz0123456789")
    hit = df.filter((F.col("title_key") == key) | F.lower("url").contains(low))
    return hit.orderBy((F.col("title_key") != key), "title_key", "id").limit(1)


#: What a record lacks for its detail page to be fetched, and how many of a batch are.
LACKS = {
    "cover": (lambda: F.coalesce("cover_url", F.lit("")) == "", 10),
    "facts": (lambda: (F.coalesce("cover_url", F.lit("")) != "") & F.coalesce("rating", F.lit("N/A")).isin("N/A", "") & (F.coalesce("description", F.lit("")) == ""), 15),
    "any": (lambda: (F.coalesce("description", F.lit("")) == "") | F.coalesce("rating", F.lit("N/A")).isin("N/A", ""), 10),
}


def needs_detail(df: DataFrame, rule: str) -> DataFrame:
    """The first records of each batch, in order of seq, that lack what the rule names."""
    lacks, cap = LACKS[rule]
    return top_per(df.filter(lacks()), "batch_id", [F.asc("seq")], cap)
