"""The search path: text search, ranking, deduplication of results, and merging what was found."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.folders import written
from .matching import in_order, leaders, nodes_of
from .merge import upsert_titles

#: What a query's word in a field adds to a title's score.
WEIGHTS = {"title": 10, "genres": 4, "description": 1}


def contains_any(df: DataFrame, query: str, columns: list[str]) -> DataFrame:
    """Rows with the query, taken literally and in any case, in one of the columns (texts or arrays of texts)."""
    low, kinds = query.lower(), dict(df.dtypes)
    hit = F.lit(False)
    for c in columns:
        inside = lambda x: F.lower(x).contains(low)
        hit = hit | F.coalesce(F.exists(c, inside) if kinds[c].startswith("array") else inside(F.col(c)), F.lit(False))
    return df.filter(hit)


def text_search(df: DataFrame, query: str, n: int = 50) -> DataFrame:
    """id and score of the n best titles: each of the query's words counts by its weight for each time that it stands in a field.

    Only words are exploded, by ids; rows of one title are summed before the shuffle.
    """
    words = sorted(set(T._query_words(query)[0].split()))
    tokens = lambda text: F.split(T.plain_words(text), " ")
    kinds = dict(df.dtypes)
    parts = []
    for c, weight in WEIGHTS.items():
        if c in kinds:
            found = F.flatten(F.transform(c, tokens)) if kinds[c].startswith("array") else tokens(F.col(c))
            parts.append(F.size(F.filter(F.coalesce(found, F.array().cast("array<string>")), lambda w: w.isin(*words))) * weight)
    score = sum(parts[1:], parts[0])
    return df.select("id", "title_key", score.cast("long").alias("score")).filter("score > 0").orderBy(F.desc("score"), "title_key", "id").limit(n).select("id", "score")


def search(df: DataFrame, query: str, n: int = 50, least: int = 3) -> DataFrame:
    """id, rank of what a query shows: the n best by text; with fewer than `least`, n that hold the query literally. Adult titles go after that.

    The results of the text search, n at most, are written once and counted.
    """
    found = written(text_search(df, query, n), "found")
    if found.count() < least:
        held = contains_any(df, query, [c for c in ("title", "description", "genres") if c in df.columns])
        found = held.orderBy("title_key", "id").limit(n).select("id", F.lit(0).cast("long").alias("score"))
    shown = found.join(df.select("id", "title_key", "genres"), "id").filter(~T.is_adult(F.col("genres")))
    return shown.orderBy(F.desc("score"), "title_key", "id").select("id", "score")


def ranked(df: DataFrame, query: str) -> DataFrame:
    """The relevant records of df(seq, title, description) with score, the best first, in order of seq among equals."""
    relevant = df.filter(T.is_relevant(F.col("title"), query))
    return relevant.withColumn("score", T.relevance_score(F.col("title"), F.coalesce("description", F.lit("")), query).cast("int")).orderBy(F.desc("score"), "seq")


def dedupe_search(results: DataFrame, order: list[Column]) -> DataFrame:
    """results(batch_id, seq, title, title_key, ...) but for those that repeat one kept before, taken in the given order within a batch; keys under three characters go.

    Of equal titles the first stands for all: where it is kept the others repeat it, else they repeat what it does.
    """
    rest = results.filter(F.length("title_key") >= 3)
    placed = in_order(rest.withColumn("_row", F.struct("*")), ["batch_id", *order])
    kept = leaders(nodes_of(placed, "search"), "search")
    return placed.join(kept, "seq", "left_semi").select("_row.*")


def clean_record(df: DataFrame) -> DataFrame:
    """Records whose texts are free of markup and whose addresses are safe, also in genres and chapters."""
    kinds = dict(df.dtypes)
    put = {c: T.clean_text(F.col(c)) for c in ("title", "description", "author", "artist") if c in kinds} | {c: T.clean_url(F.col(c)) for c in ("cover_url", "url") if c in kinds}
    if "genres" in kinds:
        put["genres"] = F.transform("genres", T.clean_text)
    if "chapters" in kinds:
        put["chapters"] = F.transform("chapters", lambda c: F.struct(T.clean_text(c["title"]).alias("title"), T.clean_url(c["url"]).alias("url"), T.clean_text(c["date"]).alias("date")))
    return df.withColumns(put)


def search_and_merge(catalog: DataFrame, records: DataFrame, query: str, now: datetime.datetime) -> DataFrame:
    """The snapshot with the relevant records of a query, the best of each group of repeats, cleaned and upserted."""
    found = ranked(records, query).withColumn("batch_id", F.lit(query))
    first = dedupe_search(found, [F.desc("score"), F.asc("seq")]).drop("batch_id", "score")
    return upsert_titles(catalog, clean_record(first), now)
