"""The registered queries of the stored catalog and its indexes, and their DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .catalog_queries import ORACLES, Q, _edits, _R, query
from .detail_queries import _BATCHES, _COUNT, NOW, _batches
from .operators.store import Catalog, Postings, indexed_contains, indexed_search, indexed_text_search
from .operators.store import catalog_matches as matches_of
from .search_queries import _TEXT
from .sources.adapters import RECORDS_SQL, TITLE, TITLES_SQL, records, titles
from .sources.buckets import BucketedTable
from .sources.folders import checkpoint_folder

IDENT = {"id": "long", "title_key": "string"}


def _folder(spark, name: str) -> str:
    return f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _indexed(spark, sf_dir, *kinds: str, buckets: int = 16):
    """The titles in buckets of their keys, and indexes of them."""
    path, t = _folder(spark, "indexed"), titles(spark, sf_dir)
    catalog = BucketedTable(spark, f"{path}/titles", ["title_key"], TITLE, buckets)
    catalog.write(t)
    found = [Postings(spark, f"{path}/{kind}", kind, IDENT, buckets) for kind in kinds]
    for index in found:
        index.build(catalog.read())
    return [catalog, *found]


@query(ORACLES["text_search"].replace("sum(weight)", "CAST(sum(weight) AS BIGINT)"))
def text_search_by_postings(spark, sf_dir):
    _, words = _indexed(spark, sf_dir, "words")
    return indexed_text_search(words, Q).select("id", "score")


@query(f"WITH {TITLES_SQL} SELECT id, title FROM titles WHERE contains(lower(title), 'idge') OR len([g FOR g IN genres IF contains(lower(g), 'idge')]) > 0")
def contains_by_grams(spark, sf_dir):
    catalog, grams = _indexed(spark, sf_dir, "grams")
    return indexed_contains(grams, catalog, "IDGE").select("id", "title")


@query(_TEXT.format(words="'red', 'widget'", query="red widget"))
def search_by_indexes(spark, sf_dir):
    catalog, words, grams = _indexed(spark, sf_dir, "words", "grams")
    return indexed_search(words, grams, catalog, "Red, widget!").select("id", "score")


@query(_TEXT.format(words="'ed wid'", query="ed wid"))
def search_by_indexes_literally(spark, sf_dir):
    catalog, words, grams = _indexed(spark, sf_dir, "words", "grams")
    return indexed_search(words, grams, catalog, "ed wid").select("id", "score")


@query(f"""WITH {_BATCHES} SELECT title_key, rating, description, {_COUNT}, CASE WHEN action = 'update' AND old_source <> new_source THEN 2 ELSE 1 END AS n_sources,
  CASE WHEN action = 'insert' THEN new_published ELSE old_published END AS published_at FROM j""")
def upsert_stored(spark, sf_dir):
    """The batch upserted into the stored catalog, which is read again."""
    stored, batch = _batches(spark, sf_dir)
    catalog = Catalog(spark, _folder(spark, "catalog"), 16)
    catalog.titles.write(stored)
    catalog.titles_only(batch, NOW)
    return catalog.titles.read().select("title_key", "rating", "description", "chapter_count", F.size("sources").alias("n_sources"), "published_at")


@query(f"""WITH {RECORDS_SQL}, y AS (SELECT batch_id, min(seq) AS seq, title_key AS k, {_R.format(k="title_key")} AS r FROM records WHERE length(title_key) >= 3 GROUP BY batch_id, title_key), x AS (SELECT DISTINCT k, r FROM y)
SELECT y.batch_id, y.seq, x.k AS title_key FROM x JOIN y ON (
  x.k = y.k OR x.r = y.r OR (abs(length(x.r) - length(y.r)) <= 3 AND length(x.r) > 3 AND {_edits("x.r", "y.r", 0.15)})
  OR (length(x.k) > 6 AND length(y.k) > 6 AND (starts_with(x.k, y.k) OR starts_with(y.k, x.k) OR ((contains(x.k, y.k) OR contains(y.k, x.k)) AND least(length(x.k), length(y.k)) / greatest(length(x.k), length(y.k)) >= 0.7)))
  OR (abs(length(x.k) - length(y.k)) <= 3 AND length(x.k) > 5 AND {_edits("x.k", "y.k", 0.2)}))""")
def catalog_matches(spark, sf_dir):
    """All records as batches against a stored catalog of all their keys."""
    r = records(spark, sf_dir)
    index = Postings(spark, _folder(spark, "matches"), "matches", {"title_key": "string"}, 16)
    index.build(r.select("title_key").distinct())
    return matches_of(r, index)
