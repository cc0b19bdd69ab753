"""The stored catalog: snapshots in buckets of their keys, and indexes that searches and matches read in place of it.

All indexes are tables of (token, ...) in buckets of the token, so a question reads the files of its own tokens
only, and a changed title rewrites the buckets of the tokens that it lost or won.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.buckets import BucketedTable
from ..sources.folders import written
from .matching import BEGINS, LONG, node_pairs, representatives
from .merge import SNAPSHOT, SNAPSHOT_SCHEMA, upsert_titles
from .search import WEIGHTS, contains_any


def _texts(df: DataFrame, c: str) -> Column:
    """A field's texts as an array: one, or those of an array; null as none."""
    one = not dict(df.dtypes)[c].startswith("array")
    return F.filter(F.array(c) if one else F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull())


def word_postings(df: DataFrame, ident: list[str]) -> DataFrame:
    """token, field, tf and the columns that name a title: how often each word stands in each field."""
    fields = [c for c in WEIGHTS if c in df.columns]
    words = lambda c: F.flatten(F.transform(_texts(df, c), lambda x: F.split(T.plain_words(x), " ")))
    entries = F.concat(*[_entries(words(c), c) for c in fields])
    return df.select(*ident, F.inline(entries)).filter("token <> ''").groupBy("token", "field", *ident).agg(F.count("*").alias("tf"))


def _entries(words: Column, field: str) -> Column:
    return F.transform(words, lambda w: F.struct(w.alias("token"), F.lit(field).alias("field")))


def gram_postings(df: DataFrame, ident: list[str]) -> DataFrame:
    """token and the columns that name a title: the runs of three characters of its fields, in lower case."""
    fields = [c for c in WEIGHTS if c in df.columns]

    def grams(text: Column) -> Column:
        low = F.lower(text)
        places = F.when(F.length(low) >= 3, F.sequence(F.lit(1), F.length(low) - 2)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.substring(low, i, F.lit(3)))

    found = F.array_distinct(F.flatten(F.transform(F.concat(*[_texts(df, c) for c in fields]), grams)))
    return df.select(*ident, F.explode(found).alias("token"))


class Postings:
    """An index of a table's words ("words") or runs of three characters ("grams"), by token; `ident` names a row of the table."""

    KINDS = {"words": (word_postings, "token string, field string, tf long"), "grams": (gram_postings, "token string")}

    def __init__(self, spark: SparkSession, path: str, kind: str, ident: dict[str, str], buckets: int = 256):
        self.make, columns = self.KINDS[kind]
        self.ident = list(ident)
        self.table = BucketedTable(spark, path, ["token"], f"{columns}, {', '.join(f'{c} {t}' for c, t in ident.items())}", buckets)

    def build(self, df: DataFrame) -> None:
        self.table.write(self.make(df, self.ident))

    def update(self, old: DataFrame, new: DataFrame, batch: int | None = None) -> bool:
        """Takes out what the rows `old` gave and puts in what `new` give; only their tokens' buckets are written."""
        gone, came = self.make(old, self.ident), self.make(new, self.ident)
        delta = gone.withColumn("_came", F.lit(False)).unionByName(came.withColumn("_came", F.lit(True)))
        named = ["token", *self.ident]

        def merge(stored: DataFrame, d: DataFrame) -> DataFrame:
            return stored.join(d.filter("not _came").select(*named).distinct(), named, "left_anti").unionByName(d.filter("_came").drop("_came"))

        return self.table.change(delta, merge, batch)


def indexed_text_search(words: Postings, query: str, n: int = 50) -> DataFrame:
    """What text_search gives, from the postings of the query's words: the n best by weight of field, with score."""
    asked = sorted(set(T._query_words(query)[0].split()))
    weight = F.create_map(*[F.lit(x) for pair in WEIGHTS.items() for x in pair])
    scored = words.table.of_values(asked).groupBy(*words.ident).agg(F.sum(F.element_at(weight, F.col("field")) * F.col("tf")).alias("score"))
    return scored.orderBy(F.desc("score"), "title_key", *[c for c in words.ident if c != "title_key"]).limit(n)


def indexed_contains(grams: Postings, catalog: BucketedTable, query: str, rarest: int = 3) -> DataFrame:
    """What contains_any gives over title, description and genres: rows of the catalog (in buckets of title_key) that hold the query literally, in any case.

    The query's rarest runs of three characters are intersected, and the titles that have them all are read and
    looked at. A query of under three characters has none, so the whole catalog is looked at.
    """
    fields = [c for c in WEIGHTS if c in catalog.schema.names]
    low = query.lower()
    asked = sorted({low[k : k + 3] for k in range(len(low) - 2)})
    if not asked:
        return contains_any(catalog.read(), query, fields)
    counts = {r["token"]: r["n"] for r in grams.table.of_values(asked).groupBy("token").agg(F.count("*").alias("n")).collect()}
    few = sorted(asked, key=lambda g: (counts.get(g, 0), g))[:rarest]
    if not all(g in counts for g in few):
        return catalog.read([])
    held = grams.table.of_values(few).groupBy(*grams.ident).agg(F.count("*").alias("n")).filter(F.col("n") == len(few))
    return contains_any(catalog.lookup(held), query, fields)


def indexed_search(words: Postings, grams: Postings, catalog: BucketedTable, query: str, n: int = 50, least: int = 3) -> DataFrame:
    """What search gives, from the indexes: only the files of the query's tokens and of the titles found are read."""
    found = indexed_text_search(words, query, n)
    rows = found.limit(least).count()
    if rows < least:
        found = indexed_contains(grams, catalog, query).orderBy("title_key", *[c for c in words.ident if c != "title_key"]).limit(n).select(*words.ident, F.lit(0).cast("long").alias("score"))
    shown = catalog.lookup(found).join(found, words.ident).filter(~T.is_adult(F.col("genres")))
    return shown.orderBy(F.desc("score"), "title_key", *[c for c in words.ident if c != "title_key"]).select(*words.ident, "score")


# --- matching a batch against the stored keys

#: Shares of edits of keys and of their other form, how much the lengths of keys so matched differ at most, and the share of a key that another one in it has at least.
EDITS, FORM_EDITS, LONGER, RATIO = 0.2, 0.15, 3, 0.7


def _token(kind: str, size: Column, i: Column, part: Column) -> Column:
    return F.concat_ws(":", F.lit(kind), size.cast("string"), i.cast("string"), part)


def _none() -> Column:
    return F.array().cast("array<string>")


def _places(low: Column, high: Column) -> Column:
    return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))


def _cut(m: Column, share: float) -> tuple[Column, Callable[[Column], Column]]:
    """A stored key of m characters has one segment more than the edits that the longest key it meets may need; where each begins."""
    d = F.greatest(F.lit(1), F.floor((m + LONGER) * share).cast("int")) + 1
    return d, lambda i: F.floor(i * m / d).cast("int")


def _segments(kind: str, k: Column, share: float) -> Column:
    """A stored key's segments."""
    m = F.length(k)
    d, start = _cut(m, share)
    tokens = F.transform(F.sequence(F.lit(0), d - 1), lambda i: _token(kind, m, i, F.substring(k, start(i) + 1, start(i + 1) - start(i))))
    return F.when(m > LONG, F.array(_token(f"long {kind}", m, F.lit(0), F.lit("")))).when(m >= 3, tokens).otherwise(_none())


def _segments_asked(kind: str, k: Column, share: float) -> Column:
    """What a key has where the segments of stored keys may stand that are few edits away.

    With e edits, one of the first e + 1 segments is untouched and has as many edits before it as its number i, and
    at most e - i behind it; so its place differs by s with |s| <= i and |difference of lengths - s| <= e - i.
    """
    n = F.length(k)

    def of_size(m: Column) -> Column:
        start = _cut(m, share)[1]
        e = F.greatest(F.lit(1), F.floor(F.greatest(m, n) * share).cast("int"))

        def of_segment(i: Column) -> Column:
            size = start(i + 1) - start(i)
            low = F.greatest(F.lit(0), start(i) + F.greatest(-i, n - m - e + i))
            high = F.least(n - size, start(i) + F.least(i, n - m + e - i))
            return F.transform(_places(low, high), lambda p: _token(kind, m, i, F.substring(k, p + 1, size)))

        return F.flatten(F.transform(F.sequence(F.lit(0), e), of_segment))

    few = F.flatten(F.transform(F.sequence(F.greatest(F.lit(3), n - LONGER), F.least(n + LONGER, F.lit(LONG))), of_size))
    lengths = F.transform(F.sequence(F.greatest(n - LONGER, F.lit(LONG + 1)), n + LONGER), lambda m: _token(f"long {kind}", m, F.lit(0), F.lit("")))
    return F.concat(F.when((n >= 3) & (n - LONGER <= LONG), few).otherwise(_none()), F.when(n + LONGER > LONG, lengths).otherwise(_none()))


def _middle(k: Column) -> Column:
    """A stored key's middle third, which every part of it has that is seven tenths long; of a long one what stands where such a part may begin."""
    m = F.length(k)
    parts = F.transform(F.sequence(F.lit(0), m - F.ceil(m * RATIO).cast("int")), lambda p: _token("inside", F.lit(BEGINS[-1]), F.lit(0), F.substring(k, p + 1, F.lit(BEGINS[-1]))))
    return F.when(m > LONG, parts).otherwise(F.array(_token("middle", m, F.lit(0), F.substring(k, F.floor(m / 3).cast("int") + 1, F.floor(2 * m / 3).cast("int") - F.floor(m / 3).cast("int")))))


def _middles_asked(k: Column) -> Column:
    """What a key has where the middle third of a longer one may stand that holds it."""
    n = F.length(k)

    def of_size(m: Column) -> Column:
        low, high = F.floor(m / 3).cast("int"), F.floor(2 * m / 3).cast("int")
        places = _places(F.greatest(F.lit(0), low - m + n), F.least(low, n - high + low))
        return F.transform(places, lambda p: _token("middle", m, F.lit(0), F.substring(k, p + 1, high - low)))

    few = F.flatten(F.transform(F.sequence(n, F.least(F.ceil(n / RATIO).cast("int"), F.lit(LONG))), of_size))
    begin = F.array(_token("inside", F.lit(BEGINS[-1]), F.lit(0), F.substring(k, F.lit(1), F.lit(BEGINS[-1]))))
    return F.concat(F.when(n <= LONG, few).otherwise(_none()), F.when(F.ceil(n / RATIO) > LONG, begin).otherwise(_none()))


def _sizes(k: Column) -> Column:
    return F.filter(F.array(*map(F.lit, BEGINS)), lambda s: s <= F.length(k))


def _begin(kind: str, k: Column, longest: bool) -> Column:
    """A key's begins, of all sizes in BEGINS that it has, or of the longest."""
    sizes = F.filter(_sizes(k), lambda s: s == F.array_max(_sizes(k))) if longest else _sizes(k)
    return F.transform(sizes, lambda s: _token(kind, s, F.lit(0), F.substring(k, F.lit(1), s)))


def _parts_asked(k: Column) -> Column:
    """What a key has where the longest begin of a shorter one may stand that lies in it."""
    n = F.length(k)
    least = F.ceil(n * RATIO).cast("int")

    def of_size(s: Column) -> Column:
        following = F.coalesce(F.array_min(F.filter(F.array(*map(F.lit, BEGINS)), lambda x: x > s)), F.lit(1 << 30))
        last = F.when(following > least, n - F.greatest(least, s)).otherwise(0)
        return F.transform(F.sequence(F.lit(0), last), lambda p: _token("shorter", s, F.lit(0), F.substring(k, p + 1, s)))

    return F.flatten(F.transform(_sizes(k), of_size))


def match_postings(df: DataFrame, ident: list[str]) -> DataFrame:
    """token, the romanized form and what names a title, of stored keys: tokens of the form, segments of both, the middle third and begins."""
    k, r = F.col("title_key"), F.col("_roman")
    tokens = F.concat(F.array(F.concat(F.lit("form:"), r)), _segments("key", k, EDITS), _segments("roman", r, FORM_EDITS), _middle(k), _begin("shorter", k, True), _begin("begin", k, False))
    return df.filter(F.length("title_key") >= 3).withColumn("_roman", T.roman_key(k)).select(*ident, F.col("_roman").alias("roman"), F.explode(F.array_distinct(tokens)).alias("token"))


Postings.KINDS["matches"] = (match_postings, "token string, roman string")


#: Keys from which on a batch may be large, and tokens that a key asks for, about.
LARGE, ASKED = 200, 800


def _matches_of_all(reps: DataFrame, matches: Postings) -> DataFrame:
    """catalog_matches of a batch that asks for more tokens than are stored: its keys and all stored ones, read from the index, are nodes whose pairs are found as those of records."""
    # a stored key has one token of its form
    stored = matches.table.read().filter(F.col("token").startswith("form:")).select(F.col("title_key").alias("k"), F.col("roman").alias("r"), F.lit(True).alias("stored"), F.lit(False).alias("came"))
    came = reps.select("k", F.col("_roman").alias("r"), F.lit(False).alias("stored"), F.lit(True).alias("came"))
    each = stored.union(came).groupBy("k", "r").agg(F.bool_or("stored").alias("stored"), F.bool_or("came").alias("came"))
    nodes = written(each.select(F.lit("all").alias("batch_id"), F.monotonically_increasing_id().alias("seq"), "k", "r", "stored", "came"), "nodes")
    of = nodes.filter("came").select("k", F.col("seq").alias("b"), "stored").hint("merge")
    named = written(reps.join(of, "k").select(F.col("batch_id").alias("batch"), F.col("seq").alias("rep"), "b", "k", "stored"), "named")
    pairs = node_pairs(nodes.filter("came"), "key", both=True)
    if not nodes.filter("NOT came").isEmpty():  # stored keys aren't paired among themselves
        pairs = pairs.union(node_pairs(nodes.withColumn("led", F.col("came")), "key", both=True))
    side = nodes.filter("stored").select(F.col("seq").alias("a"), F.col("k").alias("title_key")).hint("merge")
    apart = pairs.select("a", "b").join(named.select("b", "batch", "rep").hint("merge"), "b").join(side, "a").select("batch", "rep", "title_key")
    return apart.union(named.filter("stored").select("batch", "rep", F.col("k").alias("title_key"))).withColumnsRenamed({"batch": "batch_id", "rep": "seq"})


def catalog_matches(batch: DataFrame, matches: Postings) -> DataFrame:
    """batch_id, seq and title_key of the stored titles that a batch's representatives (batch_id, seq, title_key) match by key.

    The catalog isn't read, only the index files of the tokens that the batch asks for, and they meet these by
    equality; the rule then decides. A stored key gives a few tokens, the batch's key asks for all it might match,
    so a batch that would ask for more tokens than are stored meets all stored keys instead. Keys under three
    characters take no part.
    """
    k, r = F.col("k"), F.col("_roman")
    reps = representatives(batch).select("batch_id", "seq", F.col("title_key").alias("k")).withColumn("_roman", T.roman_key(k))
    keys = reps.select("k").distinct().count()
    if keys >= LARGE and keys * ASKED >= matches.table.read().count():
        return _matches_of_all(reps, matches)
    tokens = F.concat(F.array(F.concat(F.lit("form:"), r)), _segments_asked("key", k, EDITS), _segments_asked("roman", r, FORM_EDITS), _middles_asked(k), _parts_asked(k), _begin("begin", k, True))
    asked = written(reps.select("batch_id", "seq", "k", "_roman", F.explode(F.array_distinct(tokens)).alias("token")), "asked")
    met = asked.join(matches.table.read(matches.table.buckets_of(asked)), "token").select("batch_id", "seq", "k", "_roman", "title_key", "roman").distinct()
    return met.filter(T.key_match(F.col("title_key"), k, F.col("roman"), r)).select("batch_id", "seq", "title_key")


class Catalog:
    """The stored catalog with its indexes, each in its own folder under `path`."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 256):
        self.titles = BucketedTable(spark, f"{path}/titles", ["title_key"], SNAPSHOT_SCHEMA, buckets)
        name = {"title_key": "string"}
        self.words, self.grams, self.matches = (Postings(spark, f"{path}/{kind}", kind, name, buckets) for kind in ("words", "grams", "matches"))

    def titles_only(self, batch: DataFrame, now: datetime.datetime, number: int | None = None) -> bool:
        """Upserts a batch and leaves the indexes as they are, to be built anew."""
        return self.titles.change(batch.filter(F.length("title_key") >= 3), lambda stored, b: upsert_titles(stored, b, now).select(*SNAPSHOT), number)

    def upsert(self, batch: DataFrame, now: datetime.datetime, number: int | None = None) -> bool:
        """Upserts a batch: buckets of its keys are written anew, then those of the tokens that its titles lost and won.

        A numbered batch may be run again: each table leaves out what it has committed. The indexes follow the
        titles as they were before and are after the batch, which both stay until the next one.
        """
        keys = batch.filter(F.length("title_key") >= 3).select("title_key").distinct()
        put = self.titles_only(batch, now, number)
        old, new = self.titles.lookup(keys, back=1), self.titles.lookup(keys)
        for index in (self.words, self.grams, self.matches):
            index.update(old, new, number)
        return put

    def search(self, query: str, n: int = 50) -> DataFrame:
        return indexed_search(self.words, self.grams, self.titles, query, n)

    def matching(self, batch: DataFrame) -> DataFrame:
        return catalog_matches(batch, self.matches)
