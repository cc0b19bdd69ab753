"""The stored catalog in buckets, and its indexes against the scans they stand in for."""

import datetime
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from shelfwright.functions import text as T
from shelfwright.operators import search as X
from shelfwright.operators.merge import SNAPSHOT, SNAPSHOT_SCHEMA, upsert_titles
from shelfwright.operators.store import Catalog, Postings, catalog_matches, indexed_contains, indexed_search, indexed_text_search
from shelfwright.sources.adapters import TITLE, titles
from shelfwright.sources.buckets import BucketedTable

SF = "/root/testdata/sf0.001"
NOW = datetime.datetime(2027, 1, 1, tzinfo=datetime.timezone.utc)
RECORD = SNAPSHOT_SCHEMA.split(", chapter_count")[0] + ", seq long"


def record(seq, title, description="", *genres):
    key = "".join(c for c in title.lower() if c in "abcdefghijklmnopqrstuvwxyz0123456789")
    return {"seq": seq, "title_key": key, "title": title, "description": description, "rating": "8", "genres": list(genres), "url": f"u/{key}", "source": "s", "chapters": []}


def files(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in Path(path).rglob("*.parquet")}


def test_a_change_writes_its_own_buckets(spark, tmp_path):
    t = BucketedTable(spark, str(tmp_path), ["k"], "k string, n long", 16)
    t.write(spark.range(2000).select(F.col("id").cast("string").alias("k"), F.col("id").alias("n")))
    before = files(tmp_path / "data")
    assert len(before) == 16
    two = [r["k"] for r in t.read([3, 11]).orderBy("k").limit(20).collect()]
    delta = spark.createDataFrame([(k, -1) for k in two] + [("new", -2)], "k string, n long")
    at = set(t.buckets_of(delta))
    merge = lambda old, d: old.join(d.select("k"), "k", "left_anti").unionByName(d)
    assert t.change(delta, merge, batch=7)
    wrote = files(tmp_path / "data").keys() - before.keys()
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in wrote} == at and len(wrote) == len(at) <= 3
    rows = {r["k"]: r["n"] for r in t.read().collect()}
    assert len(rows) == 2001 and rows["new"] == -2 and all(rows[k] == -1 for k in two)
    assert {r["n"] for r in t.lookup(delta, back=1).collect()} == {int(k) for k in two}
    now = files(tmp_path)
    assert not t.change(delta, merge, batch=7) and files(tmp_path) == now  # a batch that is run again
    assert t.change(delta.limit(0), merge, batch=8) and t.change(delta.limit(1), merge, batch=9)
    assert len(list((tmp_path / "manifest").iterdir())) == 2  # the newest and the one before
    named = {f.split("/data/")[1].split("/")[0] for back in (0, 1) for f in t.files(back=back)}
    assert named == {p.name for p in (tmp_path / "data").iterdir() if p.is_dir()}
    again = BucketedTable(spark, str(tmp_path), ["k"], "k string, n long", 99)
    assert again.buckets == 16 and again.read().count() == 2001


def test_a_writer_that_died_leaves_nothing_to_read(spark, tmp_path):
    t = BucketedTable(spark, str(tmp_path), ["k"], "k string", 2)
    assert t.version() == -1 and t.read().count() == 0 and t.of_values(["a"]).count() == 0
    t.write(spark.createDataFrame([("a",), (None,)], "k string"))
    t._put(spark.createDataFrame([("b",)], "k string"))  # without a manifest
    (tmp_path / "manifest" / "v=1").mkdir()
    assert sorted(r["k"] or "" for r in t.read().collect()) == ["", "a"]
    t.write(spark.createDataFrame([("c",)], "k string"))
    assert [r["k"] for r in t.read().collect()] == ["c"] and len(list((tmp_path / "data").iterdir())) <= 2


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    path, ident = str(tmp_path_factory.mktemp("indexed")), {"id": "long", "title_key": "string"}
    catalog = BucketedTable(spark, f"{path}/titles", ["title_key"], TITLE, 8)
    t = titles(spark, SF)
    catalog.write(t)
    words, grams = Postings(spark, f"{path}/words", "words", ident, 32), Postings(spark, f"{path}/grams", "grams", ident, 32)
    words.build(t)
    grams.build(t)
    return t, catalog, words, grams


@pytest.mark.parametrize("query", ["Red, widget!", "idge", "red", "zz none", "wi", "", "%_x", "PLATED"])
def test_indexes_give_what_scans_give(spark, indexed, query):
    t, catalog, words, grams = indexed
    best = lambda df: [tuple(r) for r in df.select("id", "score").collect()]
    assert best(indexed_text_search(words, query)) == best(X.text_search(t, query))
    held = indexed_contains(grams, catalog, query)
    assert {r["id"] for r in held.collect()} == {r["id"] for r in X.contains_any(t, query, ["title", "genres"]).collect()}
    assert best(indexed_search(words, grams, catalog, query)) == best(X.search(t, query))


def test_a_search_reads_few_files(indexed):
    _, _, words, _ = indexed
    found = words.table.of_values(["red", "widget"])
    read = {f.rsplit("/", 1)[0] for f in found.inputFiles()}
    assert 0 < len(read) <= 2 < len(words.table.files()) and "PushedFilters: [In(token" in found._jdf.queryExecution().toString()


def test_catalog_keeps_its_indexes_with_it(spark, tmp_path):
    c = Catalog(spark, str(tmp_path), 8)
    rng = random.Random(3)
    names = [f"{rng.choice(['Red', 'Blue', 'Iron'])} {rng.choice(['Tower', 'Garden', 'Lake'])} {k}" for k in range(40)]
    batches = [[record(k, n, "old words", "Action") for k, n in enumerate(names)], [record(0, names[3], "a much longer description of it", "Drama"), record(1, "Ab"), record(2, "Entirely new", "words", "Ecchi")], []]
    stored = spark.createDataFrame([], SNAPSHOT_SCHEMA)
    for number, rows in enumerate(batches):
        batch = spark.createDataFrame(rows, RECORD)
        c.upsert(batch, NOW, number)
        stored = spark.createDataFrame(upsert_titles(stored, batch, NOW).select(*SNAPSHOT).collect(), SNAPSHOT_SCHEMA)
    assert sorted(map(str, c.titles.read().collect())) == sorted(map(str, stored.collect()))
    for query in ("red tower", "longer", "old", "drama", "ntirel", "words"):
        named = stored.withColumn("id", F.col("title_key"))
        got = [tuple(r) for r in indexed_text_search(c.words, query).select("title_key", "score").collect()]
        assert got == [tuple(r) for r in X.text_search(named, query).collect()]
        assert [r["title_key"] for r in c.search(query).collect()] == [r["id"] for r in X.search(named, query).collect()]


def made_up(rng, n):
    stems = ["".join(rng.choice("abcdeouf") for _ in range(rng.choice([4, 6, 7, 9, 12, 20, 33, 50, 196, 260]))) for _ in range(25)]
    out = set()
    while len(out) < n:
        s = rng.choice(stems)
        for _ in range(rng.randint(0, max(1, len(s) // 4))):
            i, c = rng.randrange(len(s) + 1), rng.choice("abou")
            s = rng.choice([s[:i] + c + s[i:], s[:i] + s[i + 1 :], s[:i] + c + s[i + 1 :]])
        out.add(rng.choice([s, s + "".join(rng.choice("abc") for _ in range(rng.randint(0, 30))), rng.choice("ab") * rng.randint(0, len(s) // 4) + s, s[: len(s) * 3 // 4]]))
    return sorted(out)


def test_matches_equal_all_pairs(spark, tmp_path):
    rng = random.Random(5)
    keys = made_up(rng, 500)
    stored, came = spark.createDataFrame([(k,) for k in keys[::2]], "title_key string"), spark.createDataFrame([("b", i, k) for i, k in enumerate(keys[1::2])] + [("c", 900, "ab"), ("c", 901, None), ("c", 902, ""), ("b", 903, keys[1])], "batch_id string, seq long, title_key string")
    index = Postings(spark, str(tmp_path), "matches", {"title_key": "string"}, 4)
    index.build(stored)
    got = {tuple(r) for r in catalog_matches(came, index).collect()}
    pairs = stored.withColumnRenamed("title_key", "s").join(came.filter("length(title_key) >= 3 and seq < 903"), F.length("s") >= 3)
    want = {tuple(r) for r in pairs.filter(T.fuzzy_key_match(F.col("s"), F.col("title_key"))).select("batch_id", "seq", "s").collect()}
    assert got == want and len(want) > 200
    assert catalog_matches(came.limit(0), index).count() == 0


def test_matching_reads_the_index_alone(spark, tmp_path):
    c = Catalog(spark, str(tmp_path), 4)
    c.upsert(spark.createDataFrame([record(1, "Solo Leveling"), record(2, "Bungo Stray")], RECORD), NOW, 0)
    found = c.matching(spark.createDataFrame([("b", 1, "bungoustray"), ("b", 2, "sololevelingen")], "batch_id string, seq long, title_key string"))
    assert {(r["seq"], r["title_key"]) for r in found.collect()} == {(1, "bungostray"), (2, "sololeveling")}
    assert all("/matches/" in f or "/asked-" in f for f in found.inputFiles())  # not the titles
