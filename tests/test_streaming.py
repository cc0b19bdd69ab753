"""The streaming forms, fed by files: late rows, state between batches, merges that are run again."""

import datetime
import json
import os

import pytest
from pyspark.sql import functions as F

from shelfwright.operators.merge import SNAPSHOT, SNAPSHOT_SCHEMA
from shelfwright.operators.reports import write_request_log
from shelfwright.operators.store import Catalog
from shelfwright.sources.adapters import TITLE, read_catalog
from shelfwright.streaming import requests as S

LOG = "ip string, endpoint string, query string, status int, ts timestamp"


@pytest.fixture
def feed(spark, tmp_path):
    """write(name, rows) adds a file of JSON lines; stream(schema) reads them one file a batch."""

    class Feed:
        def __init__(self):
            self.folder, self.n = tmp_path / "in", 0
            self.folder.mkdir()

        def write(self, *rows):
            self.n += 1
            file = self.folder / f"{self.n:03}.json"
            file.write_text("\n".join(json.dumps(r) for r in rows))
            os.utime(file, (1_800_000_000 + self.n, 1_800_000_000 + self.n))  # files are taken by their time

        def stream(self, schema):
            return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").json(str(self.folder))

        def run(self, df, name, mode="append"):
            q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
            q.awaitTermination()
            return spark.table(name).collect()

    return Feed()


def at(minute, second=0):
    return f"2027-01-01T00:{minute:02}:{second:02}Z"


def row(minute, second=0, **more):
    return {"ip": "a", "endpoint": "/s", "query": "Q", "status": 200, "ts": at(minute, second)} | more


def test_windowed_counts_drop_what_is_too_late(feed):
    feed.write(row(0, 5), row(0, 8))
    feed.write(row(10))
    feed.write(row(10, 1))
    feed.write(row(0, 6))  # behind the watermark of 8 minutes, which holds from the batch after the next on
    feed.write(row(30))
    rows = feed.run(S.windowed_counts(feed.stream(LOG), slide="60 seconds"), "counts")
    assert sorted((r["window"]["start"].minute, r["requests"]) for r in rows) == [(0, 2), (10, 2)]


def test_collapse_and_errors(feed):
    feed.write(row(0, 0), row(0, 1, query=" q "), row(0, 2, query="other", status=500))
    feed.write(row(5, 0, query="x"))
    feed.write(row(6, 0, query="y"))
    feed.write(row(9, 0))  # the first q is forgotten by now
    assert sorted(r["query_key"] for r in feed.run(S.collapse_duplicates(feed.stream(LOG)), "collapsed")) == ["other", "q", "q", "x", "y"]
    assert [r["query"] for r in feed.run(S.errors_only(feed.stream(LOG)), "errors")] == ["other"]


def test_blocks(spark, feed, tmp_path):
    other = tmp_path / "blocks"
    other.mkdir()
    (other / "1.json").write_text(json.dumps({"ip": "a", "ts": at(10)}))
    feed.write(row(9), row(10, 30), row(40), row(40, ip="b"))
    blocks = spark.readStream.schema("ip string, ts timestamp").json(str(other))
    rows = feed.run(S.apply_blocks(feed.stream(LOG), blocks, hold="1800 seconds", late="2 hours"), "blocked")
    assert [(r["ip"], r["ts"].minute) for r in rows] == [("a", 10), ("a", 40)]


def test_streaks_go_on_between_batches(feed):
    page = lambda n, items, more=True: {"source": "s", "page": n, "items": items, "more": more}
    feed.write(page(1, 4), page(2, 0), page(3, 0))
    feed.write(page(4, 0), page(6, 0), page(5, 0))
    feed.write(page(7, 3), page(8, 0, False))
    rows = feed.run(S.empty_streaks(feed.stream("source string, page long, items long, more boolean")), "streaks")
    assert [(r["page"], r["streak"], r["dead"]) for r in sorted(rows, key=lambda r: r["page"])] == [(1, 0, False), (2, 1, False), (3, 2, False), (4, 3, False), (5, 4, False), (6, 5, True), (7, 0, False), (8, 1, True)]


def test_query_sessions_equal_the_batch(spark, feed):
    from shelfwright.operators.requests import query_frequency

    rows = [row(m, s, query=q) for m, s, q in ((0, 0, "a"), (0, 30, " A"), (1, 0, "b"), (1, 10, "a"), (9, 0, "a"), (9, 5, "b"))]
    for part in (rows[1:2], rows[:1], rows[2:4], rows[4:]):
        feed.write(*part)
    feed.write(row(59, query="end"))
    feed.write(row(59, 1, query="end"))
    got = {(r["query"], r["hits"], r["first_ts"], r["last_ts"]) for r in feed.run(S.query_sessions(feed.stream(LOG), "3 minutes"), "sessions")}
    batch = query_frequency(spark.read.schema(LOG).json(str(feed.folder)), "3 minutes").filter("query <> 'end'")
    assert got == {tuple(r[c] for c in ("query", "hits", "first_ts", "last_ts")) for r in batch.collect()} and len(got) == 4


REQUEST = "request long, ip string, endpoint string, ts timestamp"


def test_rate_limits_equal_the_batch(spark, feed):
    import random

    from shelfwright.operators.requests import rate_limit_audit

    rng = random.Random(8)
    rows = [{"request": k, "ip": rng.choice("ab"), "endpoint": rng.choice(["/s", "/t"]), "ts": at(k // 6, rng.randrange(60))} for k in range(120)]
    for k in range(0, 120, 20):
        part = rows[k : k + 20]
        rng.shuffle(part)
        feed.write(*part[:10])
        feed.write(*part[10:])
    feed.write({"request": 900, "ip": "z", "endpoint": "/", "ts": at(50)})
    feed.write({"request": 901, "ip": "z", "endpoint": "/", "ts": at(59)})
    got = {(r["request"], r["in_window"], r["limited"]) for r in feed.run(S.rate_limits(feed.stream(REQUEST), 3, 60, "5 minutes"), "limits") if r["request"] < 900}
    batch = rate_limit_audit(spark.read.schema(REQUEST).json(str(feed.folder)).filter("request < 900"), 3, 60)
    assert got == {(r["request"], r["in_window"], r["limited"]) for r in batch.collect()} and len(got) == 120 and any(x[2] for x in got)


def test_streaks_in_any_order_of_files(spark, feed):
    import random

    from shelfwright.operators.requests import empty_streaks

    rng = random.Random(9)
    pages = [{"source": s, "page": n, "items": rng.choice([0, 0, 3]), "more": n < 30, "ts": at(n // 2, 30 * (n % 2))} for s in "st" for n in range(1, 31)]
    rng.shuffle(pages)
    for k in range(0, 60, 9):
        feed.write(*pages[k : k + 9])
    feed.write({"source": "z", "page": 1, "items": 1, "more": True, "ts": at(58)})
    feed.write({"source": "z", "page": 2, "items": 1, "more": True, "ts": at(59)})
    schema = "source string, page long, items long, more boolean, ts timestamp"
    got = {(r["source"], r["page"], r["streak"]) for r in feed.run(S.ordered_streaks(feed.stream(schema), late="20 minutes"), "ordered") if r["source"] != "z"}
    batch = empty_streaks(spark.read.schema(schema).json(str(feed.folder)).filter("source <> 'z'"))
    assert got == {(r["source"], r["page"], r["streak"]) for r in batch.collect()} and len(got) == 60


def test_sync_stream_is_repeatable(spark, feed, tmp_path):
    now = datetime.datetime(2027, 1, 1, tzinfo=datetime.timezone.utc)
    schema = "seq long, title_key string, title string, description string, rating string, status string, type string, genres array<string>, author string, artist string, cover_url string, url string, source string, chapters array<struct<title:string,url:string,date:string>>"
    chapter = lambda n: {"title": f"Chapter {n}", "url": f"/c-{n}", "date": "2027-01-01"}
    record = lambda key, rating, *n: {"seq": 1, "title_key": key, "title": key, "description": "", "rating": rating, "genres": ["x"], "url": "u", "source": "s", "chapters": [chapter(k) for k in n]}
    catalog = Catalog(spark, str(tmp_path / "catalog"), 4)
    feed.write(record("one", "N/A", 1, 2))
    feed.write(record("one", "7.5", 2, 3), record("two", "9", 1))
    merge = S.catalog_merge(catalog, now)
    S.run_sync_stream(feed.stream(schema), merge, str(tmp_path / "sync")).awaitTermination()
    before = [x.table.version() for x in (catalog.words, catalog.grams, catalog.matches)]
    merge(spark.read.schema(schema).json(str(feed.folder / "002.json")), 1)  # as after a failure
    last = catalog.titles.read()
    assert last.columns == SNAPSHOT and [x.table.version() for x in (catalog.words, catalog.grams, catalog.matches)] == before
    assert sorted((r["title_key"], r["rating"], r["chapter_count"]) for r in last.collect()) == [("one", "7.5", "3"), ("two", "9", "1")]


def test_request_log_and_catalog(spark, tmp_path):
    log = spark.createDataFrame([("/a", 200, ""), ("/b", 404, ""), ("/c", 200, "down")], "endpoint string, status int, error string")
    write_request_log(log, str(tmp_path / "log"))
    assert {(r["endpoint"], r["level"]) for r in spark.read.json(str(tmp_path / "log")).collect()} == {("/a", "info"), ("/b", "warn"), ("/c", "warn")}
    rows = [(1, "Red", "red", "7", "s", ["x"], "1", None, None, "u/red"), (2, "Blue", "blue", "N/A", "t", [], "0", None, None, "u/blue")]
    spark.createDataFrame(rows, TITLE).write.parquet(str(tmp_path / "titles"))
    found = read_catalog(spark, str(tmp_path / "titles"), ["id", "title"], {"source": "t"}, {"url": "blue$"})
    assert found.collect() == [(2, "Blue")] and "PushedFilters: [IsNotNull(source)" in found._jdf.queryExecution().toString()


def test_search_and_merge(spark):
    from shelfwright.operators.search import search_and_merge

    schema = "seq long, title_key string, title string, description string, rating string, status string, type string, genres array<string>, author string, artist string, cover_url string, url string, source string, chapters array<struct<title:string,url:string,date:string>>"
    record = lambda seq, title: (seq, "".join(c for c in title.lower() if c.isalnum()), title, "", "8", "", "", ["<b>x</b>"], "", "", "", "javascript:x", "s", [])
    rows = [record(1, "The Red Tower Saga"), record(2, "Red Tower"), record(3, "the red tower sagaa"), record(4, "Blue Lake"), record(5, "Latest updates red tower")]
    catalog = spark.createDataFrame([], SNAPSHOT_SCHEMA)
    now = datetime.datetime(2027, 1, 1, tzinfo=datetime.timezone.utc)
    got = search_and_merge(catalog, spark.createDataFrame(rows, schema), "red tower", now).collect()
    assert {(r["title"], r["url"], tuple(r["genres"]), r["action"]) for r in got} == {("Red Tower", "", ("x",), "insert")}


def test_search_dedupe_equals_a_sequential_scan(spark):
    from shelfwright.operators.catalog import fuzzy_pairs
    from shelfwright.operators.search import dedupe_search
    from shelfwright.sources.adapters import records

    r = records(spark, "/root/testdata/sf0.001")
    pairs = {(x["a"], x["b"]) for x in fuzzy_pairs(r, "search").collect()}
    kept = []
    for x in sorted((x["seq"], x["batch_id"]) for x in r.filter(F.length("title_key") >= 3).collect()):
        if not any((a, x[0]) in pairs for a, batch in kept if batch == x[1]):
            kept.append(x)
    got = {(x["seq"], x["batch_id"]) for x in dedupe_search(r, [F.asc("seq")]).collect()}
    assert got == set(kept) and len(kept) < r.count()
