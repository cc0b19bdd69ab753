"""Functions and merges against golden rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from shelfwright.functions import chapters as H
from shelfwright.functions import pages as U
from shelfwright.functions import queries as S
from shelfwright.operators import chapters as D
from shelfwright.operators import enrich as N
from shelfwright.operators import merge as M
from shelfwright.plans.pages import extract_images
from shelfwright.sources import feeds, registry

NOW = datetime.datetime(2027, 1, 1, tzinfo=datetime.timezone.utc)
LABELS = [
    ("Chapter 5 2027-06-13", "Chapter 5", "2027-06-13"), ("Chapter 5 06/13/2027", "Chapter 5", "06/13/2027"), ("Chapter 5 Jun 13, 2027", "Chapter 5", "Jun 13, 2027"), ("Chapter 5 3 day ago", "Chapter 5", "3 day ago"),
    ("Chapter 5 3 days ago", "Chapter 5 3 days ago", ""), ("Chapter 5 3d", "Chapter 5", "3d"), ("Chapter 7 yesterday", "Chapter 7", "yesterday"), ("2027-06-13", "2027-06-13", ""), (None, "", ""),
]


def values(spark, f, rows, schema="a string"):
    """f over the rows' columns, in their order."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r["v"] for r in df.select("i", f(*[F.col(c) for c in df.columns[1:]]).alias("v")).orderBy("i").collect()]


def test_labels(spark):
    assert [tuple(x) for x in values(spark, H.split_label_date, [(x,) for x, _, _ in LABELS])] == [(t, d) for _, t, d in LABELS]
    assert values(spark, H.chapter_key, [("Ch. 10.5", ""), ("Ep 3", None), ("Some  End", ""), ("x", "/chapter-7")], "a string, b string") == ["n:10.5", "n:3", "u:some end", "n:7"]
    assert values(spark, H.chapter_number, [("Read First", ""), ("Vol 3", ""), ("none", None), ("x", "/v?episode_no=4")], "a string, b string") == ["1", "3", None, "4"]


def test_page_functions(spark):
    assert values(spark, U.fix_title, [("What'S  God'S",), ("don't",), (None,)]) == ["What's God's", "don't", None]
    assert values(spark, lambda u: U.is_private_host(U.host_of(u)), [("http://127.0.0.1/x",), ("https://[::1]:8/",), ("https://a.example.org/",)]) == [True, True, False]
    assert values(spark, U.strip_label, [("The story summary: it  begins",)]) == ["it begins"]
    assert values(spark, U.alt_titles, [("Alternative: One; Two, x\nno",), ("none",)]) == [["One", "Two"], []]
    assert values(spark, lambda a: U.strip_role(a, "Author"), [("Ann (Author)",), ("Updating",)]) == ["Ann", "Unknown"]
    assert values(spark, S.clean_query, [("éa<b>\0 ",), (None,)]) == ["éab", None]
    assert values(spark, lambda a: S.reject_reason(a, S.clean_query(a)), [(" ",), ("x'",), ("a -- b",), ("one punch",)]) == ["required", "too short", "invalid", None]


def test_display_order(spark):
    labels = ["none", "Chapter 1", "Chapter 2.1", "Chapter 3", "Chapter 2.2", "Read first", "Chapter 3 x", "gone"]
    rows = [(1, k, t, "" if t == "gone" else f"u{k}", "") for k, t in enumerate(labels)]
    got = D.dedupe_chapters_for_display(spark.createDataFrame(rows, "title_id int, pos int, label string, url string, date string")).orderBy("place").collect()
    assert [r["label"] for r in got] == ["Chapter 3 x", "Chapter 2.1", "Chapter 2.2", "Chapter 1", "none"]


def record(seq, key, **more):
    base = {"title": key, "description": "", "rating": "N/A", "status": "Ongoing", "type": "t", "genres": [], "author": "a", "artist": "b", "cover_url": "", "url": "u", "source": "s", "chapters": []}
    return (seq, key, *(base | more).values())


RECORD = "seq long, title_key string, title string, description string, rating string, status string, type string, genres array<string>, author string, artist string, cover_url string, url string, source string, chapters array<struct<title:string,url:string,date:string>>"


def test_upsert_and_refresh(spark):
    batch = lambda *rows: spark.createDataFrame(list(rows), RECORD)
    catalog = spark.createDataFrame([], "title_key string, " + RECORD.split("title_key string, ")[1] + f", chapter_count string, sources {M.SOURCES}, published_at string, created_at timestamp, updated_at timestamp")
    one = M.upsert_titles(catalog, batch(record(1, "abc", chapters=[("Ch 1", "x", "2026-01-01"), ("Chapter 1", "y", "")]), record(2, "abc", rating="9"), record(3, "ab")), NOW)
    first = one.collect()
    assert [(r["title_key"], r["description"], r["chapter_count"], r["published_at"], r["action"]) for r in first] == [("abc", M.NO_TEXT, "1", "2026-01-01", "insert")]
    later = batch(record(1, "abc", rating="8", status="Unknown", genres=["g"], source="z", description="x" * 40, cover_url="cover", chapters=[("Ch 1", "q", ""), ("Ch 2", "q", "")]))
    (r,) = M.upsert_titles(one.drop("action"), later, NOW).collect()
    assert (r["rating"], r["status"], r["genres"], r["description"], r["cover_url"], r["chapter_count"], r["action"]) == ("8", "Ongoing", ["g"], "x" * 40, "cover", "2", "update")
    assert [s["name"] for s in r["sources"]] == ["s", "z"] and r["published_at"] == "2026-01-01"
    (again,) = M.upsert_titles(M.upsert_titles(one.drop("action"), later, NOW).drop("action"), later, NOW).collect()
    assert again == r
    (f,) = M.refresh_titles(one.drop("action"), later.unionByName(batch(record(9, "new"))), NOW).collect()
    assert (f["refreshed"], f["chapter_count"], len(f["sources"])) == (True, "2", 1)
    assert [x["title_key"] for x in M.append_new(one, batch(record(1, "abc"), record(2, "new"), record(3, "new"))).collect()] == ["new"]
    (kept,) = M.upsert_titles(one.drop("action"), batch(), NOW).collect()
    assert kept["action"] == "keep" and kept["updated_at"] == first[0]["updated_at"]


def test_feeds(spark):
    raw = lambda *x: spark.createDataFrame([(t,) for t in x], "value string")
    a, b = feeds.series_feed_1(raw('{"title":"T","slug":"t","rating":"9","status":"ongoing","description":"<p>a</p> b","genres":[{"name":"G"}],"latest_chapters":[{"number":2.5,"published_at":"2026-01-02T00"}]}', "no json"), "https://x").collect()
    assert (a["rating"], a["status"], a["type"], a["description"], a["genres"], a["chapter_count"], a["url"]) == ("9.0", "Ongoing", "Manhwa", "a b", ["G"], "1", "https://x/comics/t")
    assert tuple(a["chapters"][0]) == ("Chapter 2.5", "https://x/comics/t/chapter/2.5", "2026-01-02") and b["rating"] == "N/A"
    (c,) = feeds.series_feed_2(raw('{"title":"T","series_slug":"t","tags":["A",{"name":"B"}],"free_chapters":[{"chapter_name":"C","chapter_title":"D","chapter_slug":"s"},{"chapter_name":"x"}],"paid_chapters":[{"chapter_slug":"p"}]}'), "https://x").collect()
    assert c["genres"] == ["A", "B"] and [x["title"] for x in c["chapters"]] == ["C - D", "p"] and c["chapter_count"] == "2"
    page = lambda at, names, more: '{"slug":"t","offset":%d,"data":{"chapters":[%s],"pagination":{"has_more":%s}}}' % (at, ",".join('{"chapter_name":"%s","chapter_slug":"%s"}' % (n, n) for n in names), more)  # noqa: E731, UP031
    got = feeds.stitch_pages(raw(page(0, "ab", "true"), page(2, "c", "false"), page(3, "d", "true")), "https://x").orderBy("pos").collect()
    assert [r["title"] for r in got] == ["a", "b", "c"]


def test_images(spark):
    one = '<main><img src="https://h/1.jpg"><img data-src="https://h/2.png" src="x"><img src="https://h/1.jpg"><img src="https://h/3.webp"></main><img src="https://h/4.jpg">'
    two = '<img src="https://h/logo.png"><img width="90" src="https://h/5.jpg"><img width="900" src="https://h/6.jpg">'
    got = dict(extract_images(spark.createDataFrame([(1, one), (2, two), (3, None)], "page_id int, html string")).collect())
    assert got == {1: ["https://h/1.jpg", "https://h/2.png", "https://h/3.webp"], 2: ["https://h/6.jpg"], 3: None}


def test_rules_and_sources(spark):
    rules = spark.createDataFrame([("/api/search",), ("/api",)], "route_key string")
    got = dict(N.match_rule(spark.createDataFrame([("/api/search/x",), ("/api/y",), ("/z",)], "path string"), rules).collect())
    assert got == {"/api/search/x": "/api/search", "/api/y": "/api", "/z": None}
    registry.register_source("One", lambda s: s.createDataFrame([(1, "a")], "seq int, title string"))
    registry.register_source("two", lambda s: s.createDataFrame([(1, "b", "r")], "seq int, title string, rating string"))
    assert [(r["source_no"], r["title"], r["rating"]) for r in registry.union_sources(spark, ["two", "ONE"]).orderBy("source_no").collect()] == [(0, "b", "r"), (1, "a", None)]
    assert registry.source_named("three") is None
    with pytest.raises(ValueError):
        registry.union_sources(spark, [])


def test_page_details_and_cards(spark):
    from shelfwright.plans.pages import link_cards, page_details

    html = """<html><head><title>Red &amp; Blue | Site</title><meta property="og:description" content="meta text"></head><body><h1>Red &amp; Blue – Site</h1>
    <script>completed</script><p>short</p><p>A <b>paragraph</b> that is   long enough to be the description of it.</p><span class="num rating">8.7</span> Status : hiatus, a manga series
    <a class=x title="By title" href="/t/one?x=1">text</a><a href='/t/two'><img alt="By  alt" src=i></a><a href="/t/one">again</a><a href="/t/three"><b>By</b> text</a><a href="/t/four">Popular ones</a><a href="/other">other</a></body></html>"""
    pages = spark.createDataFrame([(1, html), (2, None), (3, "<title>Only</title><meta name='description' content='x'>")], "page_id long, html string")
    rows = {r["page_id"]: tuple(r)[1:] for r in page_details(pages).collect()}
    assert rows[1] == ("Red & Blue", "A paragraph that is long enough to be the description of it.", "8.7", "hiatus", "Manga")
    assert rows[3] == ("Only", "x", "N/A", "Ongoing", "Manhwa")
    cards = link_cards(pages, "https://x.example", "^/t/", 3).orderBy("pos").collect()
    assert [(r["url"], r["title"]) for r in cards] == [("https://x.example/t/one", "By title"), ("https://x.example/t/two", "By alt"), ("https://x.example/t/three", "By text")]


def test_output_functions(spark):
    from shelfwright.functions import text as T
    from shelfwright.operators.catalog import of_genre

    assert values(spark, T.proxy_url, [("",), ("/api/x/y",), ("rel/path.png",), ("https://a.b/c d+(e)'!*~",), (None,)]) == ["", "/api/x/y", "rel/path.png", "/api/img?url=https%3A%2F%2Fa.b%2Fc%20d%2B(e)'!*~", ""]
    assert values(spark, T.split_genres, [(["ActionFantasy", " sci fi", "Action", ""],), (["DRAMARomance"],)], "a array<string>") == [["Action", "Fantasy", "Sci-Fi"], ["DRAMARomance"]]
    assert values(spark, T.source_name, [("Source G",), ("other",), ("",), (None,)]) == ["Omega Scans", "other", "Unknown", "Unknown"]
    assert values(spark, T.clean_text, [("a\0<b>&amp;lt;</b> &nbsp;x ",), (None,)]) == ["a<  x", None]
    assert values(spark, T.clean_url, [(" JavaScript:x",), ("data:text/x",), ("data:image/png",), ("a'b",)]) == ["", "", "data:image/png", "ab"]
    assert values(spark, T.title_from_url, [("https://x/en/drama/the-red_one/list?title_no=1",), ("none",)]) == ["The Red_one", ""]
    assert values(spark, T.is_adult_loose, [(["SM_bdsm"], "x"), (["ok"], "Omega x"), (None, None), (["smutty"], "x")], "a array<string>, b string") == [True, True, False, False]
    assert values(spark, lambda t: T.is_nav_label(t), [("Latest",), ("Spoiler",), ("New Moon",), ("Newton",)]) == [True, True, True, False]
    titles = spark.createDataFrame([(["Smut", "Drama"],)], "genres array<string>")
    assert of_genre(titles, " SMUT").count() == 0 and of_genre(titles, "drama").count() == 1


PHRASES = ["manga lists", "latest updates", "popular", "home", "search", "scythe scans", "demonic scans"]
NO_ENTRY = ["manga lists", "latest updates", "home", "search", "scythe scans", "demonic scans", "page not found", "404"]


def test_denied_phrases(spark):
    from shelfwright.functions import text as T
    from shelfwright.operators import catalog as C

    titles = [f"Red tower {p}" for p in PHRASES] + ["Red tower", "Red tower page not found"]
    assert values(spark, lambda t: T.is_relevant(t, "red tower"), [(t,) for t in titles]) == [False] * 7 + [True, True]
    rows = spark.createDataFrame([(f"A {p.title()} x",) for p in NO_ENTRY] + [("Popular",), ("ab",), ("abc",)], "title string")
    assert sorted(r["title"] for r in C.valid_entry(rows).collect()) == ["Popular", "abc"]


def test_slugs_and_grades(spark):
    from shelfwright.functions import text as T

    urls = ["https://omegascans.org/series/one/chapter-2", "https://www.omegascans.org/x/two", "https://omegascans.org/series", "https://a.example/series/one/last/?q=1", "no url", None]
    assert values(spark, U.source_slug, [(u,) for u in urls]) == ["one", "two", "", "last", "", ""]
    assert values(spark, T.parse_grade, [("grade 9.75 of",), ("9.5.1",), ("..",), ("10.01",), (".5",), (None,)]) == ["9.75", "9.5.1", "N/A", "N/A", ".5", "N/A"]


def test_frequent_queries_bound_the_counts(spark):
    from shelfwright.operators.requests import frequent_by_hour, frequent_queries

    log = spark.read.parquet("/root/testdata/sf0.01/events.parquet").select("ts", F.concat_ws(" ", F.col("user_id").cast("string"), "event_type").alias("query")).cache()
    for kept in (1, 5, 40, 100_000):
        summary = frequent_by_hour(log, kept)
        for since, until in (("1970-01-01", "9999-01-01"), *[tuple(r) for r in log.selectExpr("date_trunc('day', min(ts)) a", "date_trunc('day', min(ts)) + interval 3 day b").collect()]):
            span = log.filter((F.col("ts") >= F.lit(since)) & (F.col("ts") < F.lit(until)))
            exact = {r["query"]: r["n"] for r in span.groupBy("query").agg(F.count("*").alias("n")).collect()}
            found = {r["query"]: (r["hits"], r["error"]) for r in frequent_queries(summary, since, until, kept).collect()}
            error = max(e for _, e in found.values())
            assert all(hits <= exact[q] <= hits + e for q, (hits, e) in found.items())
            assert all(n <= error for q, n in exact.items() if q not in found) and error * (kept + 1) <= sum(exact.values()) and len(found) <= kept
    assert frequent_queries(frequent_by_hour(log.limit(0)), "2000-01-01", "2001-01-01").count() == 0
