"""The registered queries of the catalog operators and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as T
from .operators import catalog as C
from .operators import output as O
from .operators import reports as S
from .operators import requests as R
from .operators import search as X
from .plans import pages as P
from .sources.adapters import RECORDS_SQL, TITLES_SQL, read, records, request_log, titles

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
Q = "red widget"


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


SHOWN = "id, title, rating, chapter_count, published_at"


def _page(spark: SparkSession, sf_dir: str, **settings) -> DataFrame:
    return C.listing(titles(spark, sf_dir), **settings).select(*SHOWN.split(", "))


def _page_sql(order: str, where: str = "true", limit: str = "LIMIT 30") -> str:
    return f"WITH {TITLES_SQL} SELECT {SHOWN} FROM titles WHERE {where} ORDER BY {order}, title_key, id {limit}"


_RECENT, _NUMBER = "published_at DESC NULLS LAST, updated_at DESC NULLS LAST", "TRY_CAST(rating AS DOUBLE) DESC NULLS LAST"


@query(_page_sql(f"{_NUMBER}, CAST(chapter_count AS INTEGER) DESC, {_RECENT}"))
def listing_popular(spark, sf_dir):
    return _page(spark, sf_dir, sort="popular")


@query(_page_sql(f"rating DESC, chapter_count DESC, {_RECENT}"))
def listing_popular_text_order(spark, sf_dir):
    return _page(spark, sf_dir, sort="popular", legacy_string_order=True)


@query(_page_sql(_RECENT, limit="LIMIT 30 OFFSET 30"))
def listing_latest_second_page(spark, sf_dir):
    return _page(spark, sf_dir, sort="latest", page=2)


@query(_page_sql(f"{_NUMBER}, {_RECENT}"))
def listing_rating(spark, sf_dir):
    return _page(spark, sf_dir, sort="rating")


@query(_page_sql(f"CAST(chapter_count AS INTEGER) DESC, {_RECENT}"))
def listing_chapters(spark, sf_dir):
    return _page(spark, sf_dir, sort="chapters")


@query(_page_sql("title"))
def listing_title(spark, sf_dir):
    return _page(spark, sf_dir, sort="title")


@query(_page_sql(_RECENT, "list_contains([lower(x) FOR x IN genres], 'widget')"))
def listing_by_genre(spark, sf_dir):
    return _page(spark, sf_dir, genre="Widget")


@query(f"WITH {TITLES_SQL} SELECT source, count(*) AS n FROM titles WHERE len([x FOR x IN genres IF lower(x) IN {T.ADULT_GENRES}]) = 0 GROUP BY 1")
def non_adult_by_source(spark, sf_dir):
    return titles(spark, sf_dir).filter(~T.is_adult(F.col("genres"))).groupBy("source").agg(F.count("*").alias("n"))


@query(f"""WITH {RECORDS_SQL} SELECT seq, title_key,
  trim(regexp_replace(regexp_replace(regexp_replace(title, '!\\[[^\\]]*\\]\\([^)]*\\)', '', 'g'), '\\[[^\\]]*\\]\\([^)]*\\)', '', 'g'), '\\s+', ' ', 'g')) AS bare,
  substr(sha256(title), 1, 8) AS qh, regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
  CASE WHEN lower(description) LIKE '%completed%' THEN 'Completed' WHEN lower(description) LIKE '%hiatus%' THEN 'Hiatus' ELSE 'Ongoing' END AS status
  FROM records""")
def title_functions(spark, sf_dir):
    t = F.col("title")
    return records(spark, sf_dir).select("seq", "title_key", T.strip_markdown(t).alias("bare"), T.query_hash(t).alias("qh"), T.slugify(t).alias("slug"), T.detect_status(F.col("description")).alias("status"))


_ROMAN = "lower(title)"
for _a, _b in ((r"\s*\([^)]*\)\s*", " "), (r"\s*\[[^\]]*\]\s*", " "), ("ou", "o"), ("uu", "u"), ("ou", "o"), ("aa", "a"), ("ee", "e"), ("oo", "o")):
    _ROMAN = f"regexp_replace({_ROMAN}, '{_a}', '{_b}', 'g')"
_ROMAN = f"regexp_replace({_ROMAN}, '[:\\-–—]\\s+.*$', '')"
for _a, _b in ((r"\s+for\s+the\s+", " "), (r"\s+to\s+", " "), (r"[^a-z0-9\s]", ""), (r"\s+", " ")):
    _ROMAN = f"regexp_replace({_ROMAN}, '{_a}', '{_b}', 'g')"


@query(f"WITH {RECORDS_SQL} SELECT seq, trim({_ROMAN}) AS roman FROM records")
def romanized_titles(spark, sf_dir):
    return records(spark, sf_dir).select("seq", T.romanize(F.col("title")).alias("roman"))


@query("""WITH r AS (SELECT event_id, regexp_extract(props, '(\\d+\\.?\\d*)', 1) AS n FROM events)
SELECT event_id, CASE WHEN TRY_CAST(n AS DOUBLE) <= 10 THEN n ELSE 'N/A' END AS rating FROM r""")
def parsed_ratings(spark, sf_dir):
    return read(spark, sf_dir, "events", "event_id", "props").select("event_id", T.parse_rating(F.col("props")).alias("rating"))


@query("""WITH r AS (SELECT page_id, regexp_extract(html, '([0-9.]+)', 1) AS run FROM pages), n AS (SELECT *, TRY_CAST(nullif(regexp_extract(run, '^([0-9]+[.]?[0-9]*|[.][0-9]+)', 1), '') AS DOUBLE) AS n FROM r)
SELECT page_id, CASE WHEN n <= 10 THEN run ELSE 'N/A' END AS grade FROM n""")
def parsed_grades(spark, sf_dir):
    return read(spark, sf_dir, "pages", "page_id", "html").select("page_id", T.parse_grade(F.col("html")).alias("grade"))


@query(f"WITH {RECORDS_SQL} SELECT title_key, min(seq) AS seq FROM records WHERE length(title_key) >= 3 GROUP BY 1")
def dedupe_exact(spark, sf_dir):
    return C.first_of(records(spark, sf_dir).filter(F.length("title_key") >= 3), ["title_key"], [F.asc("seq")]).select("title_key", "seq")


@query(f"""WITH {TITLES_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY title_key ORDER BY updated_at DESC NULLS LAST, chapter_count DESC NULLS LAST, id) AS k FROM titles WHERE title_key <> '')
SELECT id, title_key FROM n WHERE k = 1 UNION ALL SELECT id, title_key FROM titles WHERE coalesce(title_key, '') = ''""")
def dedupe_catalog(spark, sf_dir):
    return C.dedupe_catalog(titles(spark, sf_dir)).select("id", "title_key")


@query(f"WITH {TITLES_SQL} SELECT title_key, count(*) AS n, min(id) AS first_id FROM titles GROUP BY 1 HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return S.duplicate_keys(titles(spark, sf_dir))


@query("SELECT s_name AS source, count(DISTINCT l_partkey) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1")
def source_counts(spark, sf_dir):
    links, suppliers = read(spark, sf_dir, "lineitem", "l_partkey", "l_suppkey"), read(spark, sf_dir, "supplier", "s_suppkey", "s_name").withColumnRenamed("s_suppkey", "l_suppkey")
    return S.source_counts(links, suppliers, "l_partkey", "l_suppkey", "s_name")


@query(f"WITH {RECORDS_SQL}, n AS (SELECT batch_id, seq, row_number() OVER (PARTITION BY batch_id ORDER BY seq) AS k FROM records) SELECT batch_id, seq FROM n WHERE k <= 8")
def top_per_source(spark, sf_dir):
    return C.top_per(records(spark, sf_dir), "batch_id", [F.asc("seq")], 8).select("batch_id", "seq")


@query(f"WITH {TITLES_SQL} SELECT id, title, updated_at FROM titles WHERE url <> '' ORDER BY updated_at NULLS FIRST, id LIMIT 30")
def pick_stale(spark, sf_dir):
    return S.pick_stale(titles(spark, sf_dir)).select("id", "title", "updated_at")


@query("SELECT p_brand AS source, count(*) AS items, sum(CASE WHEN p_size % 7 = 0 THEN 1 ELSE 0 END) AS inserted, sum(CASE WHEN p_size % 7 = 0 THEN 0 ELSE 1 END) AS updated FROM part GROUP BY ROLLUP (p_brand)")
def sync_report(spark, sf_dir):
    fresh = (F.col("p_size") % 7 == 0).cast("int")
    return S.sync_report(read(spark, sf_dir, "part", "p_brand", "p_size").select(F.col("p_brand").alias("source"), F.lit(1).alias("items"), fresh.alias("inserted"), (1 - fresh).alias("updated")))


@query("""WITH c AS (SELECT DISTINCT l_orderkey AS title, l_linenumber AS number FROM lineitem)
SELECT title, number, lag(number) OVER w AS previous, lead(number) OVER w AS next FROM c WINDOW w AS (PARTITION BY title ORDER BY number)""")
def chapter_neighbors(spark, sf_dir):
    c = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber").select(F.col("l_orderkey").alias("title"), F.col("l_linenumber").alias("number"))
    return S.neighbors(c, "title", "number")


@query("""WITH n AS (SELECT l_partkey AS title, l_linenumber AS number, l_shipdate, row_number() OVER (PARTITION BY l_partkey, l_linenumber ORDER BY l_shipdate DESC, l_orderkey) AS k, l_orderkey FROM lineitem)
SELECT title, number, l_orderkey FROM n WHERE k = 1""")
def dedupe_chapters(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem", "l_partkey", "l_linenumber", "l_shipdate", "l_orderkey").withColumnsRenamed({"l_partkey": "title", "l_linenumber": "number"})
    return C.first_of(lines, ["title", "number"], [F.desc("l_shipdate"), F.asc("l_orderkey")]).select("title", "number", "l_orderkey")


_SCORED = f"""WITH {TITLES_SQL} SELECT id, CAST((CASE WHEN title = '{Q}' THEN 1000 ELSE 0 END) + (CASE WHEN contains(title, '{Q}') THEN 300 ELSE 0 END) + (CASE WHEN contains('{Q}', title) AND length(title) > 8 THEN 120 ELSE 0 END)
  + 25 * ((CASE WHEN contains(title, 'red') THEN 1 ELSE 0 END) + (CASE WHEN contains(title, 'widget') THEN 1 ELSE 0 END)) AS INTEGER) AS score
  FROM titles WHERE contains(title, 'red') OR contains(title, 'widget')"""


@query(_SCORED)
def relevance(spark, sf_dir):
    t = titles(spark, sf_dir)
    return t.filter(T.is_relevant(F.col("title"), Q)).select("id", T.relevance_score(F.col("title"), F.lit(""), Q).cast("int").alias("score"))


@query(f"""WITH {TITLES_SQL}, tok AS (SELECT id, title_key, unnest(string_split(title, ' ')) AS t, 10 AS weight FROM titles UNION ALL SELECT id, title_key, lower(unnest(list_distinct(genres))), 4 FROM titles)
SELECT id, sum(weight) AS score FROM tok WHERE t IN ('red', 'widget') GROUP BY id, title_key ORDER BY score DESC, title_key, id LIMIT 50""")
def text_search(spark, sf_dir):
    return X.text_search(titles(spark, sf_dir), Q)


@query(f"WITH {RECORDS_SQL} SELECT seq FROM records WHERE contains(lower(title), 'the') OR contains(lower(description), 'the')")
def contains_any(spark, sf_dir):
    return X.contains_any(records(spark, sf_dir), "the", ["title", "description"]).select("seq")


def _edits(a: str, b: str, share: float) -> str:
    return f"levenshtein({a}, {b}) <= greatest(1, floor(greatest(length({a}), length({b})) * {share}))"


_R = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({k}, 'ou', 'o', 'g'), 'uu', 'u', 'g'), 'ou', 'o', 'g'), 'aa', 'a', 'g'), 'ee', 'e', 'g'), 'oo', 'o', 'g')"
_PAIRS = f"""WITH {RECORDS_SQL}, k AS (SELECT batch_id, min(seq) AS seq, title_key AS k, {_R.format(k="title_key")} AS r FROM records WHERE length(title_key) >= 3 GROUP BY batch_id, title_key)
SELECT x.batch_id, x.seq AS a, y.seq AS b FROM k x JOIN k y ON x.batch_id = y.batch_id AND x.seq < y.seq AND (
  x.k = y.k OR x.r = y.r OR (abs(length(x.r) - length(y.r)) <= 3 AND length(x.r) > 3 AND {_edits("x.r", "y.r", 0.15)})
  OR (length(x.k) > 6 AND length(y.k) > 6 AND (starts_with(x.k, y.k) OR starts_with(y.k, x.k) OR ((contains(x.k, y.k) OR contains(y.k, x.k)) AND least(length(x.k), length(y.k)) / greatest(length(x.k), length(y.k)) >= 0.7)))
  OR (abs(length(x.k) - length(y.k)) <= 3 AND length(x.k) > 5 AND {_edits("x.k", "y.k", 0.2)}))"""


@query(_PAIRS)
def fuzzy_pairs(spark, sf_dir):
    return C.fuzzy_pairs(records(spark, sf_dir))


@query(None)
def fuzzy_cluster(spark, sf_dir):
    r = records(spark, sf_dir)
    return C.fuzzy_cluster(r, C.fuzzy_pairs(r))


@query(f"""WITH {TITLES_SQL}, cat AS (SELECT title_key, rating, CAST(chapter_count AS INTEGER) AS chapter_count, title AS description FROM titles WHERE id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY title_key ORDER BY id) = 1),
b AS (SELECT title_key, rating, CAST(chapter_count AS INTEGER) AS chapter_count, url AS description FROM titles WHERE id % 2 = 1 AND length(title_key) >= 3 QUALIFY row_number() OVER (PARTITION BY title_key ORDER BY id) = 1)
SELECT coalesce(cat.title_key, b.title_key) AS title_key, CASE WHEN b.rating IS NOT NULL AND (cat.rating IS NULL OR b.rating <> 'N/A') THEN b.rating ELSE cat.rating END AS rating,
  greatest(cat.chapter_count, b.chapter_count) AS chapter_count, CASE WHEN cat.rating IS NULL OR length(b.description) > length(cat.description) THEN b.description ELSE cat.description END AS description,
  CASE WHEN cat.rating IS NULL THEN 'insert' WHEN b.rating IS NOT NULL THEN 'update' ELSE 'keep' END AS action
FROM cat FULL OUTER JOIN b ON cat.title_key = b.title_key""")
def upsert(spark, sf_dir):
    t = titles(spark, sf_dir).withColumn("chapter_count", F.col("chapter_count").cast("int"))
    stored = C.first_of(t.filter("id % 2 = 0"), ["title_key"], [F.asc("id")]).select("title_key", "rating", "chapter_count", F.col("title").alias("description"))
    return C.upsert(stored, t.filter("id % 2 = 1").withColumn("description", F.col("url")))


@query("""WITH c AS (SELECT DISTINCT lower(regexp_extract(url, '^https?://([a-z0-9.-]+)', 1)) AS slug, page_id % 3 = 0 AS held FROM pages)
SELECT DISTINCT slug FROM c WHERE slug <> '' AND slug NOT IN (SELECT slug FROM c WHERE held)""")
def find_missing(spark, sf_dir):
    p = read(spark, sf_dir, "pages", "page_id", "url")
    return S.find_missing(p, p.filter("page_id % 3 = 0"), "^https?://([a-z0-9.-]+)")


@query("""WITH l AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"?]*)[^"]*">([^<]*)</a>', 1) AS h, regexp_extract_all(html, '<a href="([^"?]*)[^"]*">([^<]*)</a>', 2) AS n FROM pages),
u AS (SELECT page_id, unnest(h) AS href, trim(unnest(n)) AS name, unnest(range(len(h))) AS pos FROM l)
SELECT page_id, href, CAST(min(pos) AS INTEGER) AS pos, arg_min(name, pos) AS name FROM u WHERE length(name) >= 2 GROUP BY 1, 2""")
def extract_links(spark, sf_dir):
    return P.extract_links(read(spark, sf_dir, "pages", "page_id", "html"))


@query("""SELECT page_id, coalesce(nullif(regexp_extract(html, '<h1>([^<]*)</h1>', 1), ''), regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title,
  greatest(1, coalesce(TRY_CAST(regexp_extract(url, '[?&]page=(\\d+)', 1) AS INTEGER), 1)) AS page FROM pages""")
def page_meta(spark, sf_dir):
    return P.page_meta(read(spark, sf_dir, "pages", "page_id", "url", "html"))


@query("""SELECT event_id, count(*) OVER w AS in_window, count(*) OVER w > 3 AS limited FROM events
WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts RANGE BETWEEN INTERVAL 6 HOURS PRECEDING AND CURRENT ROW)""")
def rate_limit_audit(spark, sf_dir):
    return R.rate_limit_audit(request_log(spark, sf_dir), 3, 6 * 3600).select("event_id", "in_window", "limited")


@query("""WITH c AS (SELECT user_id AS source, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS page, CASE WHEN event_type = 'error' THEN 0 ELSE 1 END AS items FROM events),
g AS (SELECT *, sum(items) OVER (PARTITION BY source ORDER BY page) AS run FROM c), s AS (SELECT source, page, sum(1 - items) OVER (PARTITION BY source, run ORDER BY page) AS streak FROM g)
SELECT source, page, CAST(streak AS BIGINT) AS streak, streak >= 5 AS dead, CAST(CASE WHEN streak > 0 THEN least(120, 15 * streak) ELSE 4 END AS BIGINT) AS delay FROM s""")
def empty_streaks(spark, sf_dir):
    e = read(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type")
    page = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    crawl = e.select(F.col("user_id").alias("source"), page.alias("page"), F.when(F.col("event_type") == "error", 0).otherwise(1).alias("items"))
    return R.empty_streaks(crawl).select("source", "page", "streak", "dead", F.col("delay").cast("long").alias("delay"))


@query("""WITH g AS (SELECT user_id || ':' || event_type AS query, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts) >= INTERVAL 12 HOURS THEN 1 ELSE 0 END AS fresh FROM events),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY query ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g) SELECT query, count(*) AS hits, min(ts) AS first_ts, max(ts) AS last_ts FROM s GROUP BY query, n""")
def query_frequency(spark, sf_dir):
    log = read(spark, sf_dir, "events", "ts", "user_id", "event_type").select("ts", F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("query"))
    return R.query_frequency(log, "12 hours")


_HOUR_CUT = """WITH c AS (SELECT date_trunc('hour', ts) AS hour, lower(trim(user_id || ' ' || event_type)) AS query, count(*) AS hits FROM events GROUP BY 1, 2),
n AS (SELECT *, row_number() OVER (PARTITION BY hour ORDER BY hits DESC, query) AS n FROM c), x AS (SELECT hour, max(hits) FILTER (WHERE n = 4) AS next FROM n GROUP BY 1),
h AS (SELECT hour, query, hits - coalesce(next, 0) AS hits, coalesce(next, 0) AS error FROM n JOIN x USING (hour) WHERE n <= 3 AND (hits > coalesce(next, 0) OR n = 1))"""


def _asked(spark, sf_dir):
    return read(spark, sf_dir, "events", "ts", "user_id", "event_type").select("ts", F.concat_ws(" ", F.col("user_id").cast("string"), F.upper("event_type")).alias("query"))


@query(f"{_HOUR_CUT} SELECT hour, query, CAST(hits AS BIGINT) AS hits, CAST(error AS BIGINT) AS error FROM h")
def frequent_by_hour(spark, sf_dir):
    return R.frequent_by_hour(_asked(spark, sf_dir), 3).withColumn("hour", F.col("hour").cast("timestamp"))


@query(f"""{_HOUR_CUT}, e AS (SELECT sum(error) AS error FROM (SELECT hour, max(error) AS error FROM h GROUP BY 1)), s AS (SELECT query, sum(hits) AS hits FROM h GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY hits DESC, query) AS n FROM s), y AS (SELECT coalesce(max(hits) FILTER (WHERE n = 51), 0) AS next FROM r)
SELECT query, CAST(hits - next AS BIGINT) AS hits, CAST(error + next AS BIGINT) AS error FROM r, e, y WHERE n <= 50 AND (hits > next OR n = 1)""")
def frequent_queries(spark, sf_dir):
    """The summaries of all hours, merged."""
    return R.frequent_queries(R.frequent_by_hour(_asked(spark, sf_dir), 3), "1970-01-01", "9999-01-01", 50)


@query("SELECT event_type AS query, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, query LIMIT 3")
def top_queries(spark, sf_dir):
    return S.top_queries(read(spark, sf_dir, "events", "event_type").withColumnRenamed("event_type", "query"), 3)


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'warn' ELSE 'info' END AS level FROM events")
def request_levels(spark, sf_dir):
    return S.with_level(request_log(spark, sf_dir)).select("event_id", "level")


@query(f"""WITH {TITLES_SQL}, g AS (SELECT DISTINCT unnest(genres) AS genre FROM titles) SELECT genre FROM g WHERE lower(genre) NOT IN {T.ADULT_GENRES}""")
def facets(spark, sf_dir):
    return O.facets(titles(spark, sf_dir))


_NEW = ", ".join(f"({k + 1}, {rank + 1})" for k, rank in enumerate(O._newly_released(30)[:12]))


@query(f"""WITH {TITLES_SQL}, t AS (SELECT id, list_contains([lower(g) FOR g IN genres], 'widget') AS fits, row_number() OVER (ORDER BY {_NUMBER}, updated_at DESC NULLS LAST, title_key, id) AS rank FROM titles QUALIFY rank <= 30),
u AS (SELECT *, count(*) OVER () AS n, sum(CAST(fits AS INTEGER)) OVER () AS n_fits, sum(CAST(fits AS INTEGER)) OVER (ORDER BY rank) AS nth FROM t), new(place, rank) AS (VALUES {_NEW})
SELECT id, 'trending' AS shelf, CAST(rank AS INTEGER) AS place FROM u WHERE rank <= 12 UNION ALL SELECT id, 'daily', CAST(rank AS INTEGER) FROM u WHERE rank <= 12
UNION ALL SELECT id, 'popular', CAST(CASE WHEN n >= 24 THEN rank - 12 ELSE rank END AS INTEGER) FROM u WHERE CASE WHEN n >= 24 THEN rank BETWEEN 13 AND 24 ELSE rank <= 12 END
UNION ALL SELECT id, 'genre', CAST(CASE WHEN n_fits >= 6 THEN nth ELSE rank END AS INTEGER) FROM u WHERE CASE WHEN n_fits >= 6 THEN fits ELSE rank <= 12 END
UNION ALL SELECT id, 'newly released', new.place FROM u JOIN new ON u.rank = new.rank""")
def shelves(spark, sf_dir):
    return O.shelves(titles(spark, sf_dir), "Widget")


@query(f"WITH {TITLES_SQL}, e AS (SELECT p_brand AS source, count(*) + 5 AS expected FROM part GROUP BY 1) SELECT e.source, expected, greatest(0, expected - count(t.id)) AS missing FROM e LEFT JOIN titles t ON t.source = e.source AND t.id % 2 = 0 GROUP BY 1, 2")
def coverage(spark, sf_dir):
    t = titles(spark, sf_dir)
    return S.coverage(t.groupBy("source").agg((F.count("*") + 5).alias("expected")), t.filter("id % 2 = 0"))