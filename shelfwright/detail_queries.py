"""The registered queries of chapters, enrichment, urls and blocks, and their DuckDB SQL."""

from __future__ import annotations

import datetime

from pyspark.sql import Window
from pyspark.sql import functions as F

from .catalog_queries import query
from .functions import chapters as H
from .functions import pages as U
from .functions import queries as S
from .operators import catalog as C
from .operators import chapters as D
from .operators import enrich as N
from .operators import merge as M
from .operators import reports as P
from .sources import feeds
from .sources.adapters import CHAPTERS_SQL, TITLES_SQL, chapters, read, records, request_log, titles


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _found(text: str, pattern: str) -> str:
    return f"nullif(regexp_extract({text}, {_sql(pattern)}, 1), '')"


_TEXT = r"trim(regexp_replace(regexp_replace(lower(label), '[^a-z0-9\s.:-]', ' ', 'g'), '\s+', ' ', 'g'))"
_FIRST = f"regexp_matches({_TEXT}, '{H.FIRST_LABELS}')"
_NUMBER = f"coalesce({_found(_TEXT, H.LABEL_NUMBER)}, {', '.join(_found('lower(url)', p) for p in H.URL_NUMBERS)}, CASE WHEN {_FIRST} THEN '1' END, {_found(_TEXT, r'\b([\d.]+)\b')})"
_QUALITY = f"""((CASE WHEN trim(url) <> '' THEN 1 ELSE 0 END) + (CASE WHEN trim(date) <> '' THEN 1 ELSE 0 END) + (CASE WHEN {_NUMBER} IS NOT NULL THEN 5 ELSE 0 END)
  + (CASE WHEN regexp_matches({_TEXT}, {_sql(H.LABEL_NUMBER)}) THEN 10 ELSE 0 END) - (CASE WHEN {_FIRST} THEN 20 ELSE 0 END) + least(length({_TEXT}), 12) / 10.0::DOUBLE)"""
_KEY = f"coalesce('n:' || coalesce({_found('label', H.KEY_LABEL)}, {_found('url', H.KEY_URL)}), 'u:' || coalesce(nullif(url, ''), trim(regexp_replace(lower(label), '\\s+', ' ', 'g'))))"
_CLEAN = r"trim(regexp_replace(label, '\s+', ' ', 'g'))"
_SPLIT = " ".join(f"WHEN trim(regexp_extract({_CLEAN}, {_sql(p)}, 1)) <> '' THEN {k}" for k, p in enumerate(H.DATE_ENDS))
_PART = lambda g, rest: "CASE end_no " + " ".join(f"WHEN {k} THEN trim(regexp_extract({_CLEAN}, {_sql(p)}, {g}))" for k, p in enumerate(H.DATE_ENDS)) + f" ELSE {rest} END"


@query(f"WITH {CHAPTERS_SQL}, e AS (SELECT *, CASE {_SPLIT} END AS end_no FROM chapters) SELECT pos, {_PART(1, _CLEAN)} AS title, {_PART(2, _sql(''))} AS found_date FROM e")
def label_dates(spark, sf_dir):
    x = H.split_label_date(F.col("label"))
    return chapters(spark, sf_dir).select("pos", x["title"].alias("title"), x["date"].alias("found_date"))


@query(f"WITH {CHAPTERS_SQL} SELECT pos, {_NUMBER} AS number, {_KEY} AS key, CASE WHEN {_NUMBER} = '1' AND {_FIRST} THEN 'Chapter 1' ELSE label END AS fixed, {_QUALITY} AS quality FROM chapters")
def chapter_functions(spark, sf_dir):
    label, url, date = F.col("label"), F.col("url"), F.col("date")
    return chapters(spark, sf_dir).select("pos", H.chapter_number(label, url).alias("number"), H.chapter_key(label, url).alias("key"), H.fix_chapter_label(label, url).alias("fixed"), H.chapter_quality(label, url, date).alias("quality"))


@query(f"WITH {CHAPTERS_SQL} SELECT title_id, url, min(pos) AS pos FROM chapters WHERE trim(url) <> '' GROUP BY 1, 2")
def chapters_by_url(spark, sf_dir):
    return D.dedupe_chapters_by_url(chapters(spark, sf_dir)).select("title_id", "url", "pos")


@query(f"WITH {CHAPTERS_SQL} SELECT title_id, {_KEY} AS key, min(pos) AS pos FROM chapters GROUP BY 1, 2")
def chapters_by_key(spark, sf_dir):
    return D.dedupe_chapters_by_key(chapters(spark, sf_dir)).select("title_id", "key", "pos")


@query(f"""WITH {CHAPTERS_SQL}, once AS (SELECT *, {_NUMBER} AS number, {_QUALITY} AS quality, {_TEXT} AS txt FROM chapters WHERE trim(url) <> '' QUALIFY row_number() OVER (PARTITION BY title_id, trim(url) ORDER BY pos) = 1),
i AS (SELECT *, CASE WHEN number IS NULL THEN 'title:' || txt ELSE 'num:' || number END AS identity FROM once),
b AS (SELECT *, min(pos) OVER (PARTITION BY title_id, identity) AS first_pos, TRY_CAST(nullif(regexp_extract(number, '^(\\d+\\.?\\d*|\\.\\d+)', 1), '') AS DOUBLE) AS value FROM i
  QUALIFY row_number() OVER (PARTITION BY title_id, identity ORDER BY quality DESC, pos) = 1)
SELECT title_id, CAST(row_number() OVER (PARTITION BY title_id ORDER BY value IS NULL, floor(value) DESC NULLS LAST, value NULLS LAST, first_pos) AS INTEGER) AS place, pos, CASE WHEN number = '1' AND {_FIRST} THEN 'Chapter 1' ELSE label END AS label, number FROM b""")
def chapters_for_display(spark, sf_dir):
    return D.dedupe_chapters_for_display(chapters(spark, sf_dir)).select("title_id", "place", "pos", "label", "number")


@query(f"WITH {CHAPTERS_SQL} SELECT title_id, max(date) FILTER (WHERE length(date) >= 8) AS latest FROM chapters GROUP BY 1")
def latest_dates(spark, sf_dir):
    return chapters(spark, sf_dir).groupBy("title_id").agg(F.collect_set("date").alias("dates")).select("title_id", H.latest_date(F.col("dates")).alias("latest"))


@query(f"""WITH {CHAPTERS_SQL} SELECT title_id, pos, coalesce(lag(pos) OVER w, pos) AS previous, coalesce(lead(pos) OVER w, pos) AS next FROM chapters WINDOW w AS (PARTITION BY title_id ORDER BY pos)""")
def chapter_neighbors_by_place(spark, sf_dir):
    return D.neighbors(chapters(spark, sf_dir).select("title_id", "pos"))


_MERGE = f"""WITH {TITLES_SQL}, {CHAPTERS_SQL}, r AS (SELECT title_key AS cluster, id AS seq, genres FROM titles),
k AS (SELECT r.cluster, r.seq, c.pos, {_KEY} AS key FROM r JOIN chapters c ON c.title_id = r.seq),
m AS (SELECT cluster, key, arg_min(seq, pos) AS any_seq, min(struct_pack(seq := seq, pos := pos)) AS at FROM k GROUP BY 1, 2),
n AS (SELECT r.cluster, r.seq, coalesce((SELECT count(*) FROM k WHERE k.seq = r.seq), 0) AS own, coalesce((SELECT count(*) FROM m WHERE m.at.seq = r.seq), 0) AS fresh FROM r),
b AS (SELECT *, first(own) OVER w AS first_own, coalesce(sum(CASE WHEN own > 0 THEN 1 ELSE 0 END) OVER w, 0) AS others, sum(fresh) OVER w AS merged FROM n
  WINDOW w AS (PARTITION BY cluster ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
won AS (SELECT cluster, max(seq) AS winner FROM b WHERE first_own IS NULL OR own > CASE WHEN others - (CASE WHEN first_own > 0 THEN 1 ELSE 0 END) = 0 THEN first_own ELSE merged END GROUP BY 1)
SELECT won.cluster, winner, (SELECT count(*) FROM m WHERE m.cluster = won.cluster) AS n_chapters, (SELECT count(DISTINCT g) FROM (SELECT cluster, unnest(genres) AS g FROM r) x WHERE x.cluster = won.cluster) AS n_genres FROM won"""


@query(_MERGE)
def merge_clusters(spark, sf_dir):
    t = titles(spark, sf_dir)
    genres = t.select(F.col("id").alias("seq"), F.posexplode("genres").alias("pos", "genre"))
    best, genres, merged = D.merge_clusters(t.select(F.col("title_key").alias("cluster"), F.col("id").alias("seq")), genres, chapters(spark, sf_dir).withColumnRenamed("title_id", "seq"))
    counts = merged.groupBy("cluster").agg(F.count("*").alias("n_chapters")).join(genres.groupBy("cluster").agg(F.count("*").alias("n_genres")), "cluster", "full_outer")
    return best.select("cluster", F.col("seq").alias("winner")).join(counts, "cluster", "left").fillna(0, ["n_chapters", "n_genres"])


_DETAILS = "d AS (SELECT url, rating, source FROM titles WHERE id % 3 = 0 QUALIFY row_number() OVER (PARTITION BY url ORDER BY id) = 1)"


def _details(spark, sf_dir):
    t = titles(spark, sf_dir)
    return t, C.first_of(t.filter("id % 3 = 0"), ["url"], [F.asc("id")])


@query(f"WITH {TITLES_SQL}, {_DETAILS} SELECT id, coalesce(d.rating, t.rating) AS rating, coalesce(d.source, t.source) AS source FROM titles t LEFT JOIN d ON t.url = d.url")
def overlay_details(spark, sf_dir):
    t, details = _details(spark, sf_dir)
    return N.overlay_details(t, details, ["rating", "source"]).select("id", "rating", "source")


@query(f"WITH {TITLES_SQL}, {_DETAILS} SELECT id, coalesce(nullif(d.rating, 'N/A'), t.rating) AS rating, coalesce(d.source, t.source) AS source FROM titles t LEFT JOIN d ON t.url = d.url")
def enrich(spark, sf_dir):
    t, details = _details(spark, sf_dir)
    return N.enrich(t, details, ["rating", "source"]).select("id", "rating", "source")


@query(f"WITH {TITLES_SQL}, {_DETAILS.replace('url, rating', 'title_key, url, rating')} SELECT id, coalesce(nullif(d.rating, 'N/A'), t.rating) AS rating, coalesce(d.rating <> 'N/A', false) AS updated FROM titles t LEFT JOIN d ON t.title_key = d.title_key")
def backfill_ratings(spark, sf_dir):
    t, details = _details(spark, sf_dir)
    return N.backfill_ratings(t, details).select("id", "rating", "updated")


@query(f"""WITH {TITLES_SQL}, f AS (SELECT id, CASE WHEN id % 6 = 0 THEN '' ELSE url END AS url, title_key FROM titles WHERE id % 3 = 0),
u AS (SELECT url, min(id) AS by_url FROM f WHERE url <> '' GROUP BY 1), k AS (SELECT title_key, min(id) AS by_key FROM f WHERE title_key <> '' GROUP BY 1)
SELECT t.id, coalesce(by_url, by_key) AS fresh_id FROM titles t LEFT JOIN u ON t.url = u.url LEFT JOIN k ON t.title_key = k.title_key""")
def match_fresh(spark, sf_dir):
    t = titles(spark, sf_dir).select("id", "url", "title_key")
    return N.match_fresh(t, t.filter("id % 3 = 0").withColumn("url", F.when(F.col("id") % 6 == 0, "").otherwise(F.col("url"))))


_PATH = "regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1)"


@query(f"""WITH p AS (SELECT page_id, {_PATH} AS path FROM pages), rules AS (SELECT DISTINCT left(path, 2) AS route_key FROM p WHERE page_id % 5 = 0 UNION SELECT DISTINCT left(path, 5) FROM p WHERE page_id % 3 = 0)
SELECT page_id, path, (SELECT arg_max(route_key, length(route_key)) FROM rules WHERE starts_with(path, route_key)) AS route_key FROM p""")
def match_rule(spark, sf_dir):
    p = read(spark, sf_dir, "pages", "page_id", "url").select("page_id", F.regexp_extract("url", "^[A-Za-z]+://[^/?#]*([^?#]*)", 1).alias("path"))
    key = lambda each, n: p.filter(F.col("page_id") % each == 0).select(F.left("path", F.lit(n)).alias("route_key"))
    return N.match_rule(p, key(5, 2).union(key(3, 5)).distinct())


_HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1))"


@query(f"""WITH h AS (SELECT page_id, url, {_HOST} AS host FROM pages), allowed AS (SELECT DISTINCT regexp_extract(host, '[^.]*\\.[^.]*$') AS domain FROM h WHERE page_id % 2 = 0)
SELECT page_id, host, CASE WHEN NOT starts_with(lower(url), 'https://') THEN 'bad scheme' WHEN host = 'localhost' OR regexp_matches(host, '\\.(internal|local)$') THEN 'private host'
  WHEN EXISTS (SELECT 1 FROM allowed WHERE host = domain OR ends_with(host, '.' || domain)) THEN 'allowed' ELSE 'unknown host' END AS verdict FROM h""")
def classify_urls(spark, sf_dir):
    p = read(spark, sf_dir, "pages", "page_id", "url")
    allowed = p.filter("page_id % 2 = 0").select(F.regexp_extract(U.host_of(F.col("url")), r"[^.]*\.[^.]*$", 0).alias("domain")).distinct()
    return N.classify_urls(p, allowed).select("page_id", "host", "verdict")


@query(f"SELECT page_id, CASE WHEN contains({_HOST}, 'a') THEN 'https://a.example/' WHEN contains({_HOST}, 'e') THEN 'https://e.example/' ELSE 'https://' || {_HOST} || '/' END AS origin FROM pages")
def with_origin(spark, sf_dir):
    return N.with_origin(read(spark, sf_dir, "pages", "page_id", "url"), [("a", "https://a.example/"), ("e", "https://e.example/")]).select("page_id", "origin")


@query("""SELECT page_id, contains(lower(html), 'page not found') OR contains(lower(html), 'nothing found') OR regexp_matches(html, '(?i)<h1[^>]*>.*404') AS is_end,
  CAST(greatest(1, coalesce(list_max([CAST(x AS INTEGER) FOR x IN regexp_extract_all(html, '[?&]page=(\\d{1,9})', 1)]), 1)) AS INTEGER) AS last_page, coalesce(CASE WHEN regexp_matches(url, '(?i)^[a-z]+://[^/?#]*omegascans\\.org') AND list_position(parts, 'series') > 0 THEN list_extract(parts, list_position(parts, 'series') + 1) ELSE list_extract(parts, -1) END, '') AS slug
FROM (SELECT *, list_filter(string_split(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/'), lambda p : p <> '') AS parts FROM pages)""")
def page_functions(spark, sf_dir):
    html = F.col("html")
    return read(spark, sf_dir, "pages", "page_id", "url", "html").select("page_id", U.is_end_page(html).alias("is_end"), U.max_page(html).alias("last_page"), U.source_slug(F.col("url")).alias("slug"))


@query("""WITH r AS (SELECT doc_id, trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS flat, source FROM documents)
SELECT doc_id, length(flat) < 30 OR regexp_matches(flat, '(?i)new feature|reading history|read .{0,80} online for free') AS boilerplate, contains(lower(source), 'logo') OR contains(lower(source), 'social') AS junk FROM r""")
def description_functions(spark, sf_dir):
    flat = F.trim(F.regexp_replace("text", r"[ \t\n\r\f\x0B]+", " "))
    junk = F.lower("source").contains("logo") | F.lower("source").contains("social")
    return read(spark, sf_dir, "documents", "doc_id", "text", "source").select("doc_id", U.is_boilerplate(flat).alias("boilerplate"), junk.alias("junk"))


@query("""WITH b AS (SELECT user_id AS ip, ts, 7200 AS duration FROM events WHERE event_type = 'error')
SELECT event_id, EXISTS (SELECT 1 FROM b WHERE b.ip = e.user_id AND e.ts BETWEEN b.ts AND b.ts + INTERVAL 2 HOURS) AS blocked FROM events e""")
def apply_blocks(spark, sf_dir):
    log = request_log(spark, sf_dir)
    return N.apply_blocks(log, log.filter("status = 500").select("ip", "ts", F.lit(7200).alias("duration_s"))).select("event_id", "blocked")


@query("""WITH done AS (SELECT DISTINCT l_orderkey AS source, l_linenumber AS page FROM lineitem WHERE l_quantity > 20), last AS (SELECT l_orderkey AS source, max(l_linenumber) AS n FROM lineitem GROUP BY 1),
w AS (SELECT source, unnest(range(2, n + 1)) AS page FROM last) SELECT source, CAST(page AS INTEGER) AS page FROM w ANTI JOIN done USING (source, page)""")
def pending_pages(spark, sf_dir):
    lines = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity").withColumnsRenamed({"l_orderkey": "source", "l_linenumber": "page"})
    return N.pending_pages(lines.filter("l_quantity > 20").select("source", "page").distinct(), lines.groupBy("source").agg(F.max("page").alias("last_page")))


@query("""WITH a AS (SELECT user_id AS source, event_type AS page, ts, event_id, CASE WHEN value < 20 THEN 0 ELSE 1 END AS items FROM events)
SELECT source, page FROM a QUALIFY row_number() OVER (PARTITION BY source, page ORDER BY ts DESC, event_id DESC) = 1 AND items = 0""")
def failed_pages(spark, sf_dir):
    e = read(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value")
    return N.failed_pages(e.select(F.col("user_id").alias("source"), F.col("event_type").alias("page"), "ts", F.col("event_id").alias("attempt"), F.when(F.col("value") < 20, 0).otherwise(1).alias("items")))


@query(f"WITH {TITLES_SQL} SELECT source, count(*) AS results, max(id) AS last_id, bool_or(rating <> 'N/A') AS ok FROM titles GROUP BY 1")
def source_stats(spark, sf_dir):
    return P.source_stats(titles(spark, sf_dir))


_VALID = f"""WITH {TITLES_SQL}, v AS (SELECT title_key, min(id) AS id FROM titles WHERE length(title) >= 3 AND NOT regexp_matches(lower(title), 'manga lists|latest updates|home|search|scythe scans|demonic scans|page not found|404') GROUP BY 1)
SELECT title_key, id, (SELECT count(*) FROM v) > {{0}} AS has_more FROM v ORDER BY id LIMIT 30 OFFSET {{1}}"""


@query(_VALID.format(30, 0))
def browse(spark, sf_dir):
    return C.browse(titles(spark, sf_dir)).select("title_key", "id", "has_more")


@query(_VALID.format(60, 30))
def browse_second_page(spark, sf_dir):
    return C.browse(titles(spark, sf_dir), 2).select("title_key", "id", "has_more")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, sf_dir):
    return feeds.parsed(read(spark, sf_dir, "events", "event_id", "props"), "props", "k long").select("event_id", "x.k")


@query(r"""WITH t AS (SELECT doc_id, 'What' || chr(39) || upper(substr(lang, 1, 1)) || substr(lang, 2) || '  ' || coalesce(source, '') AS title, lower(substr(lang, 1, 1)) || substr(lang, 2) AS low FROM documents)
SELECT doc_id, regexp_replace('What' || chr(39) || low || '  ' || substr(title, length('What') + length(low) + 4), '\s{2,}', ' ', 'g') AS fixed FROM t""")
def fixed_titles(spark, sf_dir):
    d = read(spark, sf_dir, "documents", "doc_id", "lang", "source")
    title = F.concat(F.lit("What'"), F.upper(F.left("lang", F.lit(1))), F.substring("lang", 2, 99), F.lit("  "), F.coalesce("source", F.lit("")))
    return d.select("doc_id", U.fix_title(title).alias("fixed"))


_CLEANED = f"left(trim(regexp_replace(regexp_replace(replace(nfc_normalize(text), chr(0), ''), {_sql(S.DROPPED)}, '', 'g'), '[\x01-\x1F\x7F]', '', 'g')), 100)"


@query(f"""WITH q AS (SELECT conv_id, turn, text, {_CLEANED} AS clean FROM conversations WHERE role = 'user')
SELECT conv_id, turn, clean, CASE WHEN coalesce(trim(text), '') = '' THEN 'required' WHEN length(clean) < 2 THEN 'too short' WHEN regexp_matches(clean, {_sql(S.REFUSED)}) THEN 'invalid' END AS reason FROM q""")
def classify_queries(spark, sf_dir):
    q = read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").filter("role = 'user'").withColumn("clean", S.clean_query(F.col("text")))
    return q.select("conv_id", "turn", "clean", S.reject_reason(F.col("text"), F.col("clean")).alias("reason"))


NOW = datetime.datetime(2030, 1, 1, tzinfo=datetime.timezone.utc)


def _batches(spark, sf_dir):
    """A snapshot of the titles with even ids, one for each key, and a batch of those with odd ids."""
    c = chapters(spark, sf_dir).groupBy(F.col("title_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("pos", "label", "url", "date"))).alias("c"))
    held = F.transform(F.coalesce("c", F.array().cast("array<struct<pos:bigint,label:string,url:string,date:string>>")), lambda x: F.struct(x["label"].alias("title"), x["url"].alias("url"), x["date"].alias("date")))
    none = F.lit("").alias
    t = titles(spark, sf_dir).join(c, "id", "left").select(
        F.col("id").alias("seq"), "title_key", "title", F.repeat("title", (F.col("id") % 3).cast("int")).alias("description"), "rating", none("status"), none("type"), "genres", none("author"), none("artist"), none("cover_url"), "url", "source", held.alias("chapters"),
        "chapter_count", "published_at", "updated_at",
    )
    stored = C.first_of(t.filter("seq % 2 = 0"), ["title_key"], [F.asc("seq")])
    sources = F.array(F.struct(F.col("source").alias("name"), F.col("url").alias("url"), F.col("updated_at").cast("timestamp").alias("last_seen")))
    stored = stored.withColumn("sources", sources).withColumn("updated_at", F.col("updated_at").cast("timestamp")).withColumn("created_at", F.col("updated_at"))
    return stored, t.filter("seq % 2 = 1")


_BATCHES = f"""{TITLES_SQL}, {CHAPTERS_SQL}, k AS (SELECT title_id, {_KEY} AS key, date FROM chapters),
c AS (SELECT * FROM titles WHERE id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY title_key ORDER BY id) = 1),
b AS (SELECT * FROM titles WHERE id % 2 = 1 AND length(title_key) >= 3 QUALIFY row_number() OVER (PARTITION BY title_key ORDER BY id) = 1),
raw AS (SELECT title_id, count(*) AS n, max(date) FILTER (WHERE length(date) >= 8) AS latest FROM k GROUP BY 1),
fresh AS (SELECT b.title_key, count(DISTINCT k.key) AS n FROM b JOIN k ON k.title_id = b.id LEFT JOIN c ON c.title_key = b.title_key WHERE NOT EXISTS (SELECT 1 FROM k x WHERE x.title_id = c.id AND x.key = k.key) GROUP BY 1),
j AS (SELECT coalesce(c.title_key, b.title_key) AS title_key, c.id AS old_id, b.id AS new_id, CASE WHEN c.id IS NULL THEN 'insert' WHEN b.id IS NULL THEN 'keep' ELSE 'update' END AS action,
  CASE WHEN c.id IS NULL OR (b.id IS NOT NULL AND b.rating <> 'N/A') THEN b.rating ELSE c.rating END AS rating,
  CASE WHEN c.id IS NULL THEN coalesce(nullif(repeat(b.title, b.id % 3), ''), 'No description available.') WHEN length(repeat(b.title, b.id % 3)) > length(repeat(c.title, c.id % 3)) THEN repeat(b.title, b.id % 3) ELSE repeat(c.title, c.id % 3) END AS description,
  c.chapter_count AS kept_count, coalesce(r.n, 0) AS stored_n, coalesce(f.n, 0) AS fresh_n, c.source AS old_source, b.source AS new_source, c.published_at AS old_published, nr.latest AS new_published
  FROM c FULL OUTER JOIN b ON c.title_key = b.title_key LEFT JOIN raw r ON r.title_id = c.id LEFT JOIN raw nr ON nr.title_id = b.id LEFT JOIN fresh f ON f.title_key = b.title_key)"""
_COUNT = "CAST(CASE WHEN action = 'keep' THEN CAST(kept_count AS BIGINT) ELSE stored_n + fresh_n END AS VARCHAR) AS chapter_count"


@query(f"""WITH {_BATCHES} SELECT title_key, action, rating, description, {_COUNT}, CASE WHEN action = 'update' AND old_source <> new_source THEN 2 ELSE 1 END AS n_sources,
  CASE WHEN action = 'insert' THEN new_published ELSE old_published END AS published_at FROM j""")
def upsert_titles(spark, sf_dir):
    done = M.upsert_titles(*_batches(spark, sf_dir), NOW)
    return done.select("title_key", "action", "rating", "description", "chapter_count", F.size("sources").alias("n_sources"), "published_at")


@query(f"WITH {_BATCHES} SELECT title_key, rating, description, {_COUNT}, action = 'update' AS refreshed FROM j WHERE action <> 'insert'")
def refresh_titles(spark, sf_dir):
    return M.refresh_titles(*_batches(spark, sf_dir), NOW).select("title_key", "rating", "description", "chapter_count", "refreshed")


@query(f"WITH {TITLES_SQL} SELECT min(id) AS id, url || '/' || id % 50 AS url FROM titles t WHERE id % 2 = 1 AND url || '/' || id % 50 NOT IN (SELECT url || '/' || (id + 7) % 50 FROM titles WHERE id % 2 = 0) GROUP BY 2")
def append_new(spark, sf_dir):
    t = titles(spark, sf_dir)
    numbered = lambda shift: F.concat("url", F.lit("/"), ((F.col("id") + shift) % 50).cast("string")).alias("url")
    return M.append_new(t.filter("id % 2 = 0").select(numbered(7)).distinct(), t.filter("id % 2 = 1").select("id", numbered(0)), key="url", order="id").select("id", "url")
