"""The registered queries of search, output, pages and fuzzy rules, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog_queries import _NUMBER, _RECENT, SHOWN, _edits, _page_sql, query
from .functions import pages as U
from .functions import text as T
from .operators import catalog as C
from .operators import output as O
from .operators import reports as R
from .operators import search as X
from .plans import pages as P
from .sources import feeds
from .sources.adapters import RECORDS_SQL, TITLES_SQL, read, records, titles

_ADULT = f"len([g FOR g IN genres IF lower(g) IN {T.ADULT_GENRES}]) > 0"
_LOOSE = f"""(len([g FOR g IN genres IF regexp_matches(g, '(?i)^(?:{"|".join(T.loose_genre(g)[5:-1].replace(chr(39), chr(39) * 2) for g in T.ADULT_GENRES)})$')]) > 0 OR regexp_matches(source, '(?i)13'))"""


# --- listings with totals


@query(_page_sql(f"rating DESC, {_RECENT}"))
def listing_rating_text_order(spark, sf_dir):
    return C.listing(titles(spark, sf_dir), "rating", legacy_string_order=True).select(*SHOWN.split(", "))


@query(_page_sql(f"{_NUMBER}, updated_at DESC NULLS LAST"))
def listing_landing(spark, sf_dir):
    return C.listing(titles(spark, sf_dir), "landing").select(*SHOWN.split(", "))


@query(f"WITH {TITLES_SQL}, f AS (SELECT * FROM titles WHERE list_contains([lower(g) FOR g IN genres], 'widget')) SELECT id, (SELECT count(*) FROM f) AS total, (SELECT count(*) FROM f) > 20 AS has_more FROM f ORDER BY {_RECENT}, title_key, id LIMIT 10 OFFSET 10")
def genre_page(spark, sf_dir):
    return C.listing_page(titles(spark, sf_dir), genre="widget", page=2, size=10).select("id", "total", "has_more")


@query(f"WITH {TITLES_SQL} SELECT genre, total FROM (SELECT 'boys love' AS genre, 0 AS total UNION ALL SELECT 'widget', count(*) FROM titles WHERE list_contains([lower(g) FOR g IN genres], 'widget')) x")
def genre_guard(spark, sf_dir):
    t = titles(spark, sf_dir)
    totals = [C.of_genre(t, g).agg(F.lit(g).alias("genre"), F.count("*").alias("total")) for g in ("boys love", "widget")]
    return totals[0].unionByName(totals[1])


def _adult_sql(where: str, size: int) -> str:
    loose = _LOOSE.replace("(?i)13", T.ADULT_SOURCES)
    return f"WITH {TITLES_SQL}, f AS (SELECT * FROM titles WHERE {loose} AND {where}) SELECT id, (SELECT count(*) FROM f) AS total, (SELECT count(*) FROM f) > {size} AS has_more FROM f ORDER BY updated_at DESC NULLS LAST, {_NUMBER}, title_key, id LIMIT {size}"


@query(_adult_sql("true", 40))
def adult_page(spark, sf_dir):
    return O.adult_page(titles(spark, sf_dir)).select("id", "total", "has_more")


@query(_adult_sql("len([g FOR g IN genres IF regexp_matches(g, '(?i)^sm[\\s_-]+bdsm$')]) > 0 AND (contains(lower(title), 'e') OR len([g FOR g IN genres IF contains(lower(g), 'e')]) > 0)", 5))
def adult_page_of_genre(spark, sf_dir):
    return O.adult_page(titles(spark, sf_dir), genre="sm bdsm", query="E", size=5).select("id", "total", "has_more")


# --- search


_WORDS = lambda c: f"string_split(trim(regexp_replace(regexp_replace(lower({c}), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')), ' ')"
_TEXT = f"""WITH {TITLES_SQL}, s AS (SELECT id, title_key, title, genres, len([w FOR w IN {_WORDS("title")} IF w IN ({{words}})]) * 10
  + list_sum([len([w FOR w IN {_WORDS("g")} IF w IN ({{words}})]) FOR g IN list_distinct(genres)]) * 4 AS score FROM titles),
found AS (SELECT * FROM s WHERE score > 0 ORDER BY score DESC, title_key, id LIMIT 50),
other AS (SELECT id, title_key, title, genres, 0 AS score FROM titles WHERE contains(lower(title), '{{query}}') OR len([g FOR g IN genres IF contains(lower(g), '{{query}}')]) > 0 ORDER BY title_key, id LIMIT 50),
r AS (SELECT * FROM found WHERE (SELECT count(*) FROM found) >= 3 UNION ALL SELECT * FROM other WHERE (SELECT count(*) FROM found) < 3)
SELECT id, CAST(score AS BIGINT) AS score FROM r WHERE NOT {_ADULT}"""


@query(_TEXT.format(words="'red', 'widget'", query="red widget"))
def search(spark, sf_dir):
    return X.search(titles(spark, sf_dir), "Red, widget!")


@query(_TEXT.format(words="'idge'", query="idge"))
def search_by_substring(spark, sf_dir):
    return X.search(titles(spark, sf_dir), "idge")


_Q = lambda c: f"trim(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


# The phrases as the rule states them, apart from the code's own list.
DENIED_PHRASES = "manga lists|latest updates|popular|home|search|scythe scans|demonic scans"


def _ranked_sql(q: str) -> str:
    words = [w for w in q.split() if len(w) > 1]
    hits = lambda c: "(" + " + ".join(f"CAST(contains({c}, '{w}') AS INTEGER)" for w in words) + ")"
    need = -(-len(words) * 6 // 10) if len(words) >= 4 else max(1, -(-len(words) // 2))
    one = f"(contains(t, '{words[0]}') AND NOT ({len(words[0])} < length(t) * 0.3 AND length(t) > {3 * len(words[0])}))" if len(words[0]) >= 3 else "false"
    enough = one if len(words) == 1 else f"{hits('t')} >= {need}"
    share = f"{hits('t')} / {len(words)}.0"
    more = f" + CASE WHEN {share} >= 0.8 THEN 120 WHEN {share} >= 0.6 THEN 50 ELSE 0 END" if len(words) >= 4 else ""
    return f"""WITH {RECORDS_SQL}, p AS (SELECT seq, batch_id, title, title_key, {_Q("title")} AS t, {_Q("description")} AS d FROM records),
ranked AS (SELECT seq, batch_id, title, title_key, CAST((CASE WHEN t = '{q}' THEN 1000 ELSE 0 END) + (CASE WHEN contains(t, '{q}') THEN 300 ELSE 0 END) + (CASE WHEN contains('{q}', t) AND length(t) > 8 THEN 120 ELSE 0 END) + 25 * {hits("t")} + 5 * {hits("d")}{more} AS INTEGER) AS score
  FROM p WHERE NOT regexp_matches(t, '{DENIED_PHRASES}') AND (contains(t, '{q}') OR {enough}))"""


@query(_ranked_sql("the and") + " SELECT seq, score FROM ranked")
def ranked_two_words(spark, sf_dir):
    return X.ranked(records(spark, sf_dir), "The AND").select("seq", "score")


@query(_ranked_sql("ingst") + " SELECT seq, score FROM ranked")
def ranked_one_word(spark, sf_dir):
    return X.ranked(records(spark, sf_dir), "ingst").select("seq", "score")


@query(_ranked_sql("the and of in er") + " SELECT seq, score FROM ranked")
def ranked_five_words(spark, sf_dir):
    return X.ranked(records(spark, sf_dir), "the and of in er").select("seq", "score")


_SWORDS = lambda c: f"[w FOR w IN string_split_regex(lower({c}), '[ \\t\\n\\r\\f]+') IF length(w) > 2]"
_ROMAN2 = "regexp_replace(replace(replace(lower({t}), 'ou', 'o'), 'uu', 'u'), '[^a-z0-9]', '', 'g')"
_SEARCH_PAIRS = f"""sk AS (SELECT batch_id, seq, title_key AS k, {_ROMAN2.format(t="title")} AS r, {_SWORDS("title")} AS w FROM {{rows}} WHERE length(title_key) >= 3),
sp AS (SELECT x.batch_id, x.seq AS a, y.seq AS b FROM sk x JOIN sk y ON x.batch_id = y.batch_id AND x.seq < y.seq AND (x.k = y.k OR x.r = y.r
  OR (length(x.k) > 5 AND length(y.k) > 5 AND (contains(x.k, y.k) OR contains(y.k, x.k)) AND least(length(x.k), length(y.k)) / greatest(length(x.k), length(y.k)) >= 0.65)
  OR (abs(length(x.k) - length(y.k)) <= 3 AND length(y.k) > 5 AND {_edits("x.k", "y.k", 0.2)})
  OR (len(x.w) >= 2 AND len(y.w) >= 2 AND len(list_filter(y.w, lambda w : list_contains(x.w, w))) / least(len(x.w), len(y.w)) >= 0.7)))"""


@query(f"WITH {RECORDS_SQL}, {_SEARCH_PAIRS.format(rows='records')} SELECT * FROM sp")
def search_pairs(spark, sf_dir):
    return C.fuzzy_pairs(records(spark, sf_dir), "search")



@query(None)
def dedupe_search(spark, sf_dir):
    return X.dedupe_search(records(spark, sf_dir), [F.asc("seq")]).select("batch_id", "seq")


_R2 = "lower(title)"
for _a, _b in ((r"\s*\([^)]*\)\s*", " "), (r"\s*\[[^\]]*\]\s*", " "), ("ou", "o"), ("uu", "u"), ("ou", "o"), ("aa", "a"), ("ee", "e"), ("oo", "o"), (r"[:\-–—]\s+.*$", ""), (r"\s+for\s+the\s+", " "), (r"\s+to\s+", " "), (r"[^a-z0-9\s]", ""), (r"\s+", " ")):
    _R2 = f"regexp_replace({_R2}, '{_a}', '{_b}', 'g')"
_TWORDS = "[w FOR w IN string_split_regex(regexp_replace(lower(title), '[^a-z0-9\\s]', ' ', 'g'), '\\s+') IF length(w) > 2]"


@query(f"""WITH {RECORDS_SQL}, k AS (SELECT batch_id, seq, title_key AS k, replace(trim({_R2}), ' ', '') AS r, {_TWORDS} AS w FROM records WHERE length(title_key) >= 3)
SELECT x.batch_id, x.seq AS a, y.seq AS b FROM k x JOIN k y ON x.batch_id = y.batch_id AND x.seq < y.seq AND (
  x.k = y.k OR x.r = y.r OR (abs(length(x.r) - length(y.r)) <= 3 AND length(x.r) > 3 AND {_edits("x.r", "y.r", 0.15)})
  OR (length(x.k) > 6 AND length(y.k) > 6 AND (starts_with(x.k, y.k) OR starts_with(y.k, x.k) OR ((contains(x.k, y.k) OR contains(y.k, x.k)) AND least(length(x.k), length(y.k)) / greatest(length(x.k), length(y.k)) >= 0.7)))
  OR (abs(length(x.k) - length(y.k)) <= 3 AND length(x.k) > 5 AND {_edits("x.k", "y.k", 0.2)})
  OR (len(x.w) >= 2 AND len(y.w) >= 2 AND len(list_filter(x.w, lambda w : list_contains(y.w, w))) >= 2 AND len(list_filter(x.w, lambda w : list_contains(y.w, w))) / least(len(x.w), len(y.w)) >= 0.7))""")
def title_pairs(spark, sf_dir):
    return C.fuzzy_pairs(records(spark, sf_dir), "title")


# --- output


_CASES = lambda c, names: f"CASE {c} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in names.items()) + f" ELSE {c} END"
_GENRES = f"list_distinct([g FOR g IN [{_CASES('lower(trim(p))', T.CANONICAL_GENRES).replace('ELSE lower(trim(p)) END', 'ELSE trim(p) END')} FOR p IN flatten([string_split(regexp_replace(x, '([a-z])([A-Z])', '\\1|\\2', 'g'), '|') FOR x IN genres])] IF g <> ''])"
_CODE = "CASE id % 5 WHEN 0 THEN 'Source A' WHEN 1 THEN 'Source G' WHEN 2 THEN 'ManhuaTop' WHEN 3 THEN '' ELSE source END"
_COVER = "CASE id % 4 WHEN 0 THEN '' WHEN 1 THEN 'http://img.example/' || id || '/a b(1)''~*.jpg?x=1&y=+' WHEN 2 THEN '/api/img/' || id ELSE 'img' || id || '.png' END"


def _rough(spark, sf_dir):
    """Titles as they are stored, with gaps."""
    i = F.col("id") % 5
    t = titles(spark, sf_dir)
    code = F.when(i == 0, "Source A").when(i == 1, "Source G").when(i == 2, "ManhuaTop").when(i == 3, "").otherwise(F.col("source"))
    text = F.col("id").cast("string")
    cover = F.when(F.col("id") % 4 == 0, "").when(F.col("id") % 4 == 1, F.concat(F.lit("http://img.example/"), text, F.lit("/a b(1)'~*.jpg?x=1&y=+"))).when(F.col("id") % 4 == 2, F.concat(F.lit("/api/img/"), text)).otherwise(F.concat(F.lit("img"), text, F.lit(".png")))
    filled = {"source": code, "cover_url": cover, "description": F.concat(F.lit("![a](b) "), "title", F.lit("   "), "source"), "rating": F.when(F.col("rating") != "N/A", F.col("rating")), "status": F.when(i == 0, "").otherwise("Ongoing"), "author": F.lit(None).cast("string"), "artist": F.when(i == 4, "Ann")}
    return t.withColumns(filled)


@query(f"""WITH {TITLES_SQL} SELECT id, title, trim(regexp_replace(title || '   ' || source, '\\s+', ' ', 'g')) AS description, rating, CASE WHEN id % 5 = 0 THEN 'Unknown' ELSE 'Ongoing' END AS status, 'Unknown' AS author, CASE WHEN id % 5 = 4 THEN 'Ann' ELSE 'Unknown' END AS artist,
  coalesce(nullif({_CASES(f"({_CODE})", T.SOURCE_NAMES)}, ''), 'Unknown') AS source, array_to_string(list_sort({_GENRES}), ',') AS genres, chapter_count, url,
  CASE WHEN length({_COVER}) < 5 THEN '' WHEN starts_with({_COVER}, '/api/') OR NOT starts_with({_COVER}, 'http') THEN {_COVER} ELSE '/api/img?url=http%3A%2F%2Fimg.example%2F' || id || '%2Fa%20b(1)''~*.jpg%3Fx%3D1%26y%3D%2B' END AS cover_url FROM titles""")
def public_titles(spark, sf_dir):
    shown = O.to_public(_rough(spark, sf_dir))
    return shown.select("id", "title", "description", "rating", "status", "author", "artist", "source", F.array_join(F.array_sort("genres"), ",").alias("genres"), "chapter_count", "url", "cover_url")


@query(r"""WITH r AS (SELECT page_id, regexp_extract(html, '<article>(.*?)</article>', 1, 's') AS part, url FROM pages),
t AS (SELECT page_id, url, regexp_replace(part, '<[^>]*>', '', 'g') AS bare FROM r)
SELECT page_id, trim(replace(replace(replace(replace(replace(replace(replace(replace(bare, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&#x27;', chr(39)), '&#x2F;', '/'), '&nbsp;', ' ')) AS title,
  CASE page_id % 3 WHEN 0 THEN '' ELSE regexp_replace(trim('  ' || url || '<"' || chr(39)), '[<>"' || chr(39) || '`]', '', 'g') END AS url FROM t""")
def clean_records(spark, sf_dir):
    p = read(spark, sf_dir, "pages", "page_id", "url", "html")
    address = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit(" JavaScript:"), "url")).otherwise(F.concat(F.lit("  "), "url", F.lit("<\"'")))
    return X.clean_record(p.select("page_id", F.regexp_extract("html", "(?s)<article>(.*?)</article>", 1).alias("title"), address.alias("url"))).select("page_id", "title", "url")


@query(f"""WITH {RECORDS_SQL} SELECT seq, array_to_string([upper(w[1]) || w[2:] FOR w IN string_split_regex(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), '[-_]+') IF w <> ''], ' ') AS titled,
  array_to_string([upper(w[1]) || w[2:] FOR w IN string_split(title_key, '-') IF w <> ''], ' ') AS from_url FROM records""")
def slug_functions(spark, sf_dir):
    url = F.concat(F.lit("https://x.example/en/drama/"), "title_key", F.lit("/list?title_no=3"))
    return records(spark, sf_dir).select("seq", T.title_case(T.slugify(F.col("title"), "_")).alias("titled"), T.title_from_url(url).alias("from_url"))


_IP = "CASE user_id % 3 WHEN 0 THEN '' ELSE ' 10.0.0.' || user_id || ' , 10.1.1.1' END", "CASE user_id % 4 WHEN 0 THEN '' ELSE ' 10.2.0.' || user_id END"


@query(f"""SELECT event_id, coalesce(nullif(trim(string_split({_IP[0]}, ',')[1]), ''), nullif(trim({_IP[1]}), ''), 'unknown') AS forwarded_first, coalesce(nullif(trim({_IP[1]}), ''), nullif(trim(string_split({_IP[0]}, ',')[1]), ''), 'unknown') AS real_first FROM events""")
def client_ips(spark, sf_dir):
    n = F.col("user_id")
    forwarded, real = F.when(n % 3 == 0, "").otherwise(F.concat(F.lit(" 10.0.0."), n.cast("string"), F.lit(" , 10.1.1.1"))), F.when(n % 4 == 0, "").otherwise(F.concat(F.lit(" 10.2.0."), n.cast("string")))
    return read(spark, sf_dir, "events", "event_id", "user_id").select("event_id", U.client_ip(forwarded, real).alias("forwarded_first"), U.client_ip(forwarded, real, real_first=True).alias("real_first"))


_WORDY = "CASE doc_id % 4 WHEN 0 THEN text || ' status: completed' WHEN 1 THEN text || ' Hiatus, was completed' WHEN 2 THEN text || ' on hiatus' ELSE text END"


@query(f"""WITH d AS (SELECT doc_id, {_WORDY} AS t, lower({_WORDY}) AS low FROM documents), p AS (SELECT *, CASE WHEN contains(low, 'completed') THEN 'Completed' WHEN contains(low, 'hiatus') THEN 'Hiatus' ELSE 'Ongoing' END AS plain FROM d)
SELECT doc_id, coalesce(nullif(regexp_extract(t, '{T.STATUS}', 1), ''), plain) AS labelled, CASE WHEN contains(low, 'hiatus') THEN 'Hiatus' ELSE plain END AS last, CASE WHEN contains(low, 'completed') THEN 'Completed' ELSE 'Ongoing' END AS fallback FROM p WHERE t IS NOT NULL""")
def status_rules(spark, sf_dir):
    k, ends = F.col("doc_id") % 4, {0: " status: completed", 1: " Hiatus, was completed", 2: " on hiatus"}
    end = F.lit("")
    for n, x in ends.items():
        end = F.when(k == n, x).otherwise(end)
    text = F.concat("text", end)
    rules = [T.detect_status(text, r, F.lit("Ongoing")).alias(r) for r in ("labelled", "last", "fallback")]
    return read(spark, sf_dir, "documents", "doc_id", "text").filter("text is not null").select("doc_id", *rules)


# --- pages


@query("""WITH l AS (SELECT page_id, regexp_extract_all(html, '<a href="([^"?#]*)[^"]*">([^<]*)</a>', 1) AS h, regexp_extract_all(html, '<a href="([^"?#]*)[^"]*">([^<]*)</a>', 2) AS n FROM pages),
u AS (SELECT page_id, unnest(h) AS href, trim(regexp_replace(unnest(n), '\\s+', ' ', 'g')) AS title, unnest(range(len(h))) AS pos FROM l)
SELECT page_id, 'https://x.example' || href AS url, CAST(min(pos) AS INTEGER) AS pos, arg_min(title, pos) AS title FROM u WHERE regexp_matches(href, '^/[A-Z]') AND length(title) >= 3 AND NOT regexp_matches(title, '(?i)^(?:Latest|Popular|Top |New |Trending|All |Best |Manhua |Manhwa |Read )') GROUP BY 1, 2""")
def link_cards(spark, sf_dir):
    return P.link_cards(read(spark, sf_dir, "pages", "page_id", "html"), "https://x.example", "^/[A-Z]", 3)


@query(r"""WITH p AS (SELECT page_id, html, regexp_replace(regexp_replace(html, '<(?:script|style|head)\b.*?</(?:script|style|head)>', ' ', 'gs'), '<[^>]*>', ' ', 'g') AS body FROM pages),
x AS (SELECT page_id, regexp_extract_all(replace(html, '<p', chr(1) || '<p'), '<p\b[^>]*>([^' || chr(1) || ']*?)(?:</p>|</article>|</body>|$|' || chr(1) || ')', 1, 's') AS raw FROM pages),
c AS (SELECT page_id, [trim(regexp_replace(trim(replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(r, '<[^>]*>', '', 'g'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', chr(39)), '&#x27;', chr(39)), '&#x2F;', '/'), '&nbsp;', ' ')), '\s+', ' ', 'g')) FOR r IN raw] AS texts FROM x)
SELECT page_id, CASE WHEN contains(lower(body), 'completed') THEN 'Completed' WHEN contains(lower(body), 'hiatus') THEN 'Hiatus' ELSE 'Ongoing' END AS status, 'N/A' AS rating, 'Manhwa' AS type FROM p JOIN c USING (page_id)""")
def page_details(spark, sf_dir):
    return P.page_details(read(spark, sf_dir, "pages", "page_id", "html")).select("page_id", "status", "rating", "type")


# --- selectors, feeds, counts


@query(f"WITH {TITLES_SQL} SELECT id FROM titles WHERE title_key = 'redwidget' OR contains(lower(url), 'red-widget') ORDER BY title_key <> 'redwidget', title_key, id LIMIT 1")
def lookup_title(spark, sf_dir):
    return C.lookup_title(titles(spark, sf_dir), "red-Widget").select("id")


_LACKING = "WITH r AS (SELECT source AS batch_id, doc_id AS seq, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'c' END AS cover_url, CASE WHEN doc_id % 5 = 0 THEN 'N/A' ELSE '7' END AS rating, CASE WHEN doc_id % 2 = 0 THEN '' ELSE text END AS description FROM documents)"


@query(f"""{_LACKING}, n AS (SELECT 'cover' AS rule, 10 AS cap, * FROM r WHERE cover_url = '' UNION ALL SELECT 'facts', 15, * FROM r WHERE cover_url <> '' AND rating = 'N/A' AND coalesce(description, '') = '' UNION ALL SELECT 'any', 10, * FROM r WHERE coalesce(description, '') = '' OR rating = 'N/A')
SELECT rule, batch_id, seq FROM n QUALIFY row_number() OVER (PARTITION BY rule, batch_id ORDER BY seq) <= cap""")
def needs_detail(spark, sf_dir):
    i = F.col("doc_id")
    r = read(spark, sf_dir, "documents", "doc_id", "source", "text").select(F.col("source").alias("batch_id"), i.alias("seq"), F.when(i % 3 == 0, "").otherwise("c").alias("cover_url"), F.when(i % 5 == 0, "N/A").otherwise("7").alias("rating"), F.when(i % 2 == 0, "").otherwise(F.col("text")).alias("description"))
    parts = [C.needs_detail(r, rule).select(F.lit(rule).alias("rule"), "batch_id", "seq") for rule in ("cover", "facts", "any")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("""SELECT coalesce(CASE WHEN l_partkey % 2 = 0 THEN 's' || l_partkey END, 'asked') AS slug, CASE l_linenumber % 3 WHEN 0 THEN 'Chapter ' || l_linenumber || ' - End' WHEN 1 THEN 'Chapter ' || l_linenumber ELSE 'c' || l_linenumber END AS title,
  'https://x.example/series/' || coalesce(CASE WHEN l_partkey % 2 = 0 THEN 's' || l_partkey END, 'asked') || '/c' || l_linenumber AS url, strftime(l_shipdate, '%b %-d, %Y') AS date FROM lineitem WHERE l_linenumber <> 4""")
def chapter_feed_2(spark, sf_dir):
    n, part = F.col("l_linenumber"), F.col("l_partkey")
    num = n.cast("string")
    item = F.struct(
        F.when(n != 4, F.concat(F.lit("c"), num)).alias("chapter_slug"), F.when(n % 3 != 2, F.concat(F.lit("Chapter "), num)).alias("chapter_name"), F.when(n % 3 == 0, "End").otherwise("").alias("chapter_title"),
        F.date_format("l_shipdate", "yyyy-MM-dd'T'00:00:00").alias("created_at"), F.struct(F.when(part % 2 == 0, F.concat(F.lit("s"), part.cast("string"))).alias("series_slug")).alias("series"),
    )
    raw = read(spark, sf_dir, "lineitem", "l_partkey", "l_linenumber", "l_shipdate").select(F.to_json(F.struct(F.array(item).alias("data"))).alias("value"))
    return feeds.chapter_feed_2(raw, "https://x.example", "asked")


@query(f"WITH {TITLES_SQL} SELECT CASE WHEN cat.k IS NULL THEN 'insert' WHEN b.k IS NULL THEN 'keep' ELSE 'update' END AS action, count(*) AS n FROM (SELECT DISTINCT title_key AS k FROM titles WHERE id % 2 = 0) cat FULL OUTER JOIN (SELECT DISTINCT title_key AS k FROM titles WHERE id % 2 = 1 AND length(title_key) >= 3) b ON cat.k = b.k GROUP BY 1")
def upsert_counts(spark, sf_dir):
    from .detail_queries import NOW, _batches
    from .operators import merge as M

    return R.action_counts(M.upsert_titles(*_batches(spark, sf_dir), NOW))


@query(f"WITH {TITLES_SQL} SELECT id, title FROM titles WHERE url <> '' AND rating = 'N/A' ORDER BY updated_at NULLS FIRST, id LIMIT 30")
def pick_for_backfill(spark, sf_dir):
    return R.pick_stale(titles(spark, sf_dir).withColumn("description", F.col("title")), needs_backfill=True).select("id", "title")
