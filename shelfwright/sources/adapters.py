"""Tables of the test star schema in the shapes that the catalog operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import title_key


#: Columns of a stored title.
TITLE = "id long, title string, title_key string, rating string, source string, genres array<string>, chapter_count string, published_at string, updated_at timestamp, url string"


def read_catalog(spark: SparkSession, path: str, columns: list[str] | None = None, equals: dict | None = None, matches: dict[str, str] | None = None) -> DataFrame:
    """Stored titles: filters by equality and by pattern and the columns wanted, all of which reach the scan."""
    df = spark.read.schema(TITLE).parquet(path)
    for c, v in (equals or {}).items():
        df = df.filter(F.col(c) == v)
    for c, pattern in (matches or {}).items():
        df = df.filter(F.col(c).rlike(pattern))
    return df.select(*columns) if columns else df


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A title for each part: text rating with N/A, genres, a chapter count as text, dates of its lines."""
    lines = read(spark, sf_dir, "lineitem", "l_partkey", "l_shipdate").groupBy("l_partkey").agg(F.count("*").alias("chapters"), F.max("l_shipdate").alias("updated_at"))
    part = read(spark, sf_dir, "part", "p_partkey", "p_name", "p_type", "p_brand", "p_size")
    rating = F.when(F.col("p_size") % 7 == 0, "N/A").otherwise((F.col("p_size") / 5).cast("decimal(4,1)").cast("string"))
    key = F.col("p_partkey")
    marked = F.when(key % 11 == 0, F.array(F.lit("Boys Love"))).when(key % 13 == 0, F.array(F.lit("mature"))).when(key % 17 == 0, F.array(F.lit("SM-BDSM"), F.lit("ActionFantasy"))).otherwise(F.array().cast("array<string>"))
    return part.join(lines, F.col("p_partkey") == F.col("l_partkey"), "left").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), title_key(F.col("p_name")).alias("title_key"), rating.alias("rating"), F.col("p_brand").alias("source"),
        F.array_distinct(F.concat(F.split("p_type", " "), F.split("p_name", " "), marked)).alias("genres"), F.coalesce("chapters", F.lit(0)).cast("string").alias("chapter_count"),
        F.date_format("updated_at", "yyyy-MM-dd").alias("published_at"), F.col("updated_at"), F.concat(F.lit("https://example.org/title/"), title_key(F.col("p_name"))).alias("url"),
    )


TITLES_SQL = """
lines AS (SELECT l_partkey, count(*) AS chapters, max(l_shipdate) AS updated_at FROM lineitem GROUP BY 1),
titles AS (
  SELECT p_partkey AS id, p_name AS title, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS title_key,
    CASE WHEN p_size % 7 = 0 THEN 'N/A' ELSE CAST(CAST(p_size / 5.0 AS DECIMAL(4,1)) AS VARCHAR) END AS rating, p_brand AS source,
    list_concat(list_concat(string_split(p_type, ' '), string_split(p_name, ' ')), CASE WHEN p_partkey % 11 = 0 THEN ['Boys Love'] WHEN p_partkey % 13 = 0 THEN ['mature'] WHEN p_partkey % 17 = 0 THEN ['SM-BDSM', 'ActionFantasy'] ELSE [] END) AS genres, CAST(coalesce(chapters, 0) AS VARCHAR) AS chapter_count,
    strftime(updated_at, '%Y-%m-%d') AS published_at, updated_at, 'https://example.org/title/' || regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS url
  FROM part LEFT JOIN lines ON p_partkey = l_partkey
)"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scraped record for each document: its first 60 characters are the title, all others the description, its source the batch."""
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "source")
    title = F.substring("text", 1, 60)
    return docs.select(F.col("source").alias("batch_id"), F.col("doc_id").alias("seq"), title.alias("title"), F.expr("substring(text, 61)").alias("description"), title_key(title).alias("title_key"))


RECORDS_SQL = """
records AS (
  SELECT source AS batch_id, doc_id AS seq, substr(text, 1, 60) AS title, substr(text, 61) AS description,
    regexp_replace(lower(substr(text, 1, 60)), '[^a-z0-9]', '', 'g') AS title_key
  FROM documents
)"""


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type")
    return events.select("event_id", "ts", F.col("user_id").alias("ip"), F.col("event_type").alias("endpoint"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"))


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chapter for each line of a part: labels of five forms, some with dates, some without url."""
    n, key = F.col("l_linenumber").cast("string"), F.col("l_orderkey").cast("string")
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    form = F.col("l_orderkey") % 5
    label = (
        F.when(form == 0, F.concat(F.lit("Chapter "), n, F.lit(" "), day)).when(form == 1, F.concat(F.lit("Ch. "), n, F.lit(".5"))).when(form == 2, F.concat(F.lit("Episode "), n, F.lit("  3 day ago")))
        .when(form == 3, "Read First!").otherwise(F.concat(F.lit("Notes "), n, F.lit("d")))
    )
    url = F.when(F.col("l_tax") == 0, "").when(form == 3, F.concat(F.lit("https://example.org/read/"), key)).otherwise(F.concat(F.lit("https://example.org/t/"), F.col("l_partkey").cast("string"), F.lit("/chapter-"), n))
    date = F.when(form == 4, "").otherwise(day)
    lines = read(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_linenumber", "l_tax", "l_shipdate")
    return lines.select(F.col("l_partkey").alias("title_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), label.alias("label"), url.alias("url"), date.alias("date"))


CHAPTERS_SQL = """
chapters AS (
  SELECT l_partkey AS title_id, l_orderkey * 10 + l_linenumber AS pos,
    CASE l_orderkey % 5 WHEN 0 THEN 'Chapter ' || l_linenumber || ' ' || strftime(l_shipdate, '%Y-%m-%d') WHEN 1 THEN 'Ch. ' || l_linenumber || '.5'
      WHEN 2 THEN 'Episode ' || l_linenumber || '  3 day ago' WHEN 3 THEN 'Read First!' ELSE 'Notes ' || l_linenumber || 'd' END AS label,
    CASE WHEN l_tax = 0 THEN '' WHEN l_orderkey % 5 = 3 THEN 'https://example.org/read/' || l_orderkey ELSE 'https://example.org/t/' || l_partkey || '/chapter-' || l_linenumber END AS url,
    CASE WHEN l_orderkey % 5 = 4 THEN '' ELSE strftime(l_shipdate, '%Y-%m-%d') END AS date
  FROM lineitem
)"""
