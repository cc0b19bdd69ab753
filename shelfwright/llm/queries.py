"""The registered queries of the operators: thin, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .html_text import extract_main_text
from .licenses import license_scan
from .merkle import merkle_manifest
from .near_dups import near_duplicates
from .packing import best_fit_packing
from .pii import pii_report
from .quality import quality_rules
from .secrets import secret_scan
from .sentencepieces import encode_pieces
from .shared import table
from .spelling import spelling_variants
from .suffix_dedup import suffix_dedup
from .token_files import token_file_digests
from .topk import exact_top_k


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=2)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(table(spark, sf_dir, "documents"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_pieces(table(spark, sf_dir, "documents")).select("doc_id", "n_pieces", "ids_crc32", "round_trip")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_report(table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_digests(table(spark, sf_dir, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


#: The table of crc32 as a CTE, and crc32 of the list `bytes`.
CRC = """crc AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda a, _: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY i) AS t FROM range(256) r(i)
)"""
HASH = "xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), CAST(bytes AS BIGINT[])), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])))"


def said(*columns: str) -> str:
    return " || ".join(f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in columns)


#: DuckDB SQL of the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op9_exact_top_k": """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(CAST(q.x AS DOUBLE[]), CAST(c.x AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
""",
    "op11_spelling_variants": f"""
WITH RECURSIVE {CRC}, runs AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents
), said AS (
  SELECT run, CAST(doc_id AS VARCHAR) || ':' || run AS s FROM runs WHERE length(run) >= 6
), hashed AS (
  SELECT run, {HASH} AS h
  FROM (SELECT run, flatten([CASE WHEN ord(c) < 128 THEN [ord(c)] ELSE [192 + ord(c) // 64, 128 + ord(c) % 64] END FOR c IN string_split(s, '')]) AS bytes FROM said), crc
), words AS (
  SELECT word, count(*) AS n
  FROM (SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING count(*) >= 5
), without AS (
  SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)
), pairs AS (
  SELECT a.word, b.word AS other, b.n FROM without a JOIN without b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM without a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM without a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, count(*) AS n_near, arg_min(other, (-n, encode(other))) AS other, max(n) AS other_n FROM pairs GROUP BY word
), forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * w.n THEN other END AS form, CASE WHEN other_n >= 5 * w.n THEN other_n END AS form_n
  FROM words w LEFT JOIN best USING (word)
), up AS (
  SELECT word, word AS root, form AS next FROM forms
  UNION ALL SELECT u.word, f.word, f.form FROM up u JOIN forms f ON u.next = f.word
)
SELECT f.word, f.form, u.root, f.n, f.n_near, f.form_n FROM forms f JOIN up u ON u.word = f.word AND u.next IS NULL
""",
    "op13_merkle_manifest": f"""
WITH RECURSIVE {CRC}, fields AS (
  SELECT doc_id, source, {said('doc_id', 'source', 'lang', 'n_chars')} AS facts, text,
    [ascii(c) FOR c IN string_split(CAST(doc_id AS VARCHAR), '')] AS bytes
  FROM documents
), rows AS (
  SELECT doc_id, source, sha256(facts || {said('text')}) AS leaf,
    sha256(facts || {said("CASE WHEN " + HASH + " % 2 = 0 THEN replace(text, chr(10), '') ELSE text END")}) AS tampered
  FROM fields, crc
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r FROM rows
), up AS (
  SELECT 0 AS level, source, r AS i, leaf AS h, count(*) OVER (PARTITION BY source) AS n FROM ranked
  UNION ALL
  SELECT level + 1, source, i // 3, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 2) // 3) FROM up WHERE n > 1 GROUP BY level, source, i // 3
), tops AS (
  SELECT source, h AS subroot, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS r FROM up WHERE n = 1
), over AS (
  SELECT 0 AS level, r AS i, subroot AS h, count(*) OVER () AS n FROM tops
  UNION ALL
  SELECT level + 1, i // 3, sha256(string_agg(h, '' ORDER BY i)), any_value((n + 2) // 3) FROM over WHERE n > 1 GROUP BY level, i // 3
), fold AS (
  SELECT 0 AS level, d.doc_id, d.leaf, d.source, d.r, t.subroot, t.r AS top, d.tampered AS folded, '' AS proof,
    (SELECT max(level) FROM up u WHERE u.source IS NOT DISTINCT FROM d.source) AS height
  FROM ranked d JOIN tops t ON d.source IS NOT DISTINCT FROM t.source
  UNION ALL
  SELECT f.level + 1, any_value(f.doc_id), any_value(leaf), f.source, f.r, any_value(subroot), any_value(top),
    sha256(string_agg(CASE WHEN u.i = (CASE WHEN f.level < height THEN f.r ELSE top END) // CAST(3 ** (f.level - CASE WHEN f.level < height THEN 0 ELSE height END) AS BIGINT) THEN folded ELSE u.h END, '' ORDER BY u.i)),
    any_value(proof) || coalesce(string_agg(CASE WHEN u.i <> (CASE WHEN f.level < height THEN f.r ELSE top END) // CAST(3 ** (f.level - CASE WHEN f.level < height THEN 0 ELSE height END) AS BIGINT) THEN u.h END, '' ORDER BY u.i), ''),
    any_value(height)
  FROM fold f JOIN (SELECT false AS above, level, source, i, h, n FROM up UNION ALL SELECT true, level, NULL, i, h, n FROM over) u
    ON u.n > 1 AND u.above = (f.level >= height) AND (u.above OR u.source IS NOT DISTINCT FROM f.source)
    AND u.level = f.level - CASE WHEN f.level < height THEN 0 ELSE height END
    AND u.i // 3 = (CASE WHEN f.level < height THEN f.r ELSE top END) // CAST(3 ** (u.level + 1) AS BIGINT)
  GROUP BY f.level, f.source, f.r
)
SELECT doc_id, leaf, subroot, o.h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = o.h AS verified
FROM fold f, (SELECT h FROM over WHERE n = 1) o
WHERE f.level = height + (SELECT max(level) FROM over)
""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
