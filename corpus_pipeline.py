"""The corpus pipeline: documents to packed sequences in five stages.

Each stage gets what its predecessor kept, written as Parquet and read again. All but the last return the
columns of documents, whatever further ones there are. For all stages: an empty table gives no rows; a row
without doc_id is never a duplicate; columns other than doc_id, text, lang and source are only carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfwright.llm.near_dups import near_duplicates
from shelfwright.llm.packing import best_fit_packing
from shelfwright.llm.pii import sanitize
from shelfwright.llm.quality import keep_clean
from shelfwright.llm.shared import materialize, table
from shelfwright.llm.suffix_dedup import without_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go; so do those without text, which fail the base rules. Repeated rows share their verdict."""
    return keep_clean(docs)


def near_dups(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one with the smallest id.

    The verdict holds for an id and a text, so rows of a repeated id with different texts are judged each; of
    rows with the same id and text one stays. Documents without text are no copies of each other.
    """
    found = near_duplicates(docs).select("doc_id", "text_hash", "kept").filter("doc_id is not null")
    verdicts = materialize(found.groupBy("doc_id", "text_hash").agg(F.every("kept").alias("kept"), F.count("*").alias("n")).filter("not kept or n > 1"), "verdicts")
    keyed = docs.select(F.struct("*").alias("row")).withColumns({"_id": F.col("row.doc_id").cast("long"), "_hash": F.xxhash64(F.col("row.text").cast("string"))})
    same = lambda v: (F.col("_id") == v["doc_id"]) & (F.col("_hash") == v["text_hash"])
    once = keyed.join(verdicts, same(verdicts), "left_anti").select("row")
    repeated = verdicts.filter("kept")
    if not repeated.isEmpty():
        once = once.union(keyed.join(repeated, same(repeated), "left_semi").dropDuplicates(["_id", "_hash"]).select("row"))
    return once.select("row.*")


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings that start earlier too are cut from the texts; null and empty texts stay as they are."""
    return without_repeats(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and telling terms are generalised or removed in the texts; null and empty texts stay as they are."""
    return sanitize(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of the documents' pieces in sequences of 2048 tokens; a null text counts as empty, and repeated rows are packed each."""
    return best_fit_packing(docs)


STAGES = [("quality_rules", quality), ("near_duplicates", near_dups), ("suffix_dedup", repeats), ("pii", personal_data), ("packing", packing)]

#: Byte-level suffix search and tokenizing can't be stated in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, name)
    return docs
