"""Cleaning and judging of search queries."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Characters that go from a query, and what a refused query holds.
DROPPED = r"[<>\"'`;{}()\\\[\]/!@#$%^&*+=|~]"
REFUSED = r"(?i)['\";`]|--|;\s|\bOR\s+\d|\bAND\s+\d|\bUNION\b|\bSELECT\b.*\bFROM\b|\bDROP\s+TABLE|\$where|\$ne|\$gt|\bjavascript:"


@F.pandas_udf(StringType())
def composed(text: pd.Series) -> pd.Series:
    """NFC, which Spark has no function for."""
    return text.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")


def clean_query(q: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.replace(composed(q), F.lit("\0"), F.lit("")), DROPPED, ""), r"[\x01-\x1F\x7F]", "")
    return F.left(F.trim(bare), F.lit(100))


def reject_reason(raw: Column, clean: Column) -> Column:
    """Why a query isn't run: required, too short or invalid; null for one that is."""
    return F.when(F.coalesce(F.trim(raw), F.lit("")) == "", "required").when(F.length(clean) < 2, "too short").when(clean.rlike(REFUSED), "invalid")
