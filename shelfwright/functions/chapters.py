"""Column functions on chapter labels: dates, numbers, keys, quality."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ends of labels that are dates, in the order in which they are tried.
DATE_ENDS = (
    r"^(.*?)(\b\d{4}-\d{2}-\d{2}\b)\s*$",
    r"^(.*?)(\b\d{1,2}/\d{1,2}/\d{2,4}\b)\s*$",
    r"(?i)^(.*?)(\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{1,2},?\s+\d{4}\b)\s*$",
    r"(?i)^(.*?)(\b\d+\s*(?:second|sec|s)\s*ago\b)\s*$",
    r"(?i)^(.*?)(\b\d+\s*(?:minute|min|m)\s*ago\b)\s*$",
    r"(?i)^(.*?)(\b\d+\s*(?:hour|hr|h)\s*ago\b)\s*$",
    r"(?i)^(.*?)(\b\d+\s*(?:day|d)\s*ago\b)\s*$",
    r"(?i)^(.*?)(\b\d+\s*(?:week|w)\s*ago\b)\s*$",
    r"(?i)^(.*?)(\b\d+\s*(?:month|mo)\s*ago\b)\s*$",
    r"(?i)^(.*?)(\b\d+\s*(?:year|yr|y)\s*ago\b)\s*$",
    r"(?i)^(.*?)\s+(\d+[smhdwymo])\s*$",
    r"(?i)^(.*?)(\byesterday\b)\s*$",
    r"(?i)^(.*?)(\btoday\b)\s*$",
    r"(?i)^(.*?)(\bjust now\b)\s*$",
    r"(?i)^(.*?)(\b\d+\s*(?:seconds?|minutes?|hours?|days?|weeks?|months?|years?)\b)\s*$",
)
# Where a chapter's number stands in its label and in its url, in this order.
LABEL_NUMBER = r"(?:chapter|chap|ch\.?|episode|ep\.?)\s*([\d.]+)"
URL_NUMBERS = (r"[?&](?:chapter|episode(?:_no)?)=([\d.]+)", r"(?:chapter|episode)[-_/]([\d.]+)", r"viewer\?[^#]*episode_no=([\d.]+)")
FIRST_LABELS = "read first|start here|begin here"
KEY_LABEL, KEY_URL = r"(?i)(?:chapter|ch\.?|episode|ep\.?)\s*([\d.]+)", r"(?i)(?:chapter|episode)[-_/]([\d.]+)"


def _found(text: Column, pattern: str) -> Column:
    """The pattern's first group, null where there is none."""
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def _known(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def split_label_date(raw: Column) -> Column:
    """title and date: the first end pattern that leaves a title; else the whole label and no date."""
    clean = F.trim(F.regexp_replace(_known(raw), r"(?U)\s+", " "))
    cut = lambda p: F.when(F.trim(F.regexp_extract(clean, p, 1)) != "", F.struct(F.trim(F.regexp_extract(clean, p, 1)).alias("title"), F.trim(F.regexp_extract(clean, p, 2)).alias("date")))
    return F.coalesce(*map(cut, DATE_ENDS), F.struct(clean.alias("title"), F.lit("").alias("date")))


def chapter_text(label: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(_known(label)), r"[^a-z0-9\s.:-]", " "), r"\s+", " "))


def chapter_number(label: Column, url: Column) -> Column:
    """The number as text: from the label, from the url, 1 for a first chapter's label, else any number; null without one."""
    text, low = chapter_text(label), F.lower(_known(url))
    return F.coalesce(_found(text, LABEL_NUMBER), *[_found(low, p) for p in URL_NUMBERS], F.when(text.rlike(FIRST_LABELS), "1"), _found(text, r"\b([\d.]+)\b"))


def number_value(number: Column) -> Column:
    """The leading decimal number of a text."""
    return F.regexp_extract(number, r"^(\d+\.?\d*|\.\d+)", 1).try_cast("double")


def chapter_key(label: Column, url: Column) -> Column:
    number = F.coalesce(_found(_known(label), KEY_LABEL), _found(_known(url), KEY_URL))
    low = F.trim(F.regexp_replace(F.lower(_known(label)), r"(?U)\s+", " "))
    return F.coalesce(F.concat(F.lit("n:"), number), F.concat(F.lit("u:"), F.coalesce(F.nullif(url, F.lit("")), low)))


def fix_chapter_label(label: Column, url: Column) -> Column:
    return F.when((chapter_number(label, url) == "1") & chapter_text(label).rlike(FIRST_LABELS), "Chapter 1").otherwise(label)


def chapter_quality(label: Column, url: Column, date: Column) -> Column:
    text = chapter_text(label)
    points = lambda c, n: F.when(c, n).otherwise(0)
    known = points(F.trim(_known(url)) != "", 1) + points(F.trim(_known(date)) != "", 1) + points(chapter_number(label, url).isNotNull(), 5)
    return known + points(text.rlike(LABEL_NUMBER), 10) - points(text.rlike(FIRST_LABELS), 20) + F.least(F.length(text), F.lit(12)) / 10


def latest_date(dates: Column) -> Column:
    """The greatest of the date texts with eight characters or more; null without one."""
    return F.array_max(F.filter(dates, lambda d: F.length(d) >= 8))
