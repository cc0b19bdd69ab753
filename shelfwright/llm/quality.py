"""Quality rules: how far a document's histograms lie from those of the corpus' languages.

Each document gets the base counts, a histogram of character classes and one of common words. The
histograms of all documents that pass the base rules are summed by language, and each sum of at least
REFERENCE_WORDS words is a reference. A document is held against its own language's reference, joined by
language, and against those of all languages with MIN_SHARE of the documents. It is kept if one of them lies
within both Jensen-Shannon distances (base 2, 0 to 1). Guards: in a language with less text the base rules
decide; below `min_words` words only the character histogram is compared; a document without words fails the
base rules.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .shared import materialize, released, small_batches

# Frequent words of English, French, German and Spanish.
COMMON_WORDS = (
    "the of and to in a is that for it was on are as with be by this or from "
    "de la le et les des en un du une que est pour qui dans par sur au pas avec "
    "der die und den von zu das mit sich auf ist im ein eine dem nicht es auch als für "
    "el que los se las por con para una su al lo como más pero sus no si o y"
).split()
SYMBOLS = b"#*$%&|<>"
SENTENCE_MARKS = b".,;:!?'\"()-"
#: References of languages with this share of the documents are held against all documents: 200 at most.
MIN_SHARE = 1 / 200
#: With fewer words, chance alone moves a histogram of the common words by a tenth of the distance allowed or more.
REFERENCE_WORDS = 10_000

_WORD_SLOT = {w.encode(): i + 1 for i, w in enumerate(dict.fromkeys(COMMON_WORDS))}
N_WORD_SLOTS = len(_WORD_SLOT) + 1


def _char_classes() -> np.ndarray:
    """Class of each byte: 26 letters, digit, blank, line end, sentence mark, symbol, other letter, none, control."""
    slots = np.full(256, 33, np.uint8)
    slots[33:127] = 30
    slots[list(SENTENCE_MARKS)] = 29
    slots[ord("0") : ord("9") + 1] = 26
    slots[[32, 9]] = 27
    slots[[10, 11, 12, 13]] = 28
    for i in range(26):
        slots[[65 + i, 97 + i]] = i
    slots[0x80:0xC0] = 32  # continuation bytes: the first byte of the character counts
    slots[0xC0:] = 31
    return slots


CHAR_CLASS = _char_classes()
N_CHAR_SLOTS = 34

FEATURES = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, chars array<int>, common array<int>"


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words which occurs twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    times = Counter(zip(words, words[1:], words[2:], strict=False))
    if len(times) == n:
        return 0
    twice = np.fromiter((times[x] > 1 for x in zip(words, words[1:], words[2:], strict=False)), bool, n)
    inside = np.zeros(n + 2, bool)
    for k in range(3):
        inside[k : k + n] |= twice
    return int(inside.sum())


def measure(text: str | None) -> tuple:
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()  # of bytes: splits at x20 and x09-x0D only
    blanks = len(raw) - sum(map(len, words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    chars = np.bincount(CHAR_CLASS[np.frombuffer(raw, np.uint8)], minlength=N_CHAR_SLOTS)
    chars[32] = 0
    common = [0] * N_WORD_SLOTS
    for word, times in Counter(map(_WORD_SLOT.get, raw.lower().split())).items():
        common[word or 0] += times
    return len(words), len(text or "") - blanks, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), chars, common


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "chars", "common"]
    for rows in batches:
        found = list(zip(*map(measure, rows["text"]), strict=True)) or [[]] * len(names)
        yield pd.DataFrame({"doc_id": rows["doc_id"], "lang": rows["lang"], **{k: list(v) for k, v in zip(names, found, strict=True)}})


def _sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each language of a batch: its documents and the sums of their histograms."""
    for rows in batches:
        for lang, own in rows.groupby("lang", dropna=False):
            yield pd.DataFrame({"lang": [lang if isinstance(lang, str) else None], "docs": [len(own)], "hist": [np.concatenate([np.sum(np.stack(own[k].to_list()), axis=0, dtype=np.int64) for k in ("chars", "common")])]})


def _distance(hist: np.ndarray, ref: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, base 2, of each row of hist to ref or to ref's row at its place; 1 for a row without counts."""
    total = hist.sum(axis=1, keepdims=True)
    p, q = hist / np.maximum(total, 1), ref / np.maximum(ref.sum(axis=-1, keepdims=True), 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        kp = np.where(p > 0, p * np.log2(p / m), 0).sum(axis=1)
        kq = np.where(q > 0, q * np.log2(q / m), 0).sum(axis=1)
    return np.where(total[:, 0] == 0, 1.0, np.sqrt(np.clip((kp + kq) / 2, 0, 1)))


def _references(found: DataFrame) -> DataFrame:
    """lang, docs, n_words and hist: the summed histograms of each language in found."""
    sums = (
        found.filter(~F.col("base_failed")).select("lang", "chars", "common").mapInPandas(_sums, "lang string, docs long, hist array<long>")
        .select("lang", "docs", F.posexplode("hist").alias("slot", "n")).groupBy("lang", "slot").agg(F.sum("docs").alias("docs"), F.sum("n").alias("n"))
        .groupBy("lang").agg(F.max("docs").alias("docs"), F.sum(F.when(F.col("slot") >= N_CHAR_SLOTS, F.col("n"))).alias("n_words"), F.array_sort(F.collect_list(F.struct("slot", "n"))).alias("hist"))
    )
    return materialize(sums.withColumn("hist", F.transform("hist", lambda x: x["n"])), "references")


class Judge:
    """The base rules and the distances to the references, for frames of features.

    refs are held against each row, and so is the row's own reference in the column own, where there is one:
    null if the row's language is among refs, empty if it has too little text.
    """

    def __init__(self, refs: np.ndarray, min_base_words: int, max_repeat_percent: int, min_words: int, max_char_distance: float, max_word_distance: float):
        self.refs, self.base, self.limits = refs, (min_base_words, max_repeat_percent), (min_words, max_char_distance, max_word_distance)

    def __call__(self, part: pd.DataFrame) -> pd.DataFrame:
        least, percent = self.base
        words, repeats = part["n_words"].to_numpy(np.int64), part["n_repeat_words"].to_numpy(np.int64)
        failed = (words < least) | (100 * repeats > percent * words)
        sizes = np.array([-1 if x is None else len(x) for x in part["own"]], int)
        out = part.drop(columns=["chars", "common", "own"]).assign(base_failed=failed, char_distance=None, word_distance=None, kept=~failed)
        if len(part) and (len(self.refs) or sizes.max() > 0):
            min_words, max_char, max_word = self.limits
            hists = np.stack(part["chars"].to_list()).astype(float), np.stack(part["common"].to_list()).astype(float)
            char, word = (np.full((len(part), len(self.refs) + 1), np.inf) for _ in range(2))
            for to, hist, slots in zip((char, word), hists, (slice(N_CHAR_SLOTS), slice(N_CHAR_SLOTS, None)), strict=True):
                for j, ref in enumerate(self.refs):
                    to[:, j] = _distance(hist, ref[slots])
                if (own := sizes > 0).any():
                    to[own, -1] = _distance(hist[own], np.stack(part["own"][own].to_list()).astype(float)[:, slots])
            near = (char <= max_char) & ((word <= max_word) | (words < min_words)[:, None])
            at, best = np.arange(len(part)), np.argmin(char + word, axis=1)
            known = np.isfinite(char[at, best])
            out = out.assign(char_distance=np.where(known, char[at, best], None), word_distance=np.where(known, word[at, best], None), kept=(near.any(axis=1) | (sizes == 0)) & ~failed)
        return out


def _prepared(docs: DataFrame, settings: dict) -> tuple[DataFrame, Judge, DataFrame]:
    """The features of docs, their judge and lang_, own: the references that are not the judge's, empty ones for languages with too little text."""
    small_batches(docs.sparkSession, rows=1000, size=4 << 20)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), _lang(docs).alias("lang"))
    settings = {"min_base_words": 50, "max_repeat_percent": 50, "min_words": 100, "max_char_distance": 0.33, "max_word_distance": 0.325} | settings
    failed = (F.col("n_words") < settings["min_base_words"]) | (100 * F.col("n_repeat_words") > settings["max_repeat_percent"] * F.col("n_words"))
    found = materialize(rows.mapInPandas(released(_features), FEATURES), "quality")
    every = _references(found.withColumn("base_failed", failed))
    total = every.agg(F.sum("docs")).first()[0] or 0
    enough = F.col("n_words") >= REFERENCE_WORDS
    shared = (F.col("docs") >= MIN_SHARE * total) & enough
    refs = np.array([r["hist"] for r in every.filter(shared).orderBy("lang").collect()], np.float64).reshape(-1, N_CHAR_SLOTS + N_WORD_SLOTS)
    others = every.filter(~shared).select(F.col("lang").alias("lang_"), F.when(enough, F.col("hist")).otherwise(F.array().cast("array<long>")).alias("own"))
    return found, Judge(refs, **settings), others


def _lang(docs: DataFrame) -> Column:
    return (F.col("lang") if "lang" in docs.columns else F.lit(None)).cast("string")


def _with_own(rows: DataFrame, others: DataFrame) -> DataFrame:
    """rows with own, joined by lang; Spark broadcasts the references where they are few, and splits frequent languages where they are not."""
    if others.isEmpty():
        return rows.withColumn("own", F.lit(None).cast("array<long>"))
    return rows.join(others, F.col("lang").eqNullSafe(F.col("lang_")), "left").drop("lang_")


JUDGED = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, char_distance double, word_distance double, kept boolean"


def quality_rules(docs: DataFrame, **settings) -> DataFrame:
    """Base counts, distances to the nearest reference and the verdict for each row of docs(doc_id, text, lang).

    Settings: min_base_words, max_repeat_percent (base rules), min_words, max_char_distance,
    max_word_distance. A null text counts as empty: zero counts, base_failed, not kept. A null language is a
    language of its own. Repeated rows get the same verdict each; other columns are ignored. Where a language
    has too little text for a reference the base rules decide. Without any reference to compare with,
    distances are null.
    """
    found, judge, others = _prepared(docs, settings)
    return _with_own(found, others).drop("lang").mapInPandas(lambda batches: map(judge, batches), JUDGED)


def keep_clean(docs: DataFrame, **settings) -> DataFrame:
    """The rows of docs that quality_rules keeps, with all their columns; judged where they lie."""
    _, judge, others = _prepared(docs, settings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            part = pd.DataFrame({"text": rows.column("row").field("text").to_pylist(), "doc_id": 0, "lang": None})
            own = pd.Series(rows.column("own").to_pylist(), dtype=object)
            for features in _features(iter([part])):
                kept = judge(features.assign(own=own))["kept"].to_numpy(bool)
                yield rows.select(["row"]).filter(pa.array(kept))

    rows = _with_own(docs.select(F.struct("*").alias("row"), _lang(docs).alias("lang")), others)
    kind = StructType().add("row", docs.schema)
    return rows.select("row", "own").mapInArrow(run, kind).select("row.*")
