"""Removal of repeated byte strings by suffix arrays.

A byte goes if it lies in a string of `length` bytes that also starts earlier (smaller doc_id, or same
document and earlier start). Each such window of a document belongs to one anchor: the place in it whose
`GRAM`-byte string has the least hash. Equal windows have equal anchors at equal distance, so anchors with
the same string are searched together, and an anchor's windows form one context.

1. Anchors of equal string and equal context are one class; all but its earliest are covered whole. This is
   done in each batch of documents first, then in the bucket that the anchor's string is dealt to.
2. For strings with several classes the earliest anchors' contexts are fetched. The bytes right of an
   anchor, and those left of it backwards, are packed into symbols; one suffix array over all of them
   (linear grouping construction) ranks both sides, and the longest common prefixes of neighbours tell
   for each distance which windows are equal. The later ones are covered.
   Strings with more than CROWDED such contexts, which would fill one task, are searched window by window
   instead: windows of equal 128-bit digests are equal, and all but the earliest are covered.
3. Each document's covered intervals are merged and its kept bytes digested.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize, released, small_batches

LENGTH, GRAM = 100, 32
#: Windows that are looked at in one go; longer texts are taken in parts.
PART = 1 << 18
#: Contexts of one string that one suffix array takes.
CROWDED = 20_000
#: Bytes of a symbol, as digits of base 257 with 0 for the end.
DIGITS = 7

#: Equal cls and cls2, 128 bits of two independent hashes, stand for equal contexts.
ANCHOR = np.dtype([("gram", "u8"), ("cls", "u8"), ("cls2", "u8"), ("doc", "i8"), ("pos", "i8"), ("sub", "i8"), ("lo", "u1"), ("hi", "u1")])
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_BASE2 = np.uint64(0xBF58476D1CE4E5B9)
_BACK2 = np.uint64(pow(0xBF58476D1CE4E5B9, -1, 2**64))
_Q = np.uint64(0xD6E8FEB86659FD93)
_powers = [np.ones(1, np.uint64)] * 4


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _Q
    return h ^ (h >> np.uint64(29))


_BYTES2 = _mix(_mix(np.arange(1, 257, dtype=np.uint64) * _BASE2))


def powers(n: int) -> list[np.ndarray]:
    """Powers of both bases and of their inverses, up to n."""
    if len(_powers[0]) <= n:
        for k, base in enumerate((_BASE, _BACK, _BASE2, _BACK2)):
            x = np.full(max(n + 1, 1 << 16), base)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers


def anchors(raw: bytes, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """gram, two hashes of the context, place, and the distances to the first and the last window, for each anchor of a text."""
    if len(raw) < length:
        return tuple(np.empty(0, t) for t in (np.uint64, np.uint64, np.uint64, np.int64, np.uint8, np.uint8))
    found = []
    for start in range(0, len(raw) - length + 1, PART):
        x = np.frombuffer(raw, np.uint8)[start : start + PART + length - 1]
        up, down, up2, down2 = powers(len(x))
        sums, sums2 = np.zeros(len(x) + 1, np.uint64), np.zeros(len(x) + 1, np.uint64)
        np.cumsum(_mix(x.astype(np.uint64) + np.uint64(1)) * down[: len(x)], out=sums[1:])
        np.cumsum(_BYTES2[x] * down2[: len(x)], out=sums2[1:])
        h = _mix((sums[GRAM:] - sums[:-GRAM]) * up[: len(x) - GRAM + 1])
        least, at, width, span = h, np.arange(len(h), dtype=np.int32), 1, length - GRAM + 1
        while width < span:  # the leftmost least hash of each window, by doubling
            step = min(width, span - width)
            first = least[:-step] <= least[step:]
            at = np.where(first, at[:-step], at[step:])
            least = np.minimum(least[:-step], least[step:])
            width += step
        low = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        high = np.r_[low[1:], len(at)] - 1
        place = at[low].astype(np.int64)
        around = (place - low).astype(np.uint64) * _BASE + (high - low).astype(np.uint64) * _Q
        context = _mix((sums[high + length] - sums[low]) * up[low]) + around
        context2 = _mix((sums2[high + length] - sums2[low]) * up2[low]) + around
        found.append((h[place], _mix(context), _mix(context2), place + start, (place - low).astype(np.uint8), (place - high).astype(np.uint8)))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def suffix_array(symbols: list[int]) -> list[int]:
    """Ranks of the suffixes of symbols (whole numbers; the last is 0 and the only 0): the suffix array, by linear grouping.

    First the suffixes are grouped by their longest Lyndon prefixes: groups are taken in descending order, and
    the nearest smaller suffix before each of a group's suffixes (its parent) grows by the group's prefix, so
    it moves to a group right behind its own. Then, from the least suffix on, each suffix puts those whose
    Lyndon prefix ends before it at the next free place of their groups.
    """
    n = len(symbols)
    order = sorted(range(n), key=symbols.__getitem__)
    rank, group, size = [0] * n, [0] * n, {}
    at = last = -1
    for r, i in enumerate(order):
        rank[i] = r
        if symbols[i] != last:
            at, last = r, symbols[i]
            size[at] = 0
        group[i] = at
        size[at] += 1
    parent = [-1] * n
    end = n
    while end > 0:
        start = group[order[end - 1]]
        if end - start == 1:
            i = order[start]
            j = i - 1
            while j >= 0 and group[j] >= start:
                j = parent[j]
            parent[i] = j
            if j >= 0:  # the parent goes to the end of its group
                g = group[j]
                m = size[g]
                if m > 1:
                    to = g + m - 1
                    r, other = rank[j], order[to]
                    order[r], order[to], rank[other], rank[j] = other, j, r, to
                    group[j], size[to], size[g] = to, 1, m - 1
        else:
            members = sorted(order[start:end])
            grown: dict[int, int] = {}
            for i in members:
                j = i - 1
                while j >= 0 and group[j] >= start:
                    j = parent[j]
                parent[i] = j
                if j >= 0:
                    grown[j] = grown.get(j, 0) + 1
            for j in sorted(grown, key=grown.__getitem__, reverse=True) if len(grown) > 1 else grown:
                g = group[j]
                m = size[g]
                to = g + m - 1
                r, other = rank[j], order[to]
                if r != to:
                    order[r], order[to], rank[other], rank[j] = other, j, r, to
                size[g] = m - 1
            # parents of one old group with the same count are a new group: they stand together now
            by: dict[tuple[int, int], list[int]] = {}
            for j, c in grown.items():
                by.setdefault((group[j], c), []).append(j)
            for js in by.values():
                first = min(rank[j] for j in js)
                for j in js:
                    group[j] = first
                size[first] = len(js)
        end = start
    free: dict[int, int] = {}
    out, placed = [0] * n, [False] * n
    out[0] = n - 1
    placed[n - 1] = True
    for r in range(n):
        j = out[r] - 1
        while j >= 0 and not placed[j]:
            g = group[j]
            k = free.get(g, g)
            out[k], free[g], placed[j] = j, k + 1, True
            j = parent[j]
    return out


def _packed(rows: np.ndarray) -> np.ndarray:
    """Symbols of DIGITS digits each from rows of digits (byte + 1, 0 for the end)."""
    width = -(-rows.shape[1] // DIGITS)
    full = np.zeros((len(rows), width * DIGITS), np.int64)
    full[:, : rows.shape[1]] = rows
    return full.reshape(len(rows), width, DIGITS) @ (257 ** np.arange(DIGITS - 1, -1, -1, dtype=np.int64))


def _sides(gram: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Orders of both sides by gram and bytes, and for each place the bytes shared with the one before (-1: another gram)."""
    n = len(gram)
    _, gram = np.unique(gram, return_inverse=True)
    text = []
    for rows in (right, left):
        packed = _packed(rows)
        text.append(np.concatenate([gram[:, None].astype(np.int64), packed + n, np.full((n, 1), -1)], axis=1))  # packed symbols rank above the grams
    widths, bounds = [t.shape[1] for t in text], [0, text[0].size, text[0].size + text[1].size]
    flat = np.concatenate([text[0].ravel(), text[1].ravel(), [-2]])
    _, symbols = np.unique(flat, return_inverse=True)
    order = np.array(suffix_array(symbols.tolist()))
    out = []
    for rows, width, a, b in zip((right, left), widths, bounds[:-1], bounds[1:], strict=True):
        own = order[(order >= a) & (order < b)] - a
        own = own[own % width == 0] // width
        same = rows[own[1:]] == rows[own[:-1]]
        shared = np.where(same.all(axis=1), rows.shape[1], np.argmin(same, axis=1))
        shared[gram[own[1:]] != gram[own[:-1]]] = -1
        out += [own, np.r_[-1, shared]]
    return tuple(out)


def covered(found: np.ndarray, contexts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of anchors with their contexts: which have a window that an earlier one has too, and the union of these windows."""
    by_place = np.lexsort((found["pos"], found["doc"]))
    found, contexts = found[by_place], [contexts[k] for k in by_place]
    n, span = len(found), length - GRAM
    left, right = np.zeros((n, span), np.int16), np.zeros((n, length), np.int16)  # the anchor's own string is the right side's begin
    lo, hi = found["lo"].astype(np.int64), found["hi"].astype(np.int64)
    for k, raw in enumerate(contexts):
        x = np.frombuffer(raw, np.uint8).astype(np.int16) + 1
        a = lo[k]
        left[k, :a] = x[:a][::-1]
        right[k, : len(x) - a] = x[a:]
    r_order, r_shared, l_order, l_shared = _sides(found["gram"], left, right)
    far, near = np.full(n, -1), np.full(n, length)
    for o in range(span + 1):  # windows that start o bytes before their anchors
        own = np.flatnonzero((hi <= o) & (o <= lo))
        if len(own) < 2:
            continue
        l_id, r_id = np.empty(n, np.int64), np.empty(n, np.int64)
        l_id[l_order], r_id[r_order] = np.cumsum(l_shared < o), np.cumsum(r_shared < length - o)
        _, first, back = np.unique(l_id[own] * (n + 1) + r_id[own], return_index=True, return_inverse=True)
        at = own[first[back]]
        later = own[(found["doc"][own] != found["doc"][at]) | (found["pos"][own] != found["pos"][at])]
        far[later], near[later] = np.maximum(far[later], o), np.minimum(near[later], o)
    hit = np.flatnonzero(far >= 0)
    return found[hit], found["pos"][hit] - far[hit], found["pos"][hit] - near[hit] + length


ROWS = "doc long, sub long, gram long, a long, b long, lo int, hi int"
NULL_ID = -(2**63)


def _spans(rows: np.ndarray, length: int) -> pd.DataFrame:
    """Covered rows: [a, b) is the union of the anchor's windows; gram is null."""
    return pd.DataFrame({"doc": rows["doc"], "sub": rows["sub"], "gram": pd.array([None] * len(rows), "Int64"), "a": rows["pos"] - rows["lo"], "b": rows["pos"] - rows["hi"] + length, "lo": 0, "hi": 0})


def _changes(x: np.ndarray) -> np.ndarray:
    """Where a class begins in x, sorted by class."""
    return np.r_[True, (x["cls"][1:] != x["cls"][:-1]) | (x["cls2"][1:] != x["cls2"][:-1])][: len(x)]


def _first_of_class(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x by class, document and place; whether each row is an earliest of its class."""
    x = x[np.lexsort((x["pos"], x["doc"], x["cls2"], x["cls"]))]
    new = _changes(x)
    first = x[new][np.cumsum(new) - 1] if len(x) else x
    return x, (x["doc"] == first["doc"]) & (x["pos"] == first["pos"])


def _dealt(buckets: int, length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            parts = []
            for doc, sub, text in zip(rows["doc"], rows["sub"], rows["text"], strict=True):
                gram, context, context2, place, lo, hi = anchors(text.encode("utf-8", "surrogatepass"), length)
                own = np.empty(len(gram), ANCHOR)
                own["gram"], own["cls"], own["cls2"], own["pos"], own["lo"], own["hi"] = gram, _mix(gram * _BASE + context), context2, place, lo, hi
                own["doc"], own["sub"] = doc, sub
                parts.append(own)
            x, first = _first_of_class(np.concatenate(parts) if parts else np.empty(0, ANCHOR))
            to = (x["gram"] % np.uint64(buckets)).astype(np.int64)
            by = np.lexsort((~first, to))
            edges = np.searchsorted(to[by] * 2 + ~first[by], np.arange(2 * buckets + 1))
            x = x[by]
            out = [(k // 2, k % 2 == 1, x[a:b].tobytes()) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]
            yield pd.DataFrame(out, columns=["bucket", "done", "blob"])

    return run


def _classed(length: int):
    """Gathers a task's buckets; gives covered intervals, and the earliest anchors of strings with several classes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = []
        for rows in batches:
            for done, blob in zip(rows["done"], rows["blob"], strict=True):
                x = np.frombuffer(blob, ANCHOR)
                if done:
                    yield _spans(x, length)
                else:
                    parts.append(x)
        if not parts:
            return
        x, first = _first_of_class(np.concatenate(parts))
        del parts
        yield _spans(x[~first], length)
        x = x[first]
        _, back = np.unique(x["gram"], return_inverse=True)
        order = np.lexsort((x["cls2"], x["cls"], back))
        x, back = x[order], back[order]
        more = np.bincount(back, weights=_changes(x)) if len(x) else np.empty(0)
        x = x[more[back] > 1]
        for k in range(0, len(x), 1 << 18):
            y = x[k : k + (1 << 18)]
            yield pd.DataFrame({"doc": y["doc"], "sub": y["sub"], "gram": pd.array(y["gram"].copy().view(np.int64), "Int64"), "a": y["pos"], "b": 0, "lo": y["lo"], "hi": y["hi"]})

    return run


def _fetched(buckets: int, length: int):
    """Contexts of each document's anchors, dealt by string: a row for each bucket and batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            heads, contexts = [], []
            for doc, sub, text, found in zip(rows["doc"], rows["sub"], rows["text"], rows["found"], strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                own = np.zeros(len(found), ANCHOR)
                for name, key in (("gram", "gram"), ("pos", "a"), ("lo", "lo"), ("hi", "hi")):
                    own[name] = np.array([f[key] for f in found], np.int64).astype(ANCHOR[name])  # wraps to unsigned
                own["doc"], own["sub"] = doc, sub
                heads.append(own)
                contexts += [raw[p - a : p - b + length] for p, a, b in zip(own["pos"].tolist(), own["lo"].tolist(), own["hi"].tolist(), strict=True)]
            if not heads:
                continue
            x = np.concatenate(heads)
            to = (x["gram"] % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(to, kind="stable")
            edges = np.searchsorted(to[by], np.arange(buckets + 1))
            out = [(k, x[by[a:b]].tobytes(), b"".join(contexts[i] for i in by[a:b])) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if b > a]
            yield pd.DataFrame(out, columns=["bucket", "blob", "contexts"])

    return run


def _searched(length: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        heads, contexts = [], []
        for rows in batches:
            for blob, text in zip(rows["blob"], rows["contexts"], strict=True):
                x = np.frombuffer(blob, ANCHOR)
                heads.append(x)
                ends = np.cumsum(x["lo"].astype(np.int64) - x["hi"] + length).tolist()
                contexts += [text[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        if not heads:
            return
        x = np.concatenate(heads)
        # whole strings at a time, so that one suffix array has about 20 000 contexts
        order = np.argsort(x["gram"], kind="stable")
        x = x[order]
        starts = np.flatnonzero(np.r_[True, x["gram"][1:] != x["gram"][:-1]])
        cuts = [0]
        for s in starts.tolist():
            if s - cuts[-1] >= 20_000:
                cuts.append(s)
        for a, b in zip(cuts, [*cuts[1:], len(x)], strict=True):
            rows, low, high = covered(x[a:b], [contexts[i] for i in order[a:b]], length)
            yield pd.DataFrame({"doc": rows["doc"], "sub": rows["sub"], "a": low, "b": high})

    return run


def _windows(length: int):
    """A row for each window of the anchors found in each document: its digest, its start and its anchor."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for doc, sub, text, found in zip(rows["doc"], rows["sub"], rows["text"], rows["found"], strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                for f in found:
                    for start in range(f["a"] - f["lo"], f["a"] - f["hi"] + 1):
                        digest = xxhash.xxh3_128_intdigest(raw[start : start + length])
                        out.append(((digest >> 64) - 2**63, (digest & (2**64 - 1)) - 2**63, doc, sub, f["a"], start))
            yield pd.DataFrame(out, columns=["h1", "h2", "doc", "sub", "anchor", "start"])

    return run


def _crowded_spans(rows: DataFrame, anchors_: DataFrame, length: int) -> DataFrame:
    """doc, sub, a and b of the covered windows of anchors(doc, sub, gram, a, lo, hi): one interval for each anchor, as its windows overlap."""
    found = anchors_.groupBy("doc", "sub").agg(F.collect_list(F.struct("a", "lo", "hi")).alias("found"))
    windows = materialize(rows.join(found, ["doc", "sub"]).select("doc", "sub", "text", "found").mapInPandas(_windows(length), "h1 long, h2 long, doc long, sub long, anchor long, start long"), "windows")
    first = windows.groupBy("h1", "h2").agg(F.min(F.struct("doc", "start")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    later = windows.join(first, ["h1", "h2"]).filter("doc <> first.doc or start <> first.start")
    return later.groupBy("doc", "sub", "anchor").agg(F.min("start").alias("a"), (F.max("start") + length).alias("b")).drop("anchor")


def merged(spans: list, n: int) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["a"], min(s["b"], n)) for s in spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    """row (all columns of docs), doc (the id; the least number for null) and sub, which tells the texts of a repeated id apart."""
    rows = docs.select(F.struct("*").alias("row")).withColumn("doc", F.coalesce(F.col("row.doc_id").cast("long"), F.lit(NULL_ID)))
    twice = rows.groupBy("doc").count().filter("count > 1")
    return rows.withColumn("sub", F.lit(0).cast("long") if twice.isEmpty() else F.xxhash64(_text()))


def _text() -> Column:
    return F.coalesce(F.col("row.text").cast("string"), F.lit(""))


def repeated_spans(rows: DataFrame, length: int, crowded: int = CROWDED) -> DataFrame:
    """doc, sub and spans (a, b), not yet merged, for the rows(doc, sub, text) that have any."""
    buckets = max(8, 4 * rows.rdd.getNumPartitions())
    dealt = rows.mapInPandas(released(_dealt(buckets, length)), "bucket int, done boolean, blob binary")
    classed = materialize(dealt.repartition(buckets, "bucket").mapInPandas(released(_classed(length)), ROWS), "classed")
    wanted, spans = classed.filter("gram is not null"), classed.filter("gram is null").select("doc", "sub", "a", "b")
    full = materialize(wanted.groupBy("gram").count().filter(F.col("count") > crowded).select("gram"), "crowded")
    if not full.isEmpty():
        spans = spans.unionByName(_crowded_spans(rows, wanted.join(full, "gram", "left_semi"), length))
        wanted = wanted.join(full, "gram", "left_anti")
    wanted = wanted.groupBy("doc", "sub").agg(F.collect_list(F.struct("gram", "a", "lo", "hi")).alias("found"))
    fetched = rows.join(wanted, ["doc", "sub"]).select("doc", "sub", "text", "found").mapInPandas(released(_fetched(buckets, length)), "bucket int, blob binary, contexts binary")
    searched = materialize(fetched.repartition(buckets, "bucket").mapInPandas(released(_searched(length)), "doc long, sub long, a long, b long"), "searched")
    return spans.unionByName(searched).groupBy("doc", "sub").agg(F.collect_list(F.struct("a", "b")).alias("spans"))


def suffix_dedup(docs: DataFrame, *, length: int = LENGTH, crowded: int = CROWDED) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 for each row of docs(doc_id, text).

    A null text counts as empty; a null doc_id is smaller than all others; rows that share a doc_id are one
    document for what is earlier, and equal places of theirs are not earlier than each other. Other columns
    are ignored; an empty table gives no rows.
    """
    small_batches(docs.sparkSession, size=8 << 20)
    rows = _keyed(docs.select("doc_id", "text")).select("doc", "sub", _text().alias("text"))
    spans = repeated_spans(rows, length, crowded)

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            out = []
            for doc, text, found in zip(part["doc"], part["text"], part["spans"], strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                cuts = merged(found, len(raw)) if found is not None else []
                out.append((None if doc == NULL_ID else doc, len(raw), sum(b - a for a, b in cuts), len(cuts), hashlib.sha256(_kept(raw, cuts)).hexdigest()))
            yield pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]).astype({"doc_id": "Int64"})

    return rows.join(spans, ["doc", "sub"], "left").select("doc", "text", "spans").mapInPandas(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _kept(raw: bytes, cuts: list[tuple[int, int]]) -> bytes:
    return b"".join(raw[a:b] for a, b in zip([0] + [b for _, b in cuts], [a for a, _ in cuts] + [len(raw)], strict=True))


def without_repeats(docs: DataFrame, *, length: int = LENGTH) -> DataFrame:
    """docs with the repeated bytes cut from each text; bytes of characters that a cut leaves in parts go too. Nulls and other columns, whatever their names, stay."""
    small_batches(docs.sparkSession, size=8 << 20)
    keyed = _keyed(docs)
    spans = repeated_spans(keyed.select("doc", "sub", _text().alias("text")), length)

    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        raws = [t.encode("utf-8", "surrogatepass") for t in text]
        return pd.Series([_kept(r, merged(s, len(r))).decode("utf-8", "ignore") for r, s in zip(raws, spans, strict=True)])

    joined = keyed.join(spans, ["doc", "sub"], "left")
    plain, changed = joined.filter("spans is null"), joined.filter("spans is not null").withColumn("row", F.col("row").withField("text", cut(_text(), "spans")))
    return plain.select("row.*").unionByName(changed.select("row.*"))
