"""Best-fit packing of tokenized documents into sequences, certified by lower bounds.

Documents become pieces of at most `size` tokens. Pieces are dealt to shards; each shard is packed by
best-fit decreasing and its bin count is held against a lower bound from dual-feasible functions. Shards
whose count is above their bound exchange: what lies in their bins with room is pooled, dealt anew over as
many shards as the pool needs and packed again, and the new packing stands where it needs fewer bins in all.
Their full bins stay, and are certified: no packing of what they hold needs fewer.
"""

from __future__ import annotations

import math
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, small_batches

TOKENIZER = "word_bpe_49k.json"
#: Words whose ids a worker keeps; above it the words are forgotten and found again.
CACHE_WORDS = 300_000
#: Pieces that a shard has on average.
SHARD_PIECES = 100_000
#: A full stop or comma after a letter at the end of a word is a token of its own.
_MARK = re.compile(r"(?<=[A-Za-zÀ-ÖØ-öø-ÿ])(?=[.,](?:[ \t\n\r\f\v]|$))")


class WordEncoder:
    """Ids of texts as little-endian 32-bit bytes, word by word: this tokenizer's pieces never cross white space.

    A text that holds the start of a special token's string goes to the tokenizer as a whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}

    def learn(self, words: list[bytes]) -> None:
        for k in range(0, len(words), 20_000):
            part = [w.decode("utf-8", "replace") for w in words[k : k + 20_000]]
            got = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            starts = np.cumsum([0] + [len(w) + 1 for w in part])
            ids = np.array(got.ids, "<u4")
            ends = np.searchsorted([a for a, _ in got.offsets], starts) if len(ids) else np.zeros(len(part) + 1, int)
            self.known.update((w, ids[a:b].tobytes()) for w, a, b in zip(words[k : k + 20_000], ends[:-1], ends[1:], strict=True))

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [None if "<|" in t else _MARK.sub(" ", t).encode("utf-8", "replace").lower().split() for t in texts]
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        new = set().union(*(w for w in split if w is not None)) - self.known.keys()
        self.learn(list(new))
        whole = lambda t: np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
        return [whole(t) if w is None else b"".join(map(self.known.__getitem__, w)) for t, w in zip(texts, split, strict=True)]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One for each worker process, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, size: int, tokenizer: str) -> DataFrame:
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(tokenizer_path(tokenizer)).encode
        for rows in batches:
            out = []
            for doc, ids in zip(rows["doc_id"], encode([t or "" for t in rows["text"]]), strict=True):
                ids += b"\0\0\0\0"
                for k in range(0, len(ids), 4 * size):
                    part = ids[k : k + 4 * size]
                    out.append((doc, k // (4 * size), k // 4, len(part) // 4, zlib.crc32(part)))
            yield pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"]).astype({"doc_id": "Int64"})

    small_batches(docs.sparkSession, size=8 << 20)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(cut, PIECES)


def lower_bound(lengths: np.ndarray, size: int) -> int:
    """Bins that these lengths need at least: the best of dual-feasible functions.

    Threshold functions (over size - t counts as size, under t as 0), alone and after rounding functions
    with k steps, all on the histogram of lengths.
    """
    times = np.bincount(lengths, minlength=size + 1).astype(np.int64)
    x = np.arange(size + 1, dtype=np.int64)
    best = -(-int((times * x).sum()) // size)
    # threshold t: pieces over size - t alone, and what lies between as it is
    count_up, sum_up = np.cumsum(times), np.cumsum(times * x)
    for t in range(1, size // 2 + 1):
        alone = count_up[size] - count_up[size - t]
        between = sum_up[size - t] - sum_up[t - 1]
        best = max(best, int(alone) + -(-int(between) // size))
    for k in range(1, 21):
        steps = (k + 1) * x
        value = np.where(steps % size == 0, x * k, (steps // size) * size)  # times k
        best = max(best, -(-int((times * value).sum()) // (k * size)))
    return best


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Best-fit decreasing: the bin and the offset of each length. Bins with the same room are told by a bit set of rooms."""
    order = np.argsort(-lengths, kind="stable")
    room: list[list[int]] = [[] for _ in range(size + 1)]
    bins, offsets, open_rooms, made = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0, 0
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = open_rooms >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                open_rooms ^= 1 << r
        else:
            r, b, made = size, made, made + 1
        bins[i], offsets[i] = b, size - r
        if r > n:
            if not room[r - n]:
                open_rooms |= 1 << (r - n)
            room[r - n].append(b)
    return bins, offsets


def _pack(items: DataFrame, size: int) -> DataFrame:
    """items(doc_id, piece, start, length, ids_crc32, shard) with bin, offset, whether the bin is full, and the shard's bins, full bins and bound.

    Pieces of equal length are taken by id, piece and ids, so that the packing doesn't hang on the order of rows.
    """

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "piece", "ids_crc32"], kind="stable")
        lengths = rows["length"].to_numpy(np.int64)
        bins, offsets = best_fit(lengths, size)
        full = np.bincount(bins, lengths).astype(np.int64) == size
        return rows.assign(bin=bins, offset=offsets, full=full[bins], bins=len(full), full_bins=int(full.sum()), bound=lower_bound(lengths, size))

    return items.groupBy("shard").applyInPandas(pack, f"{PIECES}, shard long, bin long, offset long, full boolean, bins long, full_bins long, bound long")


def best_fit_packing(docs: DataFrame, *, size: int = 2048, tokenizer: str = TOKENIZER, shard_pieces: int = SHARD_PIECES, exchanges: int = 3) -> DataFrame:
    """Packs docs(doc_id, text): a row for each piece with its place.

    A null text counts as empty and is the piece [0]; repeated rows are packed each; a null doc_id stays
    null; other columns are ignored; an empty table gives no rows. sequence_id has the shard in its upper
    32 bits, and the round of the exchange above these.
    """
    held = materialize(pieces(docs, size, tokenizer), "pieces")
    shards = max(1, math.ceil(held.count() / shard_pieces))
    deal = lambda df, n, salt: df.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(salt)), F.lit(n)))
    packed = materialize(_pack(deal(held, shards, 0), size), "packed").withColumn("round", F.lit(0))
    done, now = [], packed
    gap = F.col("bins") > F.col("bound")
    for turn in range(1, exchanges + 1):
        state = now.filter(gap).groupBy("shard").agg(F.first("bins").alias("bins"), F.first("full_bins").alias("full"), F.count(F.when(~F.col("full"), 1)).alias("pool")).agg(F.count("*").alias("n"), F.sum(F.col("bins") - F.col("full")).alias("open"), F.sum("pool").alias("pool")).first()
        if state["n"] < 2:
            break
        pool = now.filter(gap & ~F.col("full")).select(*held.columns)
        again = materialize(_pack(deal(pool, math.ceil(state["pool"] / shard_pieces), turn), size), "repacked").withColumn("round", F.lit(turn))
        need = again.groupBy("shard").agg(F.first("bins").alias("bins")).agg(F.sum("bins")).first()[0]
        if need >= state["open"]:
            break
        done += [now.filter(~gap), now.filter(gap & F.col("full")).withColumn("bins", F.col("full_bins")).withColumn("bound", F.col("full_bins"))]
        now = again
    for part in done:
        now = now.unionByName(part)
    sequence = F.shiftleft(F.col("round").cast("long"), 56) + F.shiftleft(F.col("shard"), 32) + F.col("bin")
    return now.select("doc_id", "piece", "start", "length", "ids_crc32", sequence.alias("sequence_id"), "offset", F.col("bins").alias("shard_bins"), F.col("bound").alias("shard_bound"))
