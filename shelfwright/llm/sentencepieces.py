"""SentencePiece encoding and decoding by suffix-array matching.

A batch's distinct chunks (runs of blanks with the word behind them; this vocabulary's pieces never cross
into the next blanks) are put into one text. Its suffixes are sorted by as many bytes as the longest piece
has, every piece is searched for by bisection, and the ranges found become edges (place, piece), sorted by
place. Each chunk is then relaxed over its edges: of the neighbours that an edge spans, the best-scored pair
merges first, leftmost among equals, until no edge joins two neighbours. Chunks of the same number of
characters are relaxed together, a merge for each of them in a round; chunks over LONG characters one by one
with a heap. What no piece covers falls to bytes.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches

MODEL = "piece_bpe_32k.model"
BLANK = "▁"
#: Chunks whose ids a worker keeps, and bytes of one suffix array (a longer chunk has one of its own).
CACHE_CHUNKS, ARRAY_BYTES = 1_000_000, 1 << 19
#: Characters above which a chunk is relaxed by itself.
LONG = 48
#: Stands for no piece among ranks.
NONE = np.iinfo(np.int32).max
_CHUNK = re.compile(f"{BLANK}+[^{BLANK}\n]*|\n|[^{BLANK}\n]+")


class Pieces:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.byte = {int(model.id_to_piece(i)[1:-1], 16): i for i in range(n) if model.is_byte(i)}
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        self.raw = [model.id_to_piece(i).encode() for i in range(n)]
        self.score = [model.get_score(i) for i in range(n)]
        self.longest = max(len(self.raw[i]) for i in plain)
        by = sorted(plain, key=lambda i: self.raw[i])
        self.ids, kind = np.array(by), f"S{self.longest}"
        self.low = np.array([self.raw[i] for i in by], kind)
        self.high = np.array([self.raw[i] + b"\xff" * (self.longest - len(self.raw[i])) for i in by], kind)
        self.lengths = np.array([len(self.raw[i]) for i in by])
        self.n_chars = np.array([len(self.raw[i].decode()) for i in by])
        # pieces by score: equal scores have equal ranks, and what tells them apart is their string
        _, ranks = np.unique([-self.score[i] for i in by], return_inverse=True)
        self.ranks = ranks.astype(np.int32)
        out = [r.replace(BLANK.encode(), b" ") for r in self.raw]
        for b, i in self.byte.items():
            out[i] = bytes([b])
        for i in set(range(n)) - set(plain) - set(self.byte.values()):
            out[i] = b""
        self.out, self.known = out, {}

    def edges(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The pieces that stand in text, as places and numbers of pieces, sorted by place."""
        x = np.frombuffer(text + b"\0" * self.longest, np.uint8)
        keys = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(x, self.longest)[: len(text)]).view(f"S{self.longest}").ravel()
        array = np.argsort(keys, kind="stable")
        keys = keys[array]
        low, high = np.searchsorted(keys, self.low, "left"), np.searchsorted(keys, self.high, "right")
        times = high - low
        at = array[np.repeat(low - np.r_[0, np.cumsum(times)[:-1]], times) + np.arange(times.sum())]
        piece = np.repeat(np.arange(len(times)), times)
        order = np.argsort(at, kind="stable")
        return at[order], piece[order]

    def relax(self, text: bytes, edges: dict[tuple[int, int], int]) -> list[int]:
        """Ids of one chunk; edges: (start, end) in bytes and the piece's number."""
        bounds = [k for k in range(len(text)) if text[k] & 0xC0 != 0x80] + [len(text)]
        n = len(bounds) - 1
        after, before, stop = list(range(1, n + 1)), list(range(-1, n - 1)), bounds[1:]
        heap: list[tuple[int, int, int]] = []

        def offer(k: int) -> None:
            r = after[k]
            if r < n:
                piece = edges.get((bounds[k], stop[r]))
                if piece is not None:
                    heapq.heappush(heap, (int(self.ranks[piece]), k, stop[r]))

        for k in range(n):
            offer(k)
        alive = [True] * n
        while heap:
            _, k, to = heapq.heappop(heap)
            r = after[k] if alive[k] else n
            if r >= n or stop[r] != to or not alive[r]:
                continue
            alive[r], stop[k], after[k] = False, to, after[r]
            if after[k] < n:
                before[after[k]] = k
            offer(k)
            if before[k] >= 0:
                offer(before[k])
        ids, k = [], 0
        while k < n:
            piece = edges.get((bounds[k], stop[k]))
            ids += [int(self.ids[piece])] if piece is not None else [self.byte[b] for b in text[bounds[k] : stop[k]]]
            k = after[k]
        return ids

    def relax_all(self, chunks: list[str], n: int, table: np.ndarray, width: int, first: np.ndarray) -> list[bytes]:
        """Ids of chunks of n characters each. table[first + start * width + length - 1] is the piece there, in characters, or -1."""
        out: list[bytes] = [b""] * len(chunks)
        rows, starts = np.arange(len(chunks)), np.broadcast_to(np.arange(n + 1), (len(chunks), n + 1))
        ranks = np.append(self.ranks, NONE)  # the last one is for no piece
        while len(rows):
            k = starts.shape[1] - 1  # symbols of each chunk
            best, pair = np.full(len(rows), NONE), np.zeros(len(rows), int)
            if k > 1:
                length = starts[:, 2:] - starts[:, :-2]
                at = first[rows, None] + starts[:, :-2] * width + np.minimum(length, width) - 1
                rank = np.where(length <= width, ranks[table[at]], NONE)
                pair = rank.argmin(axis=1)  # the leftmost of the best
                best = rank[np.arange(len(rows)), pair]
            done = best == NONE
            if done.any():
                own, cuts = rows[done], starts[done]
                length = cuts[:, 1:] - cuts[:, :-1]
                piece = np.where(length <= width, table[first[own, None] + cuts[:, :-1] * width + np.minimum(length, width) - 1], -1)
                ids = self.ids.astype("<u4")[piece]
                for r, bare, row, found in zip(own.tolist(), (piece < 0).any(axis=1).tolist(), ids, piece, strict=True):
                    if bare:  # only single characters have no piece
                        parts = [[i] if p >= 0 else [self.byte[b] for b in chunks[r][c].encode("utf-8", "replace")] for i, p, c in zip(row.tolist(), found.tolist(), cuts[own == r][0].tolist(), strict=False)]
                        out[r] = np.array([i for part in parts for i in part], "<u4").tobytes()
                    else:
                        out[r] = row.tobytes()
                rows, starts, pair = rows[~done], starts[~done], pair[~done]
            if len(rows):
                keep = np.ones(starts.shape, bool)
                keep[np.arange(len(rows)), pair + 1] = False
                starts = starts[keep].reshape(len(rows), k)
        return out

    def learn(self, chunks: list[str]) -> None:
        parts, size = [[]], 0
        for c in chunks:
            if size > ARRAY_BYTES:
                parts.append([])
                size = 0
            parts[-1].append(c)
            size += 3 * len(c) + 1
        for part in filter(None, parts):
            self._learn(part)

    def _learn(self, chunks: list[str]) -> None:
        raw = [c.encode("utf-8", "replace") for c in chunks]
        text = b"\0".join(raw)
        at, piece = self.edges(text)
        ends = np.cumsum([len(r) + 1 for r in raw])
        begins = np.r_[0, ends[:-1]]
        n = np.array([len(c) for c in chunks])
        # places in characters: those of a chunk count from its first
        lead = np.cumsum(np.frombuffer(text + b"\0", np.uint8) & 0xC0 != 0x80) - 1
        owner = np.searchsorted(ends, at, "right")
        short = n <= LONG
        width = np.minimum(n, int(self.n_chars.max()))
        first = np.r_[0, np.cumsum(np.where(short, n * width, 0))]
        table = np.full(int(first[-1]) + 1, -1, np.int32)
        fits = short[owner]
        own = owner[fits]
        table[first[own] + (lead[at[fits]] - lead[begins[own]]) * width[own] + self.n_chars[piece[fits]] - 1] = piece[fits]
        for k in np.unique(n[short]).tolist():
            of = np.flatnonzero(n == k)
            same = [chunks[i] for i in of.tolist()]
            self.known.update(zip(same, self.relax_all(same, k, table, int(width[of[0]]), first[of]), strict=True))
        for i in np.flatnonzero(~short).tolist():
            a, b = np.searchsorted(owner, [i, i + 1])
            edges = {(s, s + m): p for s, m, p in zip((at[a:b] - begins[i]).tolist(), self.lengths[piece[a:b]].tolist(), piece[a:b].tolist(), strict=True)}
            self.known[chunks[i]] = np.array(self.relax(raw[i], edges), "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit bytes; none for an empty text."""
        split = [_CHUNK.findall(BLANK + t.replace(" ", BLANK)) if t else [] for t in texts]
        if len(self.known) > CACHE_CHUNKS:
            self.known.clear()
        self.learn(list(set().union(*split) - self.known.keys()))
        return [b"".join(map(self.known.__getitem__, s)) for s in split]

    def decode(self, ids: bytes) -> str:
        """The text of ids, without the blank that encoding puts first."""
        text = b"".join(map(self.out.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_pieces: dict[str, Pieces] = {}


def pieces_of(model: str = MODEL) -> Pieces:
    """One for each worker process, kept between tasks."""
    if model not in _pieces:
        import public_tokenizers

        _pieces[model] = Pieces(public_tokenizers.path(model))
    return _pieces[model]


def encode_pieces(docs: DataFrame, *, model: str = MODEL) -> DataFrame:
    """doc_id, ids, n_pieces, ids_crc32 and round_trip for each row of docs(doc_id, text).

    A null text counts as empty and has no ids; round_trip tells whether decoding gives the text again (the
    blank sign itself counts as a blank). Repeated rows give a row each; other columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = pieces_of(model)
        for rows in batches:
            texts = [t or "" for t in rows["text"]]
            ids = pieces.encode(texts)
            same = [pieces.decode(x) == t.replace(BLANK, " ") for x, t in zip(ids, texts, strict=True)]
            yield pd.DataFrame({"doc_id": rows["doc_id"], "ids": ids, "n_pieces": [len(x) // 4 for x in ids], "ids_crc32": [zlib.crc32(x) for x in ids], "round_trip": same})

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(run, "doc_id long, ids binary, n_pieces long, ids_crc32 long, round_trip boolean")
