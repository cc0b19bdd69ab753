"""Token ids of documents in bit-packed binary files, as a Spark data source.

A folder holds one file for each task that wrote ids, and manifest.json, which is written last and names them in
order of documents with their first id's place. Files of tasks that failed or ran twice aren't named there.

A file, all numbers little-endian: MAGIC; blocks of `block` ids, each id in `bits` bits (lowest first), so that a
block ends at a byte; then the index: doc_id int64 of each document, a byte that is 1 where doc_id is null, the ids
of each document as uint64, the offset of each block and of their end as uint64; then the footer. Id i of a file
lies in block i // block, so a document is read by its blocks alone.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from ..sources.folders import checkpoint_folder
from .packing import tokenizer_path
from .shared import small_batches

TOKENIZER, END = "byte_bpe_50k.json", 2
MAGIC = b"packids1"
#: documents, ids, place of the index, bits of an id, ids of a block
FOOTER = struct.Struct("<QQQII8s")
#: Ids of a block: a multiple of 8.
BLOCK = 1 << 14
#: Chunks whose ids a worker keeps, and their longest; above the first the later half is forgotten and found again.
CACHE_CHUNKS, CACHE_LENGTH = 800_000, 64
#: Ids that the reader gives in a batch, unless one document has more.
READ_IDS = 1 << 20


def vocabulary_bits(size: int) -> int:
    """The fewest bits that tell `size` ids."""
    return max(1, (size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    each = np.unpackbits(ids.astype("<u4").view(np.uint8).reshape(len(ids), 4), axis=1, bitorder="little")
    return np.packbits(each[:, :bits], bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", n).astype("<u4")
    each = np.zeros((n, 32), np.uint8)
    each[:, :bits] = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return np.packbits(each, axis=1, bitorder="little").view("<u4").ravel()


# Before these bytes' spaces, and behind them, white space may stand: its last and first bytes in UTF-8, and more.
_BEFORE, _BEHIND = np.zeros(256, bool), np.zeros(256, bool)
_BEFORE[[*range(9, 14), *range(28, 33), *range(0x80, 0x8B), 0x9A, 0x9F, 0xA0, 0xA8, 0xA9, 0xAF]] = True
_BEHIND[[*range(9, 14), *range(28, 33), 0xC2, 0xE1, 0xE2, 0xE3]] = True
_CUT = re.compile(r"(?<=\S)(?= )|(?<=\s)(?= \S)")
# A full stop or comma after a letter at a word's end, and a line feed alone, are pieces; so what follows has no leading space.
_MARK, _LINE, BARE = re.compile(r"[.,](?<=[A-Za-z].)(?=[ \n]|\Z)"), re.compile(r"\n(?<=\S\n)(?=\S)"), "\0"


class ChunkEncoder:
    """Ids of texts as little-endian 32-bit bytes, chunk by chunk: a byte-level tokenizer of this kind always begins a piece at a space that stands behind other than white space, or as the last of a run of it.

    A text that holds the start of a special token's string goes to the tokenizer as a whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {}
        self.bits = vocabulary_bits(self.tokenizer.get_vocab_size())
        # ids of tokens that begin with a space, of which a chunk behind one has exactly one
        self.begins = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.begins[[k for x, k in self.tokenizer.get_vocab().items() if x[0] == "\u0120"]] = True

    def wholes(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def split(self, text: str) -> list[str]:
        """Chunks of the text, the first behind BARE, the others without their leading spaces or behind BARE if they have none."""
        raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
        odd = (_BEFORE[raw[:-2]] & (raw[1:-1] == 32) & _BEHIND[raw[2:]]).any() if len(raw) > 2 else True
        if odd or text[-1] == " " or text[0] == " ":
            first, *rest = _CUT.split(text)
            return [BARE + first, *(x[1:] for x in rest)]
        return (BARE + _LINE.sub(" \0\n \0", _MARK.sub(" \0\\g<0>", text))).split(" ")

    def learn(self, chunks: list[str]) -> list[str]:
        """Puts the chunks' ids into `known`; returns the chunks that are too long to stay there."""
        plain = [x for x in chunks if x and x[0] != BARE and len(x) <= CACHE_LENGTH and " " not in x and not x[0].isspace() and not x[-1].isspace()]
        for k in range(0, len(plain), 20_000):
            part = plain[k : k + 20_000]
            ids = np.frombuffer(self.wholes([" " + " ".join(part)])[0], "<u4")
            starts = np.append(np.flatnonzero(self.begins[ids]), len(ids)).tolist()
            self.known.update((x, ids[a:b].tobytes()) for x, a, b in zip(part, starts[:-1], starts[1:], strict=True))
        rest = [x for x in chunks if x not in self.known]
        self.known.update(zip(rest, self.wholes([x[1:] if x[:1] == BARE else " " + x for x in rest]), strict=True))
        return [x for x in rest if len(x) > CACHE_LENGTH]

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [None if "<|" in t or BARE in t else self.split(t) if t else [] for t in texts]
        if len(self.known) > CACHE_CHUNKS:
            self.known = dict(islice(self.known.items(), CACHE_CHUNKS // 2))
        long = self.learn(list(set().union(*filter(None, split)) - self.known.keys()))
        out = [self.wholes([t])[0] if s is None else b"".join(map(self.known.__getitem__, s)) for t, s in zip(texts, split, strict=True)]
        for x in long:
            del self.known[x]
        return out


_encoders: dict[str, ChunkEncoder] = {}


def encoder(name: str) -> ChunkEncoder:
    """One for each worker process."""
    if name not in _encoders:
        _encoders[name] = ChunkEncoder(tokenizer_path(name))
    return _encoders[name]


def _store(path: str) -> tuple[pa.fs.FileSystem, str]:
    from pyarrow import fs

    store, inside = fs.FileSystem.from_uri(path)
    return store, inside.rstrip("/")


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote; low and high are its first and last doc_id, null ones left out."""

    task: int
    name: str
    docs: int
    ids: int
    low: int | None
    high: int | None


class Writer(DataSourceArrowWriter):
    """Writes rows (doc_id, text) in the order in which they come, a file for each task."""

    def __init__(self, options: dict):
        self.path, self.tokenizer, self.end, self.block = options["path"], options.get("tokenizer", TOKENIZER), int(options.get("end", END)), int(options.get("block", BLOCK))

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        store, folder = _store(self.path)
        store.create_dir(folder)
        task, code = TaskContext.get().partitionId(), encoder(self.tokenizer)
        name, doc_ids, sizes, offsets, rest, n = f"{task:06d}-{uuid.uuid4().hex}.ids", [], [], [], np.empty(0, "<u4"), 0
        with store.open_output_stream(f"{folder}/{name}") as out:
            out.write(MAGIC)
            for rows in batches:
                coded = code.encode([t or "" for t in rows.column("text").to_pylist()])
                end = np.array([self.end], "<u4").tobytes()
                doc_ids += rows.column("doc_id").to_pylist()
                sizes += [len(x) // 4 + 1 for x in coded]
                rest = np.concatenate([rest, np.frombuffer(end.join([*coded, b""]), "<u4")])
                full = len(rest) // self.block * self.block
                for k in range(0, full, self.block):
                    offsets.append(out.tell())
                    out.write(pack(rest[k : k + self.block], code.bits))
                n, rest = n + full, rest[full:].copy()
            if len(rest):
                offsets.append(out.tell())
                out.write(pack(rest, code.bits))
                n += len(rest)
            offsets.append(index := out.tell())
            out.write(np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes() + bytes(d is None for d in doc_ids) + np.array(sizes, "<u8").tobytes())
            out.write(np.array(offsets, "<u8").tobytes() + FOOTER.pack(len(doc_ids), n, index, code.bits, self.block, MAGIC))
        held = [d for d in doc_ids if d is not None]
        return Written(task, name, len(doc_ids), n, min(held, default=None), max(held, default=None))

    def commit(self, messages: list[Written | None]) -> None:
        store, folder = _store(self.path)
        store.create_dir(folder)
        files, start = [], 0
        for m in sorted((m for m in messages if m and m.docs), key=lambda m: m.task):
            files.append({"name": m.name, "start": start, "docs": m.docs, "ids": m.ids, "low": m.low, "high": m.high})
            start += m.ids
        with store.open_output_stream(f"{folder}/manifest.json.new") as out:
            out.write(json.dumps({"files": files, "ids": start}).encode())
        store.move(f"{folder}/manifest.json.new", f"{folder}/manifest.json")

    def abort(self, messages: list[Written | None]) -> None:
        """Files without a manifest are no data."""


class PackedFile:
    """A file's index, and its ids by documents."""

    def __init__(self, store: pa.fs.FileSystem, path: str):
        self.file = store.open_input_file(path)
        size = self.file.size()
        tail = self.at(size - FOOTER.size, size)
        self.docs, self.ids, index, self.bits, self.block, magic = FOOTER.unpack(tail)
        if magic != MAGIC:
            raise ValueError(f"{path} is no file of packed ids")
        data = self.at(index, size - FOOTER.size)
        n = self.docs
        self.doc_ids = np.ma.masked_array(np.frombuffer(data, "<i8", n), np.frombuffer(data, np.uint8, n, 8 * n).astype(bool))
        self.starts = np.concatenate([[0], np.cumsum(np.frombuffer(data, "<u8", n, 9 * n).astype(np.int64))])
        self.offsets = np.frombuffer(data, "<u8", offset=17 * n).astype(np.int64)

    def at(self, begin: int, end: int) -> bytes:
        self.file.seek(begin)
        return self.file.read(end - begin)

    def read(self, begin: int, end: int) -> np.ndarray:
        """Ids [begin, end) of the file, from the blocks that hold them."""
        if begin == end:
            return np.empty(0, "<u4")
        first, last = begin // self.block, (end - 1) // self.block
        n = min(self.ids, (last + 1) * self.block) - first * self.block
        ids = unpack(self.at(int(self.offsets[first]), int(self.offsets[last + 1])), n, self.bits)
        return ids[begin - first * self.block : end - first * self.block]


@dataclass
class FilePart(InputPartition):
    name: str
    start: int


class Reader(DataSourceReader):
    """A row for each document. Option doc_ids, a list joined by commas: only these documents, from their blocks."""

    def __init__(self, options: dict):
        self.path, wanted = options["path"], options.get("doc_ids")
        self.wanted = None if wanted is None else [int(x) for x in wanted.split(",") if x]

    def partitions(self) -> list[FilePart]:
        store, folder = _store(self.path)
        with store.open_input_file(f"{folder}/manifest.json") as f:
            files = json.loads(f.read())["files"]
        holds = lambda f: self.wanted is None or f["low"] is not None and any(f["low"] <= x <= f["high"] for x in self.wanted)
        return [FilePart(f["name"], f["start"]) for f in files if holds(f)] or [FilePart("", 0)]

    def read(self, part: FilePart) -> Iterator[pa.RecordBatch]:
        if not part.name:
            return
        store, folder = _store(self.path)
        f = PackedFile(store, f"{folder}/{part.name}")
        keep = None if self.wanted is None else np.isin(f.doc_ids.data, self.wanted) & ~np.ma.getmaskarray(f.doc_ids)
        k = 0
        while k < f.docs:
            if keep is not None and not keep[k]:
                k += 1
                continue
            to = max(k + 1, int(np.searchsorted(f.starts, f.starts[k] + READ_IDS, "right")) - 1) if keep is None else k + 1
            ids = f.read(int(f.starts[k]), int(f.starts[to]))
            cuts = f.starts[k : to + 1] - f.starts[k]
            values = pa.LargeBinaryArray.from_buffers(pa.large_binary(), to - k, [None, pa.py_buffer((4 * cuts).astype("<i8").tobytes()), pa.py_buffer(np.ascontiguousarray(ids, "<u4").tobytes())])
            doc_ids = pa.array(f.doc_ids.data[k:to], mask=np.ma.getmaskarray(f.doc_ids)[k:to])
            yield pa.RecordBatch.from_arrays([doc_ids, pa.array(f.starts[k:to] + part.start), pa.array(np.diff(cuts)), values.cast(pa.binary())], ["doc_id", "start", "n_tokens", "ids"])
            k = to


class PackedIds(DataSource):
    """The format `packed_ids`: writes (doc_id, text), reads (doc_id, start, n_tokens, ids); ids are little-endian unsigned 32-bit numbers."""

    @classmethod
    def name(cls) -> str:
        return "packed_ids"

    def schema(self) -> str:
        return "doc_id long, start long, n_tokens long, ids binary"

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(dict(self.options))


def write_token_files(docs: DataFrame, path: str, *, tokenizer: str = TOKENIZER, end: int = END, block: int = BLOCK) -> None:
    """Writes the ids of docs(doc_id, text), an end id behind each document, in ascending order of doc_id (null first, equal ones by text).

    Documents are dealt by ranges of doc_id, so files follow each other; rows of one doc_id may lie in several.
    A null text counts as empty; an empty table gives a manifest without files; other columns are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark, rows=1000, size=8 << 20)
    spark.dataSource.register(PackedIds)
    order = ["doc_id", "_hash", "_tie"]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumns({"_hash": F.xxhash64("text"), "_tie": F.monotonically_increasing_id()})
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    ranged.write.format("packed_ids").options(tokenizer=tokenizer, end=end, block=block).mode("append").save(path)


def read_token_files(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the documents in a folder, or of a few of them; start counts the ids of all documents before."""
    spark.dataSource.register(PackedIds)
    read = spark.read.format("packed_ids")
    return (read if doc_ids is None else read.option("doc_ids", ",".join(map(str, doc_ids)))).load(path)


def token_file_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Writes docs' token files (to `path`, or into the checkpoint folder), reads them back and gives doc_id, start, n_tokens and ids_crc32 of each document."""
    path = path or f"{checkpoint_folder(docs.sparkSession)}/token-files-{uuid.uuid4().hex}"
    write_token_files(docs, path)
    return read_token_files(docs.sparkSession, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
