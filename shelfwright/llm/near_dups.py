"""Near-duplicate documents by banded MinHash, odd sketches and exact confirmation.

1. Each document's distinct shingles are hashed to 64 bits; `bands` x `rows` minima give the band keys, and
   the minima are folded into a parity bitmap (odd sketch).
2. Documents with the same set form an exact group; its smallest id stands for it.
3. The smallest id of a bucket (equal band key) is its hub. Each document is held against one hub, the
   smallest of its buckets: sizes, then the similarity that the XOR of the sketches estimates, then the full
   sets. The confirmed links make components.
4. In buckets that still hold several components, each document is held against one hub of each other
   component, in the same way.
5. Buckets that hold several components even then are chained into groups, these are cut into blocks, and
   every pair of blocks is searched by sketch, then on full sets, for links between different components. So
   no pair that shares a bucket goes unseen unless both are linked already.
With 40 bands of 6 rows a pair at similarity 0.8 shares no bucket once in 190 000 times.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize, released, small_batches

BANDS, ROWS, SKETCH_BITS = 40, 6, 1024
#: Documents of a block in step 5, and shingles of all of them, on average at most.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20
#: Parts that the documents of one hub are dealt to.
SALTS = 1024
#: Hash slots of ids that are broadcast before texts are fetched: at most so many longs, 4 MB.
SLOTS = 1 << 19

_MULTIPLY, _ADD = (np.random.default_rng(7).integers(1, 2**63, (2, BANDS * ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1))
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * _Q
    return h ^ (h >> np.uint64(29))


def shingles(text: str | None, size: int = 2) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text; of its whole sequence if it has fewer words, none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z, and x20 and x09-x0D
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = min(size, len(words))
    out = h[: len(h) - size + 1].copy()
    for k in range(1, size):
        out = _mix(out + _P) + h[k : len(h) - size + 1 + k]
    return np.unique(_mix(out + np.uint64(size)))


def minima(hashes: np.ndarray) -> np.ndarray:
    best = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), 512):
        np.minimum(best, (hashes[k : k + 512, None] * _MULTIPLY + _ADD).min(axis=0), out=best)
    return best


def band_keys(best: np.ndarray) -> np.ndarray:
    parts = best.reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64) * _P
    for j in range(ROWS):
        key = _mix(key + parts[:, j])
    return key.view(np.int64)


def odd_sketch(best: np.ndarray) -> np.ndarray:
    """Parity of the samples that fall on each bit."""
    at = _mix(best + np.arange(len(best), dtype=np.uint64) * _P) % np.uint64(SKETCH_BITS)
    bits = (np.bincount(at.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(np.uint8)
    return np.packbits(bits).view(np.int64)


def most_odd_bits(similarity: float, sigmas: float = 4.5) -> int:
    """Odd bits of the XOR of two sketches that leave a pair below `similarity`, less the sampling error."""
    k, n = BANDS * ROWS, SKETCH_BITS
    low = similarity - sigmas * math.sqrt(similarity * (1 - similarity) / k)
    expected = n / 2 * (1 - (1 - 2 / n) ** (2 * k * (1 - low)))
    return min(n, math.ceil(expected + 2 * math.sqrt(max(expected, 1))))


SIGNATURES = "doc_id long, text_hash long, n_shingles long, h1 long, h2 long, bands array<long>, sketch array<long>"


def _signatures(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for doc, text, hash_ in zip(rows["doc_id"], rows["text"], rows["text_hash"], strict=True):
                s = shingles(text, size)
                if not len(s) or doc is None or doc != doc:
                    out.append((None if doc != doc else doc, hash_, len(s), None, None, None, None))
                    continue
                best = minima(s)
                digest = xxhash.xxh3_128_intdigest(s.tobytes())
                out.append((doc, hash_, len(s), (digest >> 64) - 2**63, (digest & (2**64 - 1)) - 2**63, band_keys(best), odd_sketch(best)))
            yield pd.DataFrame(out, columns=["doc_id", "text_hash", "n_shingles", "h1", "h2", "bands", "sketch"]).astype({"doc_id": "Int64", "h1": "Int64", "h2": "Int64"})

    return run


def _sets(size: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"id": rows["doc_id"], "shingles": [shingles(t, size).tobytes() for t in rows["text"]]})

    return run


def _confirmed(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            keep = []
            for x, y in zip(rows["a_shingles"], rows["b_shingles"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield rows.loc[np.array(keep, bool), ["a", "b"]]

    return run


def _odd_bits(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)


def _only(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc_id is in ids. Their hash slots, SLOTS longs at most, are broadcast first: few other texts are shuffled."""
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS))
    slots = ids.select(slot.alias("slot")).distinct()
    return rows.withColumn("slot", slot).join(F.broadcast(slots), "slot", "left_semi").drop("slot").join(ids, "doc_id", "left_semi")


def _both(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """pairs(a, b) with the columns of facts(id, ...) for both ends, marked a_ and b_.

    A hub's pairs are dealt by salt, and its facts go once to each salt that occurs: so no task gets all
    documents of a large group, and no more copies are made than there are pairs.
    """
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)))
    end = lambda x: facts.select(*[F.col(c).alias(x if c == "id" else f"{x}_{c}") for c in facts.columns])
    hubs = salted.select("a", "salt").distinct().join(end("a"), "a")
    return salted.join(end("b"), "b").join(hubs, ["a", "salt"])


def likely(pairs: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    """Those of pairs(a, b) whose sizes and odd sketches allow the similarity."""
    both = _both(pairs, heads.select(F.col("doc_id").alias("id"), "n_shingles", "sketch"))
    sizes = 100 * F.least("a_n_shingles", "b_n_shingles") >= percent * F.greatest("a_n_shingles", "b_n_shingles")
    return materialize(both.filter(sizes & (_odd_bits(F.col("a_sketch"), F.col("b_sketch")) <= most_odd_bits(percent / 100))).select("a", "b").distinct(), "likely")


def confirm(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of pairs(a, b) whose full sets are similar enough. Each set goes to the pairs that name it."""
    needed = pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct()
    sets = _only(docs.select("doc_id", "text"), materialize(needed, "needed")).mapInPandas(released(_sets(size)), "id long, shingles binary")
    return materialize(_both(pairs, sets).mapInPandas(released(_confirmed(percent)), "a long, b long").distinct(), "links")


def components(links: DataFrame) -> DataFrame:
    """id and the smallest id reachable, for each id of links(a, b): minimum labels, with jumps to the label's label."""
    edges = links.select("a", "b").union(links.select("b", "a")).distinct()
    labels = materialize(edges.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.col("id")).alias("label")), "labels")
    while True:
        around = edges.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("around"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("next"))
        new = labels.join(around, "id").join(jump, "label", "left").select("id", F.least("label", "around", "next").alias("label"), (F.least("label", "around", "next") < F.col("label")).alias("moved"))
        new = materialize(new, "labels")
        if not new.filter("moved").limit(1).count():
            return new.select("id", "label")
        labels = new.select("id", "label")


def _linked(most: int, percent: int):
    """Links between different components of a pair of blocks: as many as join them, found by sketch and confirmed on sets."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        i, j = int(rows["i"].iloc[0]), int(rows["j"].iloc[0])
        rows = rows.sort_values("doc_id", kind="stable")
        block = rows["block"].to_numpy()
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        sketch = np.stack(rows["sketch"].to_list()).view(np.uint64)
        n, ids, comps = (rows[c].to_numpy(np.int64) for c in ("n_shingles", "doc_id", "comp"))
        sets = [np.frombuffer(x, np.uint64) for x in rows["shingles"]]
        _, root = np.unique(comps, return_inverse=True)  # the current component of each row
        found = []
        for k in left:
            at = right[right > k] if i == j else right
            at = at[(root[at] != root[k]) & (100 * np.minimum(n[at], n[k]) >= percent * np.maximum(n[at], n[k]))]
            odd = np.bitwise_count(sketch[at] ^ sketch[k]).sum(axis=1)
            for m in at[np.argsort(odd, kind="stable")[: (odd <= most).sum()]]:
                if root[m] == root[k]:
                    continue
                both = np.isin(sets[k], sets[m], assume_unique=True, kind="sort").sum() if len(sets[k]) < 64 else int((np.diff(np.sort(np.concatenate([sets[k], sets[m]]))) == 0).sum())
                if 100 * both >= percent * (len(sets[k]) + len(sets[m]) - both):
                    root[root == root[m]] = root[k]
                    found.append((min(ids[k], ids[m]), max(ids[k], ids[m])))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    return run


def _placed(buckets: DataFrame, comps: DataFrame) -> DataFrame:
    """buckets(key, hub, doc_id) with comp, the component of doc_id."""
    return materialize(buckets.join(comps.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("key", "hub", "doc_id", F.coalesce("label", "doc_id").alias("comp")), "placed")


def _other_hubs(placed: DataFrame) -> DataFrame:
    """pairs(a, b) of each document with one hub of each other component that its buckets lead to."""
    hubs = placed.filter("doc_id = hub").select("key", F.col("comp").alias("hub_comp")).distinct()
    found = placed.join(hubs, "key").filter("comp <> hub_comp").groupBy("doc_id", "hub_comp").agg(F.min("hub").alias("a"))
    return materialize(found.select("a", F.col("doc_id").alias("b")), "hubs")


def _rest(placed: DataFrame, heads: DataFrame, rows: DataFrame, size: int, percent: int) -> DataFrame:
    """Links that join components which share a bucket: buckets that hold several are chained into groups, and
    each group is searched by pairs of blocks, but for pairs within the component that most of its documents have."""
    mixed = placed.groupBy("key").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2")).filter("c1 <> c2").select("key")
    placed = materialize(placed.join(mixed, "key", "left_semi").select("hub", "doc_id", "comp").distinct(), "mixed")
    chained = components(placed.filter("hub <> doc_id").select(F.col("hub").alias("a"), F.col("doc_id").alias("b"))).select(F.col("id").alias("doc_id"), F.col("label").alias("chain"))
    facts = heads.select("doc_id", "n_shingles", "sketch")
    members = materialize(chained.join(placed.select("doc_id", "comp").distinct(), "doc_id").join(facts, "doc_id"), "members")
    parts = lambda n, size: F.ceil(F.greatest(n / BLOCK, size / BLOCK_SHINGLES)).cast("int")
    sizes = members.groupBy("chain", "comp").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("size")).groupBy("chain").agg(F.sum("n").alias("n"), F.sum("size").alias("size"), F.max(F.struct("n", "size", "comp")).alias("most"))
    sizes = sizes.select("chain", F.col("most.comp").alias("major"), parts(F.col("n") - F.col("most.n"), F.col("size") - F.col("most.size")).alias("minors"), parts(F.col("most.n"), F.col("most.size")).alias("majors"))
    texts = _only(rows, members.select("doc_id")).mapInPandas(released(_sets(size)), "id long, shingles binary").distinct()
    same = (F.col("id") == F.col("doc_id")) & (F.length("shingles") == 8 * F.col("n_shingles"))
    full = members.join(sizes, "chain").join(texts, same)
    # blocks of the other components come first; those of the largest one meet only them
    of_major, slot = F.col("comp") == F.col("major"), F.xxhash64("doc_id")
    full = full.withColumn("block", F.when(of_major, F.col("minors") + F.pmod(slot, F.col("majors"))).otherwise(F.pmod(slot, F.col("minors"))).cast("int"))
    others = F.sequence(F.lit(0), F.col("minors") + F.when(of_major, 0).otherwise(F.col("majors")) - 1)
    pairs = full.withColumn("other", F.explode(others)).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    columns = ["chain", "i", "j", "block", "doc_id", "comp", "n_shingles", "sketch", "shingles"]
    return materialize(pairs.select(*columns).groupBy("chain", "i", "j").applyInPandas(_linked(most_odd_bits(percent / 100), percent), "a long, b long").distinct(), "rest")


def near_duplicates(docs: DataFrame, *, size: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept and text_hash (Spark's xxhash64) for each row of docs(doc_id, text).

    Shingles have `size` words; documents are linked where 100 * intersection >= percent * union. A null or
    empty text has no shingles and no links; a row without doc_id has no links, a null component and is kept;
    rows that share a doc_id are judged each by its text. Other columns are ignored; no rows give no rows.
    """
    small_batches(docs.sparkSession, rows=1000, size=4 << 20)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_hash", F.xxhash64("text"))
    signed = materialize(rows.mapInPandas(released(_signatures(size)), SIGNATURES), "signatures")
    groups = materialize(signed.filter("h1 is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep")), "groups")
    own = ["doc_id", "text_hash", "h1", "h2", "n_shingles", "bands", "sketch"]
    heads = materialize(signed.join(groups, ["h1", "h2"]).filter("doc_id = rep").select(*own).dropDuplicates(["doc_id", "h1", "h2"]), "heads")
    repeated = not heads.groupBy("doc_id").count().filter("count > 1").isEmpty()
    if repeated:  # ids with several texts: below, each set has a number in order of ids for its id
        numbered = materialize(heads.orderBy("doc_id", "h1", "h2").withColumn("node", F.monotonically_increasing_id()), "numbered")
        rows = rows.join(numbered.select("doc_id", "text_hash", "node"), ["doc_id", "text_hash"]).select(F.col("node").alias("doc_id"), "text").dropDuplicates(["doc_id"])
        groups = numbered.select("h1", "h2", F.col("node").alias("rep"))
        heads = numbered.drop("doc_id").withColumnRenamed("node", "doc_id")
    keys = heads.select("doc_id", F.explode("bands").alias("key"))
    hubs = keys.groupBy("key").agg(F.min("doc_id").alias("hub"), F.count("*").alias("n")).filter("n > 1")
    buckets = materialize(keys.join(hubs, "key"), "buckets")
    first = materialize(buckets.groupBy("doc_id").agg(F.min("hub").alias("a")).filter("a <> doc_id").select("a", F.col("doc_id").alias("b")), "hubs")
    links = confirm(likely(first, heads, percent), rows, size, percent)
    placed = _placed(buckets, components(links))
    links = links.unionByName(confirm(likely(_other_hubs(placed), heads, percent), rows, size, percent))
    comps = components(links)
    rest = _rest(_placed(buckets, comps), heads, rows, size, percent)
    if not rest.isEmpty():
        comps = components(links.unionByName(rest))
    found = signed.select("doc_id", "text_hash", "n_shingles", "h1", "h2").join(groups, ["h1", "h2"], "left").join(comps.select(F.col("id").alias("rep"), "label"), "rep", "left")
    found = found.withColumn("node", F.coalesce("label", "rep"))
    if repeated:
        found = found.join(numbered.select("node", F.col("doc_id").alias("first")), "node", "left")
    component = F.coalesce("first" if repeated else "node", "doc_id")
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"), "text_hash")
