"""Spelling variants: words one edit apart, found in a trie of letter counts.

A word is the vector of how often each group of letters stands in it, and the vectors make a trie: level k branches
by the count of group k. One edit changes the vector by at most one surplus and one deficit, so a search goes down
from a word with a budget of one each, and verifies the words in the leaves that it reaches. Each pair is found
once: from the shorter word, or the one whose first differing count is smaller (the surplus is spent first).

The trie is dealt out by its upper nodes: a node with at most `shard` words is one shard, a larger one is split at
the next depth. What a search does above the shards is an expansion of its prefix, joined with the nodes that are
there; in a shard all its searches go down together, depth first. A shard that very many searches reach is copied
for blocks of them. Words of one whole vector that are still too many are joined by what one deletion leaves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize, small_batches

#: Letter groups: each letter of a to z, frequent ones first, then six groups of the other letters (U+00C0 to U+00FF).
GROUPS = [*"etaoinshrdlcumwfgypbvkjxqz", *("".join(map(chr, range(0xC0 + k, 0x100, 6))) for k in range(6))]
#: Depths at which nodes may be shards.
DEPTHS = (3, 8, 16, len(GROUPS))
#: Words of a shard, and searches of a block.
SHARD = 50_000
#: Pairs of words and searches below which a node is verified at once; pairs that are verified in one go; words that are compared as rows of a matrix.
FEW, MANY, ROW = 2_000, 100_000, 48
_GROUP = np.zeros(256, np.int64)
for _k, _letters in enumerate(GROUPS):
    _GROUP[[ord(c) for c in _letters]] = _k

RUN = r"([A-Za-zÀ-ÿ]+)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_counts(docs: DataFrame, *, modulus: int = 199, length: int = 6, least: int = 5) -> DataFrame:
    """word and n of docs(doc_id, text): runs of letters in lower case; where `modulus` divides the crc32 of `<doc_id>:<run>`, without one code point."""
    runs = docs.select(F.col("doc_id").cast("string").alias("doc"), F.explode(F.regexp_extract_all(F.col("text").cast("string"), F.lit(RUN), 1)).alias("run")).filter(F.length("run") >= length)
    runs = runs.withColumn("run", F.translate("run", UPPER, LOWER))
    h = F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.withColumn("h", h).select(F.when(F.col("h") % modulus == 0, shorter).otherwise(F.col("run")).alias("word"))
    return words.filter(F.length("word") >= length).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def _vector(word: Column) -> Column:
    return F.array(*[F.length(word) - F.length(F.translate(word, letters, "")) for letters in GROUPS])


def _moves(a: int, b: int) -> Column:
    """What a search can have spent after the levels a to b - 1: (up, down), the groups of its surplus and its deficit, -1 if unspent."""
    pairs = [(i, j) for i in range(a, b) for j in range(i + 1, b)]
    fresh = [(-1, -1), *((i, -1) for i in range(a, b)), *pairs]
    fresh = F.expr(f"array({', '.join(f'struct({i} as up, {j} as down)' for i, j in fresh)})")
    late = F.expr(f"array({', '.join(f'struct(up, {j} as down)' for j in (-1, *range(a, b)))})")
    return F.when(F.col("up") < 0, fresh).when(F.col("down") < 0, late).otherwise(F.array(F.struct("up", "down")))


def _key(depth: int, up: Column, down: Column) -> Column:
    """The prefix that a search's target has at a depth; another one of these never begins with it."""
    counts = F.transform(F.slice("vec", 1, depth), lambda x, k: x + (k == up).cast("int") - (k == down).cast("int"))
    return F.concat_ws(",", counts.cast("array<string>"))


def _routed(words: DataFrame, shard: int, depths: tuple[int, ...]) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Of words(word, n): the targets (node, word, n), the searches (node, word, n, depth, up, down), and the nodes of whole vectors that are too large, or None."""
    spent = lambda c: F.lit(-1).alias(c)
    rest = words.withColumn("vec", _vector(F.col("word")))
    searches = rest.select("word", "n", "vec", spent("up"), spent("down"))
    targets, routes, above = [], [], 0
    for depth in depths:
        rest = rest.withColumn("node", _key(depth, F.lit(-1), F.lit(-1)))
        nodes = materialize(rest.groupBy("node").agg((F.count("*") > shard).alias("large")), "nodes")
        met = searches.withColumn("_m", F.explode(_moves(above, depth))).select("word", "n", "vec", "_m.up", "_m.down")
        met = met.withColumn("node", _key(depth, F.col("up"), F.col("down"))).join(nodes, "node")
        last = depth == depths[-1]
        held, found = rest.join(nodes, "node"), F.lit(True) if last else ~F.col("large")
        targets.append(held.filter(found).select("node", "word", "n"))
        routes.append(met.filter(found).select("node", "word", "n", F.lit(depth).alias("depth"), "up", "down"))
        large = nodes.filter("large")
        if large.isEmpty():
            return _all(targets), _all(routes), None
        if last:
            return _all(targets), _all(routes), large.select("node")
        rest, searches, above = held.filter("large").drop("large"), met.filter("large").drop("node", "large"), depth
    raise AssertionError


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


class _Words:
    """Words of a shard as bytes, with their vectors and, for those of up to ROW letters, as rows of a matrix."""

    def __init__(self, words: list[str]):
        self.bytes = [w.encode("latin-1") for w in words]
        self.size = np.array([len(w) for w in self.bytes], np.int64)
        flat = np.frombuffer(b"".join(self.bytes), np.uint8)
        row = np.repeat(np.arange(len(words)), self.size)
        self.vec = np.bincount(row * len(GROUPS) + _GROUP[flat], minlength=len(words) * len(GROUPS)).reshape(len(words), len(GROUPS))
        place = np.arange(len(flat)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        self.row = np.zeros((len(words), ROW + 1), np.uint8)
        short = place < ROW
        self.row[row[short], place[short]] = flat[short]


def one_edit(a: bytes, b: bytes) -> bool:
    """Whether b is a with one letter replaced or inserted."""
    if not 0 <= len(b) - len(a) <= 1 or a == b:
        return False
    p = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[p + 1 :] == b[p + 1 :] if len(a) == len(b) else a[p:] == b[p + 1 :]


def _near(q: _Words, t: _Words, qi: np.ndarray, ti: np.ndarray) -> np.ndarray:
    """Which pairs are one edit apart, found from this side."""
    more = t.size[ti] - q.size[qi]
    ok = (more == 0) | (more == 1)
    long = np.flatnonzero(ok & (t.size[ti] > ROW))
    rows = np.flatnonzero(ok & (t.size[ti] <= ROW))
    found = np.zeros(len(qi), bool)
    found[long] = [one_edit(q.bytes[a], t.bytes[b]) for a, b in zip(qi[long], ti[long], strict=True)]
    a, b, one = q.row[qi[rows]], t.row[ti[rows]], more[rows] == 1
    differs = a != b
    shifted = (a[:, :-1] != b[:, 1:]) & (np.arange(ROW) >= differs.argmax(1)[:, None]) & (np.arange(ROW) < q.size[qi[rows]][:, None])
    found[rows] = np.where(one, ~shifted.any(1), differs.sum(1) == 1)
    hit = np.flatnonzero(found & (more == 0))
    change = t.vec[ti[hit]] - q.vec[qi[hit]]
    first = change[np.arange(len(hit)), (change != 0).argmax(1)]
    equal = np.flatnonzero(first == 0)
    keep = first > 0
    keep[equal] = [q.bytes[qi[hit[k]]] < t.bytes[ti[hit[k]]] for k in equal]
    found[hit] = keep
    return found


def _deletions(q: _Words, t: _Words, qi: np.ndarray, ti: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate pairs of two large sets, by what one deletion leaves of them; in time linear in their letters."""
    whole, left = {}, {}
    for k in qi.tolist():
        w = q.bytes[k]
        whole.setdefault(w, []).append(k)
        for i in range(len(w)):
            left.setdefault((i, w[:i] + w[i + 1 :]), []).append(k)
    for k in ti.tolist():
        w, met = t.bytes[k], set()
        for i in range(len(w)):
            rest = w[:i] + w[i + 1 :]
            met.update(whole.get(rest, ()), left.get((i, rest), ()))
        yield np.array(sorted(met), np.int64), np.full(len(met), k)


def _descend(q: _Words, t: _Words, depth: int, spent: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate pairs (searches, targets), depth first from `depth`; spent: 0, 1 after a surplus, 2 after a deficit too. t is in order of vectors."""
    stack = [(depth, 0, len(t.size), np.arange(len(q.size)), spent)]
    while stack:
        k, low, high, at, state = stack.pop()
        if k == len(GROUPS) or (high - low) * len(at) <= FEW:
            if (high - low) * len(at) <= 50 * MANY:
                for part in range(0, len(at), max(1, MANY // (high - low))):
                    some = at[part : part + max(1, MANY // (high - low))]
                    yield np.repeat(some, high - low), np.tile(np.arange(low, high), len(some))
            else:
                yield from _deletions(q, t, at, np.arange(low, high))
            continue
        counts, starts = np.unique(t.vec[low:high, k], return_index=True)
        own = q.vec[at, k]
        for c, a, b in zip(counts.tolist(), starts.tolist(), [*starts[1:].tolist(), high - low], strict=True):
            surplus, deficit = (own == c - 1) & (state == 0), (own == c + 1) & (state == 1)
            kept = np.flatnonzero((own == c) | surplus | deficit)
            if len(kept):
                stack.append((k + 1, low + a, low + b, at[kept], (state + surplus + deficit)[kept]))


PARTIAL = "word string, n_near long, best_n long, best string"


def _search(rows: pd.DataFrame) -> pd.DataFrame:
    """One shard and block: for each word met, how many near ones it has here, and the best of them."""
    targets, searches = rows[rows["depth"] < 0], rows[rows["depth"] >= 0]
    t, q = _Words(targets["word"].tolist()), _Words(searches["word"].tolist())
    if not len(targets) or not len(searches):
        return pd.DataFrame({"word": [], "n_near": [], "best_n": [], "best": []}, dtype=object)
    order = np.lexsort(t.vec.T[::-1])
    targets = targets.iloc[order]
    t = _Words(targets["word"].tolist())
    spent = (searches["up"].to_numpy() >= 0).astype(np.int64) + (searches["down"].to_numpy() >= 0)
    found, waiting, many = [], [], 0

    def settle() -> None:
        nonlocal waiting, many
        if waiting:
            qi, ti = (np.concatenate(x) for x in zip(*waiting, strict=True))
            near = _near(q, t, qi, ti)
            found.append((qi[near], ti[near]))
        waiting, many = [], 0

    for pair in _descend(q, t, int(searches["depth"].iloc[0]), spent):
        waiting.append(pair)
        many += len(pair[0])
        if many >= MANY:
            settle()
    settle()
    qi, ti = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64), np.empty(0, np.int64))
    a, b = searches[["word", "n"]].iloc[qi].reset_index(drop=True), targets[["word", "n"]].iloc[ti].reset_index(drop=True)
    both = pd.concat([pd.concat([a, b], axis=1, ignore_index=True), pd.concat([b, a], axis=1, ignore_index=True)])
    both.columns = ["word", "n", "best", "best_n"]
    both = both.sort_values(["best_n", "best"], ascending=[False, True])
    return both.groupby("word", sort=False).agg(n_near=("best", "size"), best_n=("best_n", "first"), best=("best", "first")).reset_index().astype({"word": object, "best": object})


def _joined(large: DataFrame, targets: DataFrame, searches: DataFrame) -> DataFrame:
    """What _search gives, for whole vectors of too many words: words that are equal without one letter each, joined."""
    i = F.col("i")
    left = lambda rows: rows.join(large, "node", "left_semi").withColumn("i", F.explode(F.sequence(F.lit(0), F.length("word") - 1))).withColumn("part", F.concat(F.substring("word", F.lit(1), i), F.substring("word", i + 2, F.length("word"))))
    t = left(targets).select("node", "i", "part", F.col("word").alias("b"), F.col("n").alias("b_n"))
    q = left(searches).select("node", "i", "part", F.col("word").alias("a"), F.col("n").alias("a_n"), "up", "down")
    level = (F.col("a") < F.col("b")) | (F.col("up") >= 0)
    replaced = t.join(q, ["node", "i", "part"]).filter((F.col("a") != F.col("b")) & level)
    whole = searches.join(large, "node", "left_semi").select("node", F.col("word").alias("part"), F.col("word").alias("a"), F.col("n").alias("a_n"))
    inserted = t.join(whole, ["node", "part"])
    pairs = replaced.select("a", "a_n", "b", "b_n").union(inserted.select("a", "a_n", "b", "b_n")).distinct()
    ways = F.array(F.struct(F.col("a").alias("word"), F.lit(1).cast("long").alias("n_near"), F.col("b_n").alias("best_n"), F.col("b").alias("best")), F.struct(F.col("b").alias("word"), F.lit(1).cast("long").alias("n_near"), F.col("a_n").alias("best_n"), F.col("a").alias("best")))
    return pairs.select(F.inline(ways))


def near_words(words: DataFrame, *, shard: int = SHARD, depths: tuple[int, ...] = DEPTHS) -> DataFrame:
    """word, n_near, best and best_n (the near word of largest n, then the first) of words(word, n) that have near ones. Words hold letters up to U+00FF."""
    small_batches(words.sparkSession)
    targets, searches, large = _routed(words, shard, depths)
    searches = materialize(searches, "searches")
    rest = None
    if large is not None:
        large = large.withColumn("large", F.lit(True))
        rest = _joined(large, targets, searches)
        targets, searches = (x.join(large, "node", "left_anti") for x in (targets, searches))
    blocks = materialize(searches.groupBy("node").agg(F.ceil(F.count("*") / shard).cast("int").alias("blocks")), "blocks")
    dealt = searches.join(blocks, "node").withColumn("block", F.pmod(F.xxhash64("word", "up", "down"), "blocks").cast("int"))
    copies = targets.join(blocks, "node").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"depth": F.lit(-1), "up": F.lit(-1), "down": F.lit(-1)})
    rows = dealt.unionByName(copies).drop("blocks")
    found = rows.groupBy("node", "block").applyInPandas(_search, PARTIAL)
    found = found if rest is None else found.unionByName(rest)
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("_b")).select("word", "n_near", F.col("_b.word").alias("best"), (-F.col("_b.n")).alias("best_n"))


def spelling_variants(docs: DataFrame, *, ratio: int = 5, shard: int = SHARD, depths: tuple[int, ...] = DEPTHS) -> DataFrame:
    """The words of docs(doc_id, text) with their forms: word, form, root, n, n_near, form_n.

    A null or empty text has no words; a run of a row without doc_id stays whole; repeated rows count each; an
    empty table gives no rows; other columns are ignored. n grows along forms by the ratio at least, so roots are
    found in a few rounds, each of which doubles how far a word looks.
    """
    words = materialize(word_counts(docs), "words")
    near = near_words(words, shard=shard, depths=depths)
    known = F.col("best_n") >= ratio * F.col("n")
    rows = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(known, F.col("best")).alias("form"), F.when(known, F.col("best_n")).alias("form_n"))
    rows = materialize(rows, "forms")
    roots = rows.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        then = roots.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        roots = materialize(roots.join(then, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        if roots.filter("moved").isEmpty():
            break
        roots = roots.drop("moved")
    return rows.join(roots.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
