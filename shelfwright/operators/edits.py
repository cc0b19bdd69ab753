"""Pairs of a batch's nodes that a rule matches: all pairs of blocks, told apart by bits and then compared in full.

An edit changes two counts of letters by one at most, and puts four of the pairs of letters, each occurrence counted,
in or out at most. So texts whose sketches differ in more bits than the edits allow don't match, and nearly all others
do; a text in another has no bit that the other lacks, and of words that two nodes don't share each takes a bit of its
own at most. Blocks have a bounded number of rows, so no text or part of one that is frequent makes a large task, and
two nodes meet in one task, so each pair comes once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.folders import written

#: Rows of a block; how much lengths of near texts differ at most; copies of a count, so that a large batch meets it in many tasks; tasks at most.
BLOCK, APART, SALTS, TASKS = 16_384, 3, 32, 4000
#: Rows of a block that meet another one at a time, pairs compared at once, and places of a table of letters or words then.
TILE, AT_ONCE, PLACES = 1024, 4096, 1 << 21
#: How many counts of each letter have a bit; all other characters count as one.
LEVELS = {"e": 10} | dict.fromkeys("ntaihsrdo", 7) | dict.fromkeys("luc", 5) | dict.fromkeys("mbg", 4) | dict.fromkeys("wfpzvy", 3) | dict.fromkeys("kqjx", 2)
_OTHER = len(LEVELS)
_COUNTED = np.array([(k, n) for k, most in enumerate([*LEVELS.values(), 2]) for n in range(1, most + 1)])
_CLASS = np.full(128, _OTHER)
_CLASS[[ord(c) for c in LEVELS]] = range(_OTHER)
#: Bits for pairs of letters.
PAIRS = 1024
#: match(a, b) holds; match(b, a) holds.
AHEAD, BACK = 1, 2


@dataclass(frozen=True)
class Near:
    """Texts in column c are equal, or differ in length by three and in max(1, floor(share * longer)) edits at most where the one that the rule asks about has over `over` characters."""

    c: str
    share: float | None
    over: int = 0


@dataclass(frozen=True)
class Rule:
    """A rule as blocks decide it: texts that are near; a key (k) of over `over` characters in another one with `ratio` of its length, or where `begins` at its start; words (w), `words` of the fewer, two at least. It asks about the second node where `second`."""

    near: tuple[Near, ...]
    ratio: float | None = None
    over: int = 0
    begins: bool = False
    words: float | None = None
    second: bool = False


# --- texts and their bits


def _packed(bits: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(np.packbits(bits, axis=1, bitorder="little")).view(np.uint64)


def _sketches(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bits of texts: two words of counts of letters, those of pairs of letters folded to a quarter, and whole. The first two by words."""
    row = np.repeat(np.arange(len(n)), n)
    kinds = np.where(codes < 128, _CLASS[np.minimum(codes, 127)], _OTHER)
    counts = np.bincount(row * (_OTHER + 1) + kinds, minlength=len(n) * (_OTHER + 1)).reshape(len(n), _OTHER + 1)
    letters = counts[:, _COUNTED[:, 0]] >= _COUNTED[:, 1]
    inside = row[1:] == row[:-1]
    # pairs that agree in these 32 bits are taken for one another, in every text alike
    pair = ((codes[:-1] << 21 | codes[1:])[inside] * 0x9E3779B97F4A7C1 >> 20) & 0xFFFFFFFF
    key = np.sort(row[1:][inside] << 32 | pair)
    new = np.ones(len(key), dtype=bool)
    new[1:] = key[1:] != key[:-1]
    place = np.arange(len(key))
    nth = place - np.maximum.accumulate(np.where(new, place, 0))
    bits = np.zeros((len(n), PAIRS), dtype=bool)
    bits[key >> 32, ((key & 0xFFFFFFFF) * 0x9E3779B97F4A7C1 + nth * 0x2545F4914F6CDD1D >> 33) & (PAIRS - 1)] = True
    pairs = _packed(bits)
    folded = np.bitwise_xor.reduce(pairs.reshape(len(n), 4, -1), axis=1)
    return np.ascontiguousarray(_packed(letters).T), np.ascontiguousarray(folded.T), pairs


@dataclass
class _Texts:
    """Texts as places in an array of their characters' numbers, from 1 on, with their bits; `given` are those that aren't null."""

    texts: list[str]
    kinds: np.ndarray
    most: int
    row: np.ndarray
    start: np.ndarray
    n: np.ndarray
    given: np.ndarray
    letters: np.ndarray
    folded: np.ndarray
    pairs: np.ndarray

    @staticmethod
    def of(*columns: pa.ChunkedArray) -> list[_Texts]:
        """Those of some columns, whose characters have the same numbers."""
        texts = [[t or "" for t in c.to_pylist()] for c in columns]
        codes = [np.frombuffer("".join(t).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64) for t in texts]
        number = np.zeros(max(c.max(initial=0) for c in codes) + 1, dtype=np.int64)
        for c in codes:
            number[c] = 1
        number = number.cumsum()
        out = []
        for column, t, c in zip(columns, texts, codes, strict=True):
            n = np.fromiter(map(len, t), np.int64, len(t))
            out.append(_Texts(t, number[c], int(number[-1]), np.arange(len(n)), np.cumsum(n) - n, n, ~column.is_null().to_numpy(), *_sketches(c, n)))
        return out

    def take(self, at: np.ndarray) -> _Texts:
        return _Texts(self.texts, self.kinds, self.most, self.row[at], self.start[at], self.n[at], self.given[at], self.letters[:, at], self.folded[:, at], self.pairs[at])


#: Bits of words that are looked at first, and at last; more shared words than NEEDED aren't asked for by them.
FIRST, LAST, NEEDED = 64, 192, 255


@dataclass
class _Words:
    """Words as numbers, repeated ones each; bits of each node's, those that are no word's own (`lost`), and how many different words it shares at least with one that has `k` of its words."""

    ids: np.ndarray
    start: np.ndarray
    n: np.ndarray
    bits: np.ndarray
    lost: np.ndarray
    least: np.ndarray

    @staticmethod
    def of(column: pa.ChunkedArray, share: float) -> _Words:
        lists = column.combine_chunks()
        n = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        ids = lists.flatten().dictionary_encode().indices.to_numpy().astype(np.int64)
        row, kinds = np.repeat(np.arange(len(n)), n), ids.max(initial=0) + 1
        bits = np.zeros((len(n), FIRST + LAST), dtype=bool)
        for at, size in ((0, FIRST), (FIRST, LAST)):
            bits[row, at + (ids * 0x9E3779B97F4A7C1 >> 40) % size] = True
        words, often = np.unique(row * kinds + ids, return_counts=True)
        different = np.bincount(words // kinds, minlength=len(n))
        lost = different[:, None] - np.stack([bits[:, :FIRST].sum(axis=1), bits[:, FIRST:].sum(axis=1)], axis=1)
        shared = np.arange(min(NEEDED, int(_needed(n, share).max(initial=0))) + 1)
        least = np.tile(shared, (len(n), 1))
        ends = different.cumsum()
        for at in np.flatnonzero(different < n):  # the words that come most often first
            least[at] = np.searchsorted(np.sort(often[ends[at] - different[at] : ends[at]])[::-1].cumsum(), shared) + (shared > 0)
        return _Words(ids, np.cumsum(n) - n, n, _packed(bits), lost, least)

    def take(self, at: np.ndarray) -> _Words:
        return _Words(self.ids, self.start[at], self.n[at], self.bits[at], self.lost[at], self.least[at])


def _needed(n: np.ndarray, share: float) -> np.ndarray:
    return np.ceil(n * share - 1e-9).astype(np.int64)


# --- comparing pairs in full


def _rows(flat: np.ndarray, start: np.ndarray, n: np.ndarray, none: int) -> np.ndarray:
    """What lies in flat from start on, n places, as columns; `none` behind it."""
    step = np.arange(n.max(initial=0))[:, None]
    return np.where(step < n, flat[np.minimum(start + step, len(flat) - 1)] if len(flat) else none, none)


def _edits(x: _Texts, p: np.ndarray, y: _Texts, q: np.ndarray) -> np.ndarray:
    """Edits between texts p of x and q of y, by columns of the table of edits as words of bits (Myers 1999, in blocks of 64 rows)."""
    used, row = np.unique(p, return_inverse=True)
    mine, its = _rows(x.kinds, x.start[used], x.n[used], 0), _rows(y.kinds, y.start[q], y.n[q], 0)
    m, n, kinds = x.n[p], y.n[q], x.most + 1
    blocks = max(1, -(-len(mine) // 64))
    at = np.zeros((blocks, len(used) * kinds), dtype=np.uint64)
    base = np.arange(len(used)) * kinds
    for i, kind in enumerate(mine):
        at[i // 64, base + kind] |= np.uint64(1 << i % 64)
    at[:, base] = 0  # what lies behind a text equals nothing
    one, top = np.uint64(1), np.uint64(63)
    up, down = [np.full(len(p), ~np.uint64(0)) for _ in range(blocks)], [np.zeros(len(p), dtype=np.uint64) for _ in range(blocks)]
    mask = [np.where(m >= 64 * k + 64, ~np.uint64(0), (one << np.clip(m - 64 * k, 0, 63).astype(np.uint64)) - one) for k in range(blocks)]
    out, ends = n.copy(), set(n.tolist())
    for j in range(len(its) + 1):
        if j in ends:  # the last column: edits to nothing, and by how much each row adds to them
            its_end = n == j
            for u, d, rows in zip(up, down, mask, strict=True):
                out[its_end] += np.bitwise_count(u & rows)[its_end].astype(np.int64) - np.bitwise_count(d & rows)[its_end]
        if j == len(its):
            break
        more, less, place = one, None, its[j] + row * kinds
        for k in range(blocks):
            equal, u, d = at[k].take(place), up[k], down[k]
            v = equal | d
            if less is not None:
                equal |= less
            h = equal & u
            h += u
            h ^= u
            h |= equal
            plus = h | u
            np.invert(plus, out=plus)
            plus |= d
            h &= u
            if k + 1 < blocks:
                more_, less_ = plus >> top, h >> top
            plus <<= one
            plus |= more
            h <<= one
            if less is not None:
                h |= less
            np.bitwise_and(plus, v, out=d)
            v |= plus
            np.invert(v, out=v)
            np.bitwise_or(h, v, out=u)
            if k + 1 < blocks:
                more, less = more_, less_
    return out


def _by_parts(size: np.ndarray) -> Iterator[np.ndarray]:
    """Places of pairs, AT_ONCE at most and so many that each times the largest size is PLACES at most, one at least."""
    order = np.argsort(size, kind="stable")
    at = 0
    while at < len(order):
        part = order[at : at + AT_ONCE]
        fits = np.searchsorted(size[part] * np.arange(1, len(part) + 1), PLACES, side="right")
        yield part[: max(1, fits)]
        at += max(1, fits)


def _few_edits(x: _Texts, p: np.ndarray, y: _Texts, q: np.ndarray) -> np.ndarray:
    out = np.zeros(len(p), dtype=np.int64)
    for part in _by_parts((x.most + 1) * (x.n[p] // 64 + 1)):
        out[part] = _edits(x, p[part], y, q[part])
    return out


def _shared(x: _Words, p: np.ndarray, y: _Words, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many words p of x are in q of y, and the other way; repeated ones count each."""
    there, back = np.zeros(len(p), dtype=np.int64), np.zeros(len(p), dtype=np.int64)
    for part in _by_parts(x.n[p] * y.n[q]):
        a, b = _rows(x.ids, x.start[p[part]], x.n[p[part]], -1), _rows(y.ids, y.start[q[part]], y.n[q[part]], -2)
        same = a[:, None] == b
        there[part], back[part] = same.any(axis=1).sum(axis=0), same.any(axis=0).sum(axis=0)
    return there, back


# --- finding pairs by their bits

_Found = tuple[np.ndarray, np.ndarray]


def _where(n: int, m: int, test: Callable[[slice, slice], np.ndarray]) -> _Found:
    """Rows and columns of n times m where the test holds, which is asked about stretches of both."""
    rows, columns = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(0, n, 32):
        for j in range(0, m, 2048):
            p, q = np.divmod(np.flatnonzero(test(slice(i, i + 32), slice(j, j + 2048))), min(2048, m - j))
            rows.append(p + i)
            columns.append(q + j)
    return np.concatenate(rows), np.concatenate(columns)


def _most(longer: np.ndarray, share: float) -> np.ndarray:
    return np.maximum(1, np.floor(longer * share).astype(np.int64))


def _by_length(x: _Texts, y: _Texts, before: _Before | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length of x: it, the places that have it (and one length in the form before, as far off), and those of y in order of their lengths, with these."""
    order = np.flatnonzero(y.given)
    order = order[np.argsort(y.n[order], kind="stable")]
    alike = np.stack([x.n, before.x.n, before.off_x] if before else [x.n], axis=1)
    for kind in np.unique(alike[x.given], axis=0):
        yield int(kind[0]), np.flatnonzero(x.given & (alike == kind).all(axis=1)), order, y.n[order]


@dataclass
class _Before:
    """A form that was looked at before: its texts of both sides, and by how many edits the form looked at now lies off it."""

    near: Near
    x: _Texts
    y: _Texts
    off_x: np.ndarray
    off_y: np.ndarray

    def found(self, own: int, its: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Whether a text and its, if they are so many edits apart in the form looked at now, are near in that one both ways."""
        n, m = self.x.n[own], self.y.n[its]
        edits = most + self.off_x[own] + self.off_y[its]
        return (np.abs(n - m) <= APART) & (edits <= _most(np.maximum(n, m), self.near.share)) & (np.minimum(n, m) > self.near.over)


def _near(x: _Texts, y: _Texts, near: Near, second: bool, before: _Before | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs that are near, with the ways in which they are, x before y; but for those that are near in the form before for sure."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for size, own, its, n in _by_length(x, y, before):
        its = its[slice(*np.searchsorted(n, [size - APART, size + APART + 1]))] if near.share else its[slice(*np.searchsorted(n, [size, size + 1]))]
        apart = np.abs(y.n[its] - size)
        most = _most(np.maximum(y.n[its], size), near.share) if near.share else apart
        open_ = apart <= most
        if before:
            open_ &= ~before.found(own[0], its, most)
        its, letters, pairs = its[open_], np.minimum(2 * most - apart, 255)[open_].astype(np.uint8), (4 * most - apart)[open_]
        (one, two), (his, hers), mine, others = x.letters[:, own], y.letters[:, its], x.folded[:, own], y.folded[:, its]

        def test(a: slice, b: slice) -> np.ndarray:
            differ = np.bitwise_count(one[a, None] ^ his[b])
            differ += np.bitwise_count(two[a, None] ^ hers[b])
            return differ <= letters[b]

        p, q = _where(len(own), len(its), test)
        for at in range(0, len(p), AT_ONCE):
            a, b = p[at : at + AT_ONCE], q[at : at + AT_ONCE]
            few = sum(np.bitwise_count(m[a] ^ o[b]).astype(np.int64) for m, o in zip(mine, others, strict=True)) <= pairs[b]
            a, b = a[few], b[few]
            few = np.bitwise_count(x.pairs[own[a]] ^ y.pairs[its[b]]).sum(axis=1, dtype=np.int64) <= pairs[b]
            found.append((own[a[few]], its[b[few]]))
    p, q = (np.concatenate(f) for f in zip(*found, strict=True))
    edits = _few_edits(x, p, y, q)
    within = edits <= (_most(np.maximum(x.n[p], y.n[q]), near.share) if near.share else 0)
    ahead, back = (y.n[q], x.n[p]) if second else (x.n[p], y.n[q])
    ways = np.where(edits == 0, AHEAD | BACK, np.where(within & (ahead > near.over), AHEAD, 0) | np.where(within & (back > near.over), BACK, 0))
    return p, q, ways


def _inside(x: _Texts, y: _Texts, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs whose shorter text is in the other, which is longer by more than edits allow."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    share = next(near.share for near in rule.near if near.c == "k")
    for small, large, turn in ((x, y, 1), (y, x, -1)):
        for size, own, order, n in _by_length(small, large):
            if size <= rule.over:
                continue
            its = order[(n > size) & ((n - size > APART) | (n - size > _most(n, share)))]
            if not rule.begins:
                its = its[size / large.n[its] >= rule.ratio]
            if not len(its):
                continue
            (one, two), (his, hers) = small.letters[:, own], large.letters[:, its]
            p, q = _where(len(own), len(its), lambda a, b, one=one, lacks=~his: (one[a, None] & lacks[b]) == 0)
            held = (two[p] & ~hers[q]) == 0
            p, q = own[p[held]], its[q[held]]
            held = ~(small.pairs[p] & ~large.pairs[q]).any(axis=1)
            p, q = p[held], q[held]
            enough = size / large.n[q] >= rule.ratio
            pairs = zip(small.row[p], large.row[q], enough, strict=True)
            holds = np.fromiter((small.texts[a] in large.texts[b] if e else large.texts[b].startswith(small.texts[a]) for a, b, e in pairs), bool, len(p))
            found.append((p[holds], q[holds])[::turn])
    p, q = (np.concatenate(f) for f in zip(*found, strict=True))
    return p, q, np.full(len(p), AHEAD | BACK)


def _sharing(x: _Words, y: _Words, rule: Rule) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs that share so many words of the fewer ones. Different words that both have share a bit, but for those whose bit another one of the node has too."""
    most = x.least.shape[1] - 1
    needs = lambda w: np.minimum(_needed(w.n, rule.words), most)
    mine, its = np.flatnonzero(x.n >= 2), np.flatnonzero(y.n >= 2)
    need, few, bits, lost = needs(x), needs(y)[its], y.bits[its, 0].copy(), y.lost[its, 0]
    alike = np.stack([need, x.lost[:, 0], x.least[np.arange(len(need)), need]], axis=1)[mine]
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for kind in np.unique(alike, axis=0) if len(its) else []:
        own = mine[(alike == kind).all(axis=1)]
        wanted = np.minimum(few, kind[0])
        least = np.minimum(x.least[own].min(axis=0)[wanted], y.least[its, wanted]) - np.minimum(lost, kind[1])
        least, first = np.clip(least, 0, 255).astype(np.uint8), x.bits[own, 0]
        p, q = _where(len(own), len(its), lambda a, b, first=first, least=least: np.bitwise_count(first[a, None] & bits[b]) >= least[b])
        for at in range(0, len(p), AT_ONCE):
            a, b = own[p[at : at + AT_ONCE]], q[at : at + AT_ONCE]
            wanted, b = np.minimum(few[b], kind[0]), its[b]
            both = np.bitwise_count(x.bits[a, 1:] & y.bits[b, 1:]).sum(axis=1, dtype=np.int64) + np.minimum(x.lost[a, 1], y.lost[b, 1])
            held = both >= np.minimum(x.least[a, wanted], y.least[b, wanted])
            found.append((a[held], b[held]))
    p, q = (np.concatenate(f) for f in zip(*found, strict=True))
    there, back = _shared(x, p, y, q)
    if rule.second:
        there, back = back, there
    fewer = np.minimum(x.n[p], y.n[q])
    holds = lambda n: (n >= 2) & (n / fewer >= rule.words)
    return p, q, np.where(holds(there), AHEAD, 0) | np.where(holds(back), BACK, 0)


def _meeting(rule: Rule, marked: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For applyInArrow: the pairs of two blocks, or of one with itself."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(rows))
        batch, i, j = t["batch_id"][0], t["i"][0].as_py(), t["j"][0].as_py()
        seq, many, led, block = (t[c].to_numpy() for c in ("seq", "many", "led", "block"))
        texts = dict(zip((near.c for near in rule.near), _Texts.of(*(t[near.c] for near in rule.near)), strict=True))
        base, all_ = texts[rule.near[0].c], np.arange(len(seq))
        off = {c: _few_edits(form, all_, base, all_) for c, form in texts.items() if form is not base}
        words = _Words.of(t["w"], rule.words) if rule.words else None
        order = np.argsort(base.n, kind="stable")
        of = lambda k, *also: order[np.logical_and.reduce([block[order] == k, *(a[order] for a in also)])]
        if marked:
            sides = [(of(i, led), of(j, ~led))] + ([(of(i, ~led), of(j, led))] if i != j else [])
        else:
            sides = [(of(i), of(j))]
        for x, y in sides:
            for at in range(0, len(x), TILE):
                own, its = x[at : at + TILE], y if marked or i != j else y[at:]
                found = []
                before = None
                for near in rule.near:
                    here, there = texts[near.c].take(own), texts[near.c].take(its)
                    found.append(_near(here, there, near, rule.second, before and replace(before, off_x=off[near.c][own], off_y=off[near.c][its])))
                    before = before or _Before(near, here, there, all_, all_)
                if rule.ratio:
                    found.append(_inside(texts["k"].take(own), texts["k"].take(its), rule))
                if words:
                    found.append(_sharing(words.take(own), words.take(its), rule))
                p, q, ways = (np.concatenate(f) for f in zip(*found, strict=True))
                key = p * len(its) + q
                if not marked and i == j:
                    key, ways = key[p < q], ways[p < q]
                sort = np.argsort(key, kind="stable")
                key, ways = key[sort], ways[sort]
                new = np.flatnonzero(np.diff(key, prepend=-1))
                if not len(new):
                    continue
                ways = np.bitwise_or.reduceat(ways, new)
                p, q = np.divmod(key[new], len(its))
                a, b = own[p], its[q]
                turned = seq[a] > seq[b]
                a, b = np.where(turned, b, a), np.where(turned, a, b)
                ways = np.where(turned, (ways & AHEAD) * BACK | (ways & BACK) // BACK, ways)
                holds = (ways > 0) & (seq[a] != seq[b])
                a, b, ways = a[holds], b[holds], ways[holds]
                for k in range(0, len(a), 1 << 18):
                    u, v = a[k : k + (1 << 18)], b[k : k + (1 << 18)]
                    yield pa.RecordBatch.from_arrays([pa.repeat(batch, len(u)), pa.array(seq[u]), pa.array(seq[v]), pa.array(ways[k : k + (1 << 18)].astype(np.int8)), pa.array(many[u] | many[v])], ["batch_id", "a", "b", "ways", "many"])

    return run


def matched(nodes: DataFrame, rule: Rule) -> DataFrame:
    """Pairs (batch_id, a, b, ways, many) of nodes(batch_id, seq, ...) of a batch, a < b, each once: AHEAD and BACK tell which of match(a, b) and match(b, a) hold, many whether one of them is `many`, if nodes tell. Of nodes that are marked (led), one that is meets those that aren't.

    A batch's nodes are dealt into blocks, and each two of its blocks meet in a task.
    """
    kinds, marked = dict(nodes.dtypes), "led" in nodes.columns
    flag = lambda c: (F.col(c) if c in kinds else F.lit(False)).alias(c)
    columns: list[str] = [near.c for near in rule.near] + ["w"] * bool(rule.words)
    salt: Column = F.pmod(F.xxhash64("seq"), F.lit(SALTS)).cast("int")
    own = nodes.select("batch_id", F.xxhash64("batch_id").alias("batch"), "seq", *columns, flag("many"), flag("led"), salt.alias("salt"))
    counts = written(nodes.groupBy(F.xxhash64("batch_id").alias("batch")).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "blocks")
    meetings = counts.agg(F.sum(F.expr("blocks * (blocks + 1) div 2"))).first()[0] or 1
    copies = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = own.join(copies.hint("merge"), ["batch", "salt"]).withColumn("block", F.pmod(F.xxhash64("seq", F.lit("block")), F.col("blocks")).cast("int"))
    key = ["batch_id", "i", "j"]
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("batch_id", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "seq", *columns, "many", "led")
    return met.repartition(min(4 * int(meetings), TASKS), *key).groupBy(*key).applyInArrow(_meeting(rule, marked), f"batch_id {kinds['batch_id']}, a long, b long, ways byte, many boolean")


def within_edits(nodes: DataFrame, c: str, share: float) -> DataFrame:
    """Pairs (x, y) of nodes(batch_id, seq, c), x < y: those of a batch whose c, of three characters at least, differ in length by three at most and in max(1, floor(share * longer)) edits at most."""
    return matched(nodes.filter(F.length(c) >= 3), Rule((Near(c, share),))).select(F.col("a").alias("x"), F.col("b").alias("y"))
