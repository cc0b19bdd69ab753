"""Spelling variants, token files and Merkle manifests against plain Python, and their SQL."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from shelfwright.llm import spelling as S
from shelfwright.llm import token_files as T
from shelfwright.llm.merkle import BAND, FAN, manifest, merkle_manifest
from shelfwright.llm.queries import ORACLE_SQL, op11_spelling_variants, op13_merkle_manifest
from tests.oracle import compare

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n long, h string, node string, _tie long"


def table(spark, rows):
    """Rows (doc_id, text, source) with further columns, some of whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), 7, "h", "x", 1) for i, t, s in rows], DOCS)


def docs(spark, rows):
    return table(spark, [(i, t, "a") for i, t in rows])


# Spelling variants


def word_counts(rows):
    found = Counter()
    for d, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(str.maketrans(S.UPPER, S.LOWER))
            h = 1 if d is None else zlib.crc32(f"{d}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(rows):
    n = word_counts(rows)
    near = {w: [x for x in n if abs(len(x) - len(w)) < 2 and one_edit(w, x)] for w in n}
    best = {w: min(near[w], key=lambda x: (-n[x], x), default=None) for w in n}
    form = {w: b if b and n[b] >= 5 * n[w] else None for w, b in best.items()}
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def made_up(rng):
    """Families around stems with letters changed, among them long words, other letters and very many anagrams."""
    stems = ["".join(rng.choice("etaonséÀß÷") for _ in range(rng.choice([6, 7, 9, 14]))) for _ in range(12)] + ["x" * 60 + "abc" * 5, "aabbcc"]
    words = []
    for k, stem in enumerate(stems):
        words += [stem] * (5 * 6 ** (k % 3))
        for _ in range(12):
            i, c = rng.randrange(len(stem)), rng.choice("etasÿ")
            words += [rng.choice([stem[:i] + stem[i + 1 :], stem[:i] + c + stem[i:], stem[:i] + c + stem[i + 1 :]])] * rng.choice([5, 6, 25])
    for _ in range(60):
        words += ["".join(rng.sample("aabbcc", 6))] * 5
    rng.shuffle(words)
    rows = [(k, " ".join(words[k::7])) for k in range(7)]
    return rows + [(8, None), (9, ""), (None, rows[0][1]), (3, rows[3][1]), (10, rows[1][1].upper()), (11, "Straße " * 3000), (14, "chainaaaa " * 150 + "chainaaab " * 28 + "chainaabb " * 5), (12, "-".join(words) + "\n123")]


@pytest.mark.parametrize("shard", [S.SHARD, 40, 1])
def test_spelling_variants(spark, shard):
    rows = made_up(random.Random(4))
    got = {tuple(r) for r in S.spelling_variants(docs(spark, rows), shard=shard).collect()}
    assert got == variants(rows)
    assert any(x[1] for x in got) and ("chainaabb", "chainaaab", "chainaaaa", 5, 1, 28) in got


def test_spelling_variants_of_nothing(spark):
    assert S.spelling_variants(docs(spark, [])).count() == 0
    assert S.spelling_variants(docs(spark, [(1, None), (2, "few words")])).count() == 0


def test_large_leaves_are_searched_by_deletions(monkeypatch):
    monkeypatch.setattr(S, "MANY", 1)
    monkeypatch.setattr(S, "FEW", 0)
    words = sorted({"".join(random.Random(k).choices("ab", k=9)) for k in range(200)})
    q = S._Words(words)
    order = np.lexsort(q.vec.T[::-1])
    t = S._Words([words[k] for k in order])
    found = set()
    for a, b in S._descend(q, t, 0, np.zeros(len(words), np.int64)):
        near = S._near(q, t, a, b)
        found |= {(q.bytes[x], t.bytes[y]) for x, y in zip(a[near], b[near], strict=True)}
    pairs = [(x, y) for x in words for y in words if x < y and one_edit(x, y)]
    assert {tuple(sorted(p)) for p in found} == {tuple(sorted((x.encode(), y.encode()))) for x, y in pairs} and len(found) == len(pairs)


# Token files


def test_packed_widths():
    rng = np.random.default_rng(5)
    for bits in range(1, 33):
        for n in (0, 1, 8, 1001):
            ids = rng.integers(0, 1 << bits, n, np.uint64).astype("<u4")
            data = T.pack(ids, bits)
            assert len(data) == -(-n * bits // 8) and (T.unpack(data, n, bits) == ids).all()
    assert [T.vocabulary_bits(n) for n in (1, 2, 3, 32_000, 49_408, 50_257, 65_536, 65_537)] == [1, 1, 2, 15, 16, 16, 16, 17]


def test_chunks_give_the_tokenizers_ids():
    rng, code = random.Random(6), T.ChunkEncoder(T.tokenizer_path(T.TOKENIZER))
    parts = [" ", " ", " ", "  ", "\n", "\t", "\xa0", "\x1c", "\0", "a", "the", "é", "ß", "'s", "12", "3", ".", ",", "!", "...", "\U0001f600", "漢字", "<|endoftext|>", "\r\n", "x" * 70, "«", "　", "\x85", "word."]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(4000)]
    expected = [x.ids for x in code.tokenizer.encode_batch(texts, add_special_tokens=False)]
    got = [np.frombuffer(x, "<u4").tolist() for k in range(0, len(texts), 300) for x in code.encode(texts[k : k + 300])]
    assert got == expected


@pytest.mark.parametrize("tokenizer", [T.TOKENIZER])
def test_token_files(spark, tmp_path, tokenizer):
    rng, tok = random.Random(7), T.encoder(tokenizer).tokenizer
    rows = [(rng.randint(-50, 1000), " ".join(rng.choices(["word", "Straße", "of", "a", "\n", "12.5"], k=rng.choice([0, 3, 50])))) for _ in range(300)]
    rows += [(1001, "same")] * 40 + [(5, None), (6, ""), (None, "no id"), (None, None), (1002, "very long " * 60_000), (1003, "<|endoftext|>")]
    path = f"file://{tmp_path}/ids"
    T.write_token_files(docs(spark, rows).repartition(5), path, tokenizer=tokenizer, block=512)
    got = sorted(T.read_token_files(spark, path).collect(), key=lambda r: r["start"])
    ids = {t: [*tok.encode(t, add_special_tokens=False).ids, T.END] for t in {t or "" for _, t in rows}}
    at = 0
    for r in got:
        assert (r["start"], r["n_tokens"]) == (at, len(r["ids"]) // 4)
        at += r["n_tokens"]
    order = lambda i: (i is not None, i or 0)
    assert [r["doc_id"] for r in got] == sorted((i for i, _ in rows), key=order)
    seen = Counter((r["doc_id"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in got)
    assert seen == Counter((i, tuple(ids[t or ""])) for i, t in rows)
    few = T.read_token_files(spark, path, [1002, 6]).collect()
    assert {(r["doc_id"], r["n_tokens"]) for r in few} == {(1002, len(ids["very long " * 60_000])), *((6, len(ids[t or ""])) for i, t in rows if i == 6)}
    files = list((tmp_path / "ids").glob("*.ids"))
    packed = sum(f.stat().st_size for f in files)
    assert packed <= 2 * at + 17 * len(rows) + 8 * (at // 512 + 2 * len(files)) + 48 * len(files)


def test_token_digests(spark):
    rows = [(3, "three words here"), (1, None), (2, "zwei\n\nWörter")]
    tok = T.encoder(T.TOKENIZER).tokenizer
    at, expected = 0, []
    for i, t in sorted(rows):
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        expected.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in T.token_file_digests(docs(spark, rows)).collect()) == expected
    assert T.token_file_digests(docs(spark, [])).count() == 0


# Merkle manifests


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(i, t, s):
    said = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return lambda text: H(said(i), said(s), said("en"), said(None if t is None else len(t)), said(text))


def levels_of(leaves):
    out = [leaves]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][k : k + 3]) for k in range(0, len(out[-1]), 3)])
    return out


def path_of(levels, k):
    out = []
    for level in levels[:-1]:
        run = level[k // 3 * 3 : k // 3 * 3 + 3]
        out.append(("".join(run[: k % 3]), "".join(run[k % 3 + 1 :])))
        k //= 3
    return out


def proofs(rows):
    by_source = {}
    for i, t, s in rows:
        cut = t.replace("\n", "") if t and i is not None and zlib.crc32(str(i).encode()) % 2 == 0 else t
        by_source.setdefault(s, []).append((i is not None, i or 0, leaf_of(i, t, s)(t), leaf_of(i, t, s)(cut), i))
    trees = {s: levels_of([x[2] for x in sorted(v, key=lambda x: x[:3])]) for s, v in by_source.items()}
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    top = levels_of([trees[s][-1][0] for s in names])
    for j, s in enumerate(names):
        for k, (*_, leaf, cut, i) in enumerate(sorted(by_source[s], key=lambda x: x[:3])):
            path = path_of(trees[s], k) + path_of(top, j)
            h = cut
            for left, right in path:
                h = H(left, h, right)
            yield i, leaf, trees[s][-1][0], top[-1][0], H(*[a + b for a, b in path]), h, h == top[-1][0]


@pytest.mark.parametrize("sizes", [(1,), (3, 1, 1), (FAN**BAND + 1, 2), (40, 9, 27, 28, 3, 1, 2, 10, 82)])
def test_manifest(spark, sizes):
    rng = random.Random(sum(sizes))
    rows = [(rng.randint(0, 9999), f"text {k}\nof {s}", s) for s, n in zip([None, "", "é", "z", "a", "B", "Ω", "\U0001f600", "～"], sizes, strict=False) for k in range(n)]
    if len(sizes) > 2:
        rows += [(None, "no id\n", "a"), (5, None, "a"), (6, "", "a"), (7, "x\n" * 300_000, "z"), *[(8, "same\n", None)] * 5]
    got = [tuple(r) for r in merkle_manifest(table(spark, rows).repartition(3)).collect()]
    key = lambda r: repr(r)
    assert sorted(got, key=key) == sorted(proofs(rows), key=key)
    assert len({r[6] for r in got}) == 2 or len(sizes) == 1


def test_node_labels(spark):
    rows = [(k, "t", "a") for k in range(100)]
    nodes = manifest(table(spark, rows))[1].collect()
    for level in range(6):
        spans = sorted((r["lo"], r["hi"]) for r in nodes if r["level"] == level)
        assert spans == [(k, min(k + 3**level, 100)) for k in range(0, 100, 3**level)]
    assert max(r["level"] for r in nodes) == 5
    assert merkle_manifest(table(spark, [])).count() == 0


@pytest.mark.parametrize(("name", "f"), [("op11_spelling_variants", op11_spelling_variants), ("op13_merkle_manifest", op13_merkle_manifest)])
def test_sql(spark, name, f):
    assert compare(spark, SF, f, ORACLE_SQL[name]) == ""
