"""The operators against plain Python on made-up tables that hold what they are for, and the pipeline's stages."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from shelfwright.llm import quality as Q
from shelfwright.llm.licenses import license_scan
from shelfwright.llm.near_dups import near_duplicates
from shelfwright.llm.packing import best_fit, best_fit_packing, lower_bound
from shelfwright.llm.pii import pii_report, sanitize
from shelfwright.llm.quality import quality_rules
from shelfwright.llm.secrets import held_out
from shelfwright.llm.sentencepieces import pieces_of
from shelfwright.llm.topk import exact_top_k
from shelfwright.llm.html_text import extract_main_text

DOCS = "doc_id long, text string, lang string, source string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "src") for i, t in rows], DOCS)


def words_of(rng, n, letters="etaoinshrdlu"):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(2, 8))) for _ in range(n)]


def test_packing_in_small_shards(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(21)
    rows = [(i, " ".join(words_of(rng, rng.choice([0, 3, 60, 300, 900, 1500])))) for i in range(160)] + [(7, "twice"), (7, "twice"), (None, None), (200, "x " * 5000), (201, "MiXed Case, 12.5 & <|endoftext|> é中")]
    run = lambda r: best_fit_packing(table(spark, r), shard_pieces=20).collect()
    got = run(rows)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = []
    for i, t in rows:
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        expected += [(i, k, 2048 * k, len(p), zlib.crc32(p.tobytes())) for k, p in enumerate(ids[j : j + 2048] for j in range(0, len(ids), 2048))]
    assert sorted(map(repr, ((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got))) == sorted(map(repr, expected))
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        ends = np.cumsum([n for _, n in sorted(places)])
        assert [a for a, _ in sorted(places)] == [0, *ends[:-1]] and ends[-1] <= 2048
    lengths = np.array([r["length"] for r in got])
    assert lower_bound(lengths, 2048) <= len(bins) <= best_fit(lengths, 2048)[0].max() + 1 + 4  # nearly as few as without shards
    assert all(r["shard_bins"] >= r["shard_bound"] for r in got)
    rng.shuffle(rows)
    key = lambda rs: sorted(repr(tuple(r)) for r in rs)
    assert key(run(rows)) == key(got)


def shingles(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w)} if 0 < len(w) < size else {tuple(w[k : k + size]) for k in range(len(w) - size + 1)}


def components(rows, size):
    sets = [shingles(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return [(i, len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(rows)]


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_around_the_bound(spark, size):
    """Families whose members lie from 0.6 to 1 from each other, so that hubs are no links, buckets are mixed, and chains join."""
    rng = random.Random(31)
    rows, ids = [], iter(rng.sample(range(10_000), 1000))
    for _ in range(8):
        base = words_of(rng, rng.choice([60, 150, 400]))
        own = [base]
        for _ in range(24):
            new = list(rng.choice(own))
            for _ in range(rng.randint(0, max(1, len(base) // (8 * size)))):
                new[rng.randrange(len(new))] = rng.choice(base) + "x"
            own.append(new)
        rows += [(next(ids), " ".join(w)) for w in own]
    rows += [(next(ids), t) for t in ("one", "ONE", "one two", "two one", "", None, "  \t")]
    expected = components(rows, size)
    found = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_duplicates(table(spark, rows), size=size).collect())
    assert found == sorted(expected)
    assert 10 < len({c for *_, c in expected}) < len(rows) - 60


def test_quality_by_plain_distances(spark):
    rng = random.Random(41)
    common = {"en": "the of and to in".split(), "de": "der die und den von".split()}
    rows = []
    for i in range(240):
        lang = rng.choice(["en", "de"])
        text = " ".join(rng.choice(common[lang]) if rng.random() < 0.35 else w for w in words_of(rng, rng.choice([30, 90, 300]), "etaoinshrdlu" if lang == "en" else "enisratdhulcg"))
        if i % 7 == 0:
            text = " ".join(rng.choice("#$%&*<>|0123456789") * rng.randint(1, 6) for _ in range(120))
        if i % 11 == 0:
            text = "\n".join(["a b c d", "", "x é y", *text.split("|")] * 2)
        rows.append((i, text, lang, "s"))
    docs = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: r for r in quality_rules(docs).collect()}

    def base(t):
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        windows = Counter(zip(words, words[1:], words[2:]))
        repeat = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
        lines, seen, dup = t.split("\n"), set(), 0
        for x in lines:
            if x.strip(" \t\n\r\x0b\x0c"):
                dup += x in seen
                seen.add(x)
        return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(repeat)

    def histograms(t):
        chars, words = Counter(), Counter()
        for c in t:
            kind = c.lower() if c.lower() in "abcdefghijklmnopqrstuvwxyz" and c.isascii() else "digit" if c in "0123456789" else "blank" if c in " \t" else "line" if c in "\n\r\x0b\x0c" else "mark" if c in ".,;:!?'\"()-" else "sign" if 33 <= ord(c) < 127 else "other" if ord(c) > 127 else "control"
            chars[kind] += 1
        for w in re.findall(r"[^\x20\x09-\x0D]+", t.lower()):
            words[w if w in Q.COMMON_WORDS else ""] += 1
        return chars, words

    def distance(p, q):
        a, b = sum(p.values()), sum(q.values())
        if not a:
            return 1.0
        out = 0.0
        for k in {*p, *q}:
            x, y = p[k] / a, q[k] / b
            m = (x + y) / 2
            out += (x * math.log2(x / m) if x else 0) / 2 + (y * math.log2(y / m) if y else 0) / 2
        return math.sqrt(max(out, 0))

    facts = {i: base(t) for i, t, *_ in rows}
    failed = {i: f[0] < 50 or 100 * f[4] > 50 * f[0] for i, f in facts.items()}
    hists = {i: histograms(t) for i, t, *_ in rows}
    refs = {}
    for i, _, lang, _ in rows:
        if not failed[i]:
            ref = refs.setdefault(lang, (Counter(), Counter()))
            for total, own in zip(ref, hists[i]):
                total.update(own)
    assert all(sum(w.values()) >= Q.REFERENCE_WORDS for _, w in refs.values())
    for i, *_ in rows:
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == (*facts[i], failed[i])
        pairs = [(distance(hists[i][0], c), distance(hists[i][1], w)) for c, w in refs.values()]
        near = any(c <= 0.33 and (w <= 0.325 or facts[i][0] < 100) for c, w in pairs)
        assert r["kept"] == (near and not failed[i])
        best = min(pairs, key=sum)
        assert abs(r["char_distance"] - best[0]) < 1e-9 and abs(r["word_distance"] - best[1]) < 1e-9
    assert 20 < sum(r["kept"] for r in got.values()) < 220 and any(not r["kept"] and not r["base_failed"] for r in got.values())


def test_license_places(spark):
    rng = random.Random(51)
    bits = ["MIT", "License", "license,", "apache", "general", "Public", "license", "the", "É", "a-b", "\n", "licenses", "gnu"]
    rows = [(i, " ".join(rng.choice(bits) for _ in range(rng.randint(0, 60)))) for i in range(200)] + [(900, None), (901, "MIT license"), (902, "MIT" + "." * 50 + "LICENSE")]
    phrases = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}
    for r in license_scan(table(spark, rows)).collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), dict(rows)[r["doc_id"]] or ""))
        at = [(k, label) for k in range(len(words)) for p, label in phrases.items() if tuple(words[k : k + len(p)]) == p]
        starts = [k for k, _ in at]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(at), min(starts, default=None), max(starts, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in at})) and {x for _, x in at} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_secrets_held_out(spark):
    rng = random.Random(61)
    rows = [(i, " ".join(words_of(rng, 80))) for i in range(30)]
    got = {(r["label"], r["accepted"]): r["n"] for r in held_out(table(spark, rows)).collect()}
    right, missed, wrong = got.get((1.0, True), 0), got.get((1.0, False), 0), got.get((0.0, True), 0)
    assert right + missed >= 20 and right / (right + missed) >= 0.85 and right / (right + wrong) >= 0.8


def luhn(digits):
    return sum(sum(divmod(2 * int(d), 10)) if k % 2 else int(d) for k, d in enumerate(reversed(digits))) % 10 == 0


def base_spans(t):
    kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]
    out = []
    for k, (kind, pattern) in enumerate(kinds):
        for m in re.finditer(pattern, t):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else True, "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if good:
                out.append((m.start(), k, m.end(), kind))
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out))


def test_pii_base_spans(spark):
    rng = random.Random(71)
    bits = ["a@b.cd", "x.y@z", "@", ".", "1.2.3.4", "256.1.1.1", "1.2.3.4.5", "4587121519400672", "4587 1215 1940 0672", "+1 (835) 555-6426", "+", "12", " ", "-", "é", "😀", "\n", "name", "+49.30.1234567", "0000000000000"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))) for i in range(300)]
    for r in pii_report(table(spark, rows)).collect():
        own = ",".join(x for x in r["spans"].split(",") if x and not x.startswith("term"))
        assert own == base_spans(dict(rows)[r["doc_id"]])


def test_pii_terms_tell_of_entities(spark):
    rng = random.Random(81)
    filler = words_of(rng, 60)
    prose = lambda n: " ".join(rng.choice(filler) for _ in range(n))
    rows = [(i, prose(120)) for i in range(40)]
    rows += [(100 + i, f"{prose(40)} write to Zebulon at zq@mail.org {prose(40)}") for i in range(8)]
    rows += [(200, f"Zebulon came first. {prose(60)} and then zq@mail.org"), (201, f"Zebulon alone {prose(20)}"), (202, f"{prose(10)} another@mail.org {prose(10)}")]
    found = {r["doc_id"]: r["spans"] for r in pii_report(table(spark, rows)).collect()}
    terms = {i: {dict(rows)[i][int(a) : int(b)] for kind, a, b in (s.split(":") for s in spans.split(",") if s) if kind == "term"} for i, spans in found.items()}
    assert all("Zebulon" in terms[100 + i] for i in range(8)) and "Zebulon" in terms[200]  # also far from the address
    assert not any(terms[i] for i in (*range(40), 201, 202)) and not any(set(filler) & terms[100 + i] for i in range(8))
    clean = {r["doc_id"]: r["text"] for r in sanitize(table(spark, rows)).collect()}
    assert not any("zq@" in t or i != 201 and "Zebulon" in t for i, t in clean.items()) and clean[0] == rows[0][1]


def test_pii_of_one_very_long_text(spark):
    text = " ".join(f"user{i}@mail{i % 7}.example.org wrote" for i in range(20_000))
    r = pii_report(table(spark, [(1, text)])).first()
    assert r["n_email"] == 20_000
    assert sanitize(table(spark, [(1, text)])).first()["text"].count("[EMAIL]") == 20_000


def test_pieces_equal_the_library_on_long_and_odd_texts():
    import public_tokenizers
    import sentencepiece

    model, own = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model")), pieces_of()
    rng = random.Random(91)
    texts = ["a\0b", "\0", "x" * 5000 + "é😀" * 900, " " * 300, "=-" * 2000, "▁a ▁▁b", "\n\n x"] + ["".join(rng.choice("aeiou thrs éß中1,\n") for _ in range(rng.randint(1, 400))) for _ in range(400)]
    assert [np.frombuffer(b, "<u4").tolist() for b in own.encode(texts)] == [model.encode(t) for t in texts]


def test_pages_and_vectors_at_the_edges(spark):
    pages = "page_id long, url string, html string, text string, n_chars string, dim string, x string"
    rows = [(1, "u", "<p>a&amp;b", "t", "n", None, None), (1, "u", "<p>a&amp;b", "t", "n", None, None), (None, None, None, None, None, None, None), (2, "u", "", None, None, None, None)]
    got = extract_main_text(spark.createDataFrame(rows, pages)).select("page_id", "url", "text", "n_chars").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([(1, "u", "a&b", 3)] * 2 + [(None, None, "", 0), (2, "u", "", 0)], key=repr)
    assert extract_main_text(spark.createDataFrame([], pages)).collect() == []
    vectors = "vec_id long, embedding array<double>, x string, dim string, cell string, score string"
    assert exact_top_k(spark.createDataFrame([], vectors)).collect() == []
    rows = [(0, [1.0, 2.0], "a", "b", "c", "d"), (1, [1.0, 2.0], None, None, None, None), (1, [1.0, 2.0], None, None, None, None), (2, None, None, None, None, None), (None, [1.0, 1.0], None, None, None, None)]
    assert [tuple(r) for r in exact_top_k(spark.createDataFrame(rows, vectors)).orderBy("rank").collect()] == [(0, 1, 1, 327680), (0, 2, 1, 327680)]


CLASHING = ["row", "kept", "spans", "_id", "_hash", "_cuts", "terms", "doc", "sub", "text_hash"]


def test_stages(spark):
    """Each stage on what its predecessor kept, with nulls, repeated rows, a repeated id and columns with names that stages use themselves."""
    rng = random.Random(99)
    schema = DOCS + "".join(f", `{c}` string" for c in CLASHING)
    more = [f"{c}!" for c in CLASHING]
    long = lambda: " ".join(rng.choice(["the", "of", "and", *words_of(rng, 3)]) for _ in range(120))
    passage = long()
    texts = [(i, long()) for i in range(150)]
    texts += [(300, texts[3][1]), (301, texts[3][1] + " end"), (302, long() + " " + passage), (303, long() + " " + passage), (304, long() + " write to a@b.cd or +1 (835) 555-6426 now")]
    texts += [(400, texts[5][1]), (400, long()), (401, long()), (401, None), (402, None), (403, ""), (None, long())]
    texts += [texts[-4]] * 2 + [(500, "word " * 200)]
    docs = spark.createDataFrame([(i, t, "en", "s", *more) for i, t in texts], schema)
    repeated = (404, long())
    docs = docs.union(spark.createDataFrame([(*repeated, "en", "s", *more)] * 3, schema))
    counts = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = spark.createDataFrame(stage(spark, docs, None).collect(), schema)
        assert docs.columns == before.columns
        rows = docs.collect()
        assert all([r[c] for c in CLASHING] == more for r in rows)
        counts[name] = Counter(r["doc_id"] for r in rows)
        assert stage(spark, before.limit(0), None).collect() == []
    assert not {402, 403, 500} & set(counts["quality_rules"]) and counts["quality_rules"][404] == 3
    near = counts["near_duplicates"]
    assert counts["quality_rules"][400] == 2 and counts["quality_rules"][None] == 1
    assert near[3] == 1 and not near[300] and not near[301] and near[404] == 1 and near[400] == 1 and near[None] == 1
    final = {r["doc_id"]: r["text"] for r in rows}
    assert (passage in final[302]) and (passage not in final[303])
    assert "[EMAIL]" in final[304] and "555-6426" not in final[304]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, None).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in rows}


def test_run_equals_the_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    key = lambda df: sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in df.collect())
    got = key(corpus_pipeline.run(spark, sf))
    assert got == key(docs) and got
