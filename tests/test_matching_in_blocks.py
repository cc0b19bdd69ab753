"""Pairs that blocks decide in full, and scans that don't list all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from shelfwright.functions import text as T
from shelfwright.operators import edits, matching, search, store

SCHEMA = "batch_id string, seq long, title string"


def edit(rng, s, n, letters="abé漢 "):
    for _ in range(n):
        i = rng.randrange(len(s) + 1)
        s = rng.choice([s[:i] + rng.choice(letters) + s[i:], s[:i] + s[i + 1 :], s[:i] + rng.choice(letters) + s[i + 1 :]])
    return s


def keyed(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumn("title_key", T.title_key("title"))


def test_edits_are_counted_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(edits, "AT_ONCE", 7)
    monkeypatch.setattr(edits, "BLOCK", 30)
    rng = random.Random(4)
    stems = ["".join(rng.choice("abcdé漢") for _ in range(n)) for n in (3, 5, 9, 40, 63, 64, 65, 128, 150)]
    texts = [edit(rng, s, rng.randint(0, len(s) // 4 + 1)) for s in stems for _ in range(12)]
    nodes = spark.createDataFrame([(None if k % 5 == 0 else "b", k, t) for k, t in enumerate(texts)], "batch_id string, seq long, k string")
    x, y = (nodes.filter("length(k) >= 3").select(F.col("batch_id").alias(f"batch_{c}"), F.col("seq").alias(c), F.col("k").alias(f"k_{c}")) for c in "xy")
    n, m = F.length("k_x"), F.length("k_y")
    near = (F.abs(n - m) <= 3) & (F.levenshtein("k_x", "k_y") <= F.greatest(F.lit(1), F.floor(F.greatest(n, m) * 0.2)))
    want = sorted(tuple(r) for r in x.join(y, F.col("batch_x").eqNullSafe(F.col("batch_y")) & (F.col("x") < F.col("y"))).filter(near).select("x", "y").collect())
    assert sorted(tuple(r) for r in edits.within_edits(nodes, "k", 0.2).collect()) == want and len(want) > 100


@pytest.mark.parametrize("rule", ["title", "search"])
def test_repeated_words_and_empty_forms_are_decided_as_by_the_rule(spark, monkeypatch, rule):
    monkeypatch.setattr(edits, "BLOCK", 40)
    rng = random.Random(8)
    words = ["the", "and", "ou", "tower", "lake", "the.", "iron", "é", "red", "moon"]
    rows = [("b", k, " ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 5, 8, 70])))) for k in range(150)]
    rows += [("b", 200, "(abcd)"), ("b", 201, "[xyzwv]"), ("b", 202, "tower tower tower tower lake"), ("b", 203, "tower iron"), ("b", 204, "abc"), ("b", 205, "ABC")]
    records = keyed(spark, rows)
    match = (lambda a, b: T.fuzzy_title_match(a, b)) if rule == "title" else (lambda a, b: T.fuzzy_search_match(b, a))
    x, y = (records.filter("length(title_key) >= 3").select(F.col("seq").alias(c), F.col("title").alias(f"title_{c}")) for c in "ab")
    want = sorted(tuple(r) for r in x.join(y, F.col("a") < F.col("b")).filter(match(F.col("title_a"), F.col("title_b"))).select("a", "b").collect())
    assert sorted(tuple(r) for r in matching.fuzzy_pairs(records, rule).select("a", "b").collect()) == want and len(want) > 100


@pytest.mark.parametrize("rule", ["key", "title", "search"])
def test_pairs_come_decided_from_their_blocks(spark, rule):
    nodes = matching.nodes_of(keyed(spark, [("b", k, f"the title {k}") for k in range(50)]), rule)
    plan = matching.node_pairs(nodes, rule)._jdf.queryExecution().executedPlan().toString()
    assert "levenshtein" not in plan and plan.count("SortMergeJoin") == 1  # with the counts of blocks


def counted(monkeypatch, module):
    """How many pairs each call of the module's node_pairs lists."""
    listed, real = [], module.node_pairs

    def pairs(*a, **k):
        out = real(*a, **k)
        listed.append(out.count())
        return out

    monkeypatch.setattr(module, "node_pairs", pairs)
    return listed


def test_stored_keys_are_not_paired_among_themselves(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "LARGE", 1)
    monkeypatch.setattr(store, "ASKED", 10**9)
    listed = counted(monkeypatch, store)
    rng = random.Random(6)
    stem = "a long key that many others are near to".replace(" ", "")
    keys = sorted({edit(rng, stem, 2, "abcdef") for _ in range(120)})
    index = store.Postings(spark, str(tmp_path), "matches", {"title_key": "string"}, 2)
    index.build(spark.createDataFrame([(k,) for k in keys], "title_key string"))
    came = spark.createDataFrame([("b", 1, keys[5]), ("c", 2, stem + "x"), (None, 3, keys[7])], "batch_id string, seq long, title_key string")
    got = sorted((str(r["batch_id"]), r["seq"], r["title_key"]) for r in store.catalog_matches(came, index).collect())
    pairs = came.crossJoin(index.table.read().select(F.col("title_key").alias("s")).distinct())
    want = sorted((str(r["batch_id"]), r["seq"], r["s"]) for r in pairs.filter(T.fuzzy_key_match(F.col("s"), F.col("title_key"))).collect())
    assert got == want and len(want) > 200 and sum(listed) < 3 * 2 * len(keys) < len(keys) * (len(keys) - 1) / 2


@pytest.mark.parametrize("rule", ["title", "search"])
def test_titles_that_come_once_are_not_dealt_into_chunks(spark, monkeypatch, rule):
    dealt, real = [], matching._directed
    monkeypatch.setattr(matching, "_directed", lambda pairs: dealt.append(pairs.count()) or real(pairs))
    rows = [("b", k, f"the iron tower of the lake {k}") for k in range(40)] + [("b", 100 + k, "the iron tower of the lake 7") for k in range(3)]
    got = sorted(tuple(r) for r in matching.fuzzy_pairs(keyed(spark, rows), rule).select("a", "b").collect())
    seqs = [k for _, k, _ in rows]
    assert got == [(a, b) for a in seqs for b in seqs if a < b] and dealt == [39]


def test_a_scan_lists_few_of_the_pairs_of_many_near_titles(spark, monkeypatch):
    monkeypatch.setattr(matching, "FIRST", 8, raising=False)
    listed = counted(monkeypatch, matching)
    rng = random.Random(9)
    stems = ["the iron tower of the lake", "a moon over red water"]
    rows = [("bc"[k % 3 // 2], k, edit(rng, stems[k % 2], rng.randint(0, 4), "abcdef ")) for k in range(300)]
    records = keyed(spark, rows)
    kept = {r["seq"] for r in search.dedupe_search(records, [F.desc("seq")]).collect()}
    x, y = (records.select(F.col("batch_id"), F.col("seq").alias(c), F.col("title").alias(f"title_{c}")) for c in "ab")
    pairs = {(r["a"], r["b"]) for r in x.join(y, "batch_id").filter("a > b").filter(T.fuzzy_search_match(F.col("title_b"), F.col("title_a"))).collect()}
    want = set()
    for _, seq, _ in reversed(rows):
        if not any((a, seq) in pairs for a in want):
            want.add(seq)
    assert kept == want and len(pairs) > 5000 and sum(listed) < len(pairs) / 4
