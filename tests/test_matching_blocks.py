"""Pairs found through blocks and tokens against all pairs, and that no side of their joins goes through the driver."""

import random

import pytest
from pyspark.sql import functions as F

from shelfwright.functions import text as T
from shelfwright.operators import edits, matching, store

SCHEMA = "batch_id string, seq long, title string, title_key string"
MATCH = {"title": lambda a, b: T.fuzzy_title_match(a, b), "search": lambda a, b: T.fuzzy_search_match(b, a)}


def made_up(n):
    """Titles of few syllables, so that most share parts, with edits, of up to 90 characters, some in batches of their own."""
    rng = random.Random(11)
    syllables = ["the", "an", "and", "ou", "er", "tion", "ble", "ing", "st", "ee"]
    stems = [" ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 3))) for _ in range(rng.choice([1, 2, 5, 8, 14]))) for _ in range(n // 6)]
    out = []
    for k in range(n):
        s = rng.choice(stems)
        for _ in range(rng.randint(0, max(1, len(s) // 5))):
            i = rng.randrange(len(s) + 1)
            s = rng.choice([s[:i] + rng.choice("aet 0") + s[i:], s[:i] + s[i + 1 :]])
        out.append((rng.choice(["b", "b", "b", "c"]), k, s))
    return out


@pytest.mark.parametrize("rule", ["key", "title", "search"])
def test_pairs_equal_all_pairs_in_small_blocks_and_chunks(spark, monkeypatch, rule):
    monkeypatch.setattr(edits, "BLOCK", 20)
    monkeypatch.setattr(matching, "CHUNK", 2)
    records = spark.createDataFrame([(*r, None) for r in made_up(240)] + [("b", 1000 + k, "the same title", None) for k in range(7)], SCHEMA).withColumn("title_key", T.title_key("title"))
    taking = matching.representatives(records) if rule == "key" else records.filter("length(title_key) >= 3")
    side = lambda c: taking.select("batch_id", F.col("seq").alias(c), F.col("title_key" if rule == "key" else "title").alias(f"{c}_name"))
    names = F.col("a_name"), F.col("b_name")
    match = T.fuzzy_key_match(*names) if rule == "key" else MATCH[rule](*names)
    want = {tuple(r) for r in side("a").join(side("b"), "batch_id").filter("a < b").filter(match).select("batch_id", "a", "b").collect()}
    got = [tuple(r) for r in matching.fuzzy_pairs(records, rule).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def test_joins_of_pairs_broadcast_nothing(spark):
    records = spark.createDataFrame([(*r, None) for r in made_up(60)], SCHEMA).withColumn("title_key", T.title_key("title"))
    for rule in matching.RULES:
        assert "Broadcast" not in matching.fuzzy_pairs(records, rule)._jdf.queryExecution().executedPlan().toString()


def test_few_pairs_of_common_syllables_are_candidates(spark):
    rng = random.Random(2)
    syllables = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 4))) for _ in range(60)]
    texts = ["".join(rng.choice(syllables) for _ in range(24))[:48] for _ in range(400)]
    nodes = spark.createDataFrame([("b", k, t) for k, t in enumerate(texts)], "batch_id string, seq long, k string")
    assert edits.within_edits(nodes, "k", 0.2).count() < 400 * 399 / 2 / 100


@pytest.mark.parametrize("large", [1, 10**9])
def test_large_and_small_batches_meet_the_same_stored_keys(spark, tmp_path, monkeypatch, large):
    monkeypatch.setattr(store, "LARGE", large)
    asked = []
    monkeypatch.setattr(store, "_segments_asked", lambda *a, real=store._segments_asked: asked.append(a) or real(*a))
    rows = spark.createDataFrame([(*r, None) for r in made_up(120)] + [("c", 500, "ab", None)], SCHEMA).withColumn("title_key", T.title_key("title"))
    index = store.Postings(spark, str(tmp_path), "matches", {"title_key": "string"}, 4)
    index.build(rows.filter("seq % 3 > 0").select("title_key").distinct())
    came = rows.filter("seq % 2 = 0")
    pairs = rows.filter("seq % 3 > 0 and length(title_key) >= 3").select(F.col("title_key").alias("s")).distinct().join(matching.representatives(came), F.length("s") >= 3)
    want = sorted(tuple(r) for r in pairs.filter(T.fuzzy_key_match(F.col("s"), F.col("title_key"))).select("batch_id", "seq", "s").collect())
    assert sorted(tuple(r) for r in store.catalog_matches(came, index).collect()) == want and len(want) > 50
    assert bool(asked) == (large > 1)
