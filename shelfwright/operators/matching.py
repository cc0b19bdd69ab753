"""Pairs of records that name the same work, and the scan in order that keeps the first of those that match.

Records with the same title are one node, so a title that comes a hundred thousand times is compared once. Nodes
meet in blocks, where the rule decides on columns that were made once for each node. Joins whose sides grow with the
records are merges, so none of them is sent through the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import roman_key, search_key, search_words, title_key, title_words
from ..sources.folders import forget, written
from .edits import AHEAD, BACK, SALTS, Near, matched
from .edits import Rule as Decided


def representatives(records: DataFrame) -> DataFrame:
    """The first record of each key of a batch; keys under three characters take no part."""
    return records.filter(F.length("title_key") >= 3).groupBy("batch_id", "title_key").agg(F.min("seq").alias("seq"))


@dataclass
class Rule:
    """How two nodes (k, r, w), a found before, are decided: as functions.text does in key_match(a, b), title_match(a, b) and search_match(b, a); the form r and the words w of a name."""

    decided: Decided
    form: Callable[[Column], Column]
    words: Callable[[Column], Column] | None = None


RULES = {
    "key": Rule(Decided((Near("k", 0.2, 5), Near("r", 0.15, 3)), 0.7, 6, True), lambda t: roman_key(title_key(t))),
    "title": Rule(Decided((Near("k", 0.2, 5), Near("r", 0.15, 3)), 0.7, 6, True, 0.7), roman_key, title_words),
    "search": Rule(Decided((Near("k", 0.2, 5), Near("r", None)), 0.65, 5, False, 0.7, second=True), search_key, search_words),
}

#: Sizes of the begins by which contained keys are found: a key is looked for by the longest that it has.
BEGINS = (6, 8, 11, 15, 20, 27, 36, 48)
#: Stored keys above this length meet those of about their length, as segments with their places would grow with its square.
LONG = 200
#: Records of a node that meet those of another in a task.
CHUNK = 1000


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def nodes_of(records: DataFrame, rule: str) -> DataFrame:
    """The nodes of records(batch_id, seq, title, title_key), written: batch_id, name (the key for "key", else the title), seq (the first that has it), k, r, w and whether `many` records have it."""
    how, named = RULES[rule], "title_key" if rule == "key" else "title"
    first = records.filter(F.length("title_key") >= 3).groupBy("batch_id", F.col(named).alias("name"), F.col("title_key").alias("k")).agg(F.min("seq").alias("seq"), (F.count("*") > 1).alias("many"))
    words = how.words(F.col("name")) if how.words else F.lit(None).cast("array<string>")
    return written(first.select("batch_id", "name", "seq", "k", how.form(F.col("name")).alias("r"), words.alias("w"), "many"), "nodes")


def _ahead(pairs: DataFrame) -> DataFrame:
    return pairs.filter(F.col("ways").bitwiseAND(AHEAD) > 0).select("batch_id", "a", "b")


def _directed(pairs: DataFrame) -> DataFrame:
    """Pairs in the ways in which the rule holds for them."""
    way = lambda bit, a, b: F.when(F.col("ways").bitwiseAND(bit) > 0, F.struct(F.col(a).alias("a"), F.col(b).alias("b")))
    return pairs.select("batch_id", F.inline(F.filter(F.array(way(AHEAD, "a", "b"), way(BACK, "b", "a")), lambda w: w.isNotNull())))


def node_pairs(nodes: DataFrame, rule: str, both: bool = False) -> DataFrame:
    """Pairs (batch_id, a, b) of a batch's nodes that the rule matches, the one found before first; with `both` also the other way where the rule holds for it. Of nodes that are marked (led), those that are meet those that aren't."""
    pairs = matched(nodes, RULES[rule].decided)
    return _directed(pairs) if both else _ahead(pairs)


def fuzzy_pairs(records: DataFrame, rule: str = "key") -> DataFrame:
    """Pairs (batch_id, a, b), a before b, of a batch's records that a rule matches.

    "key" compares keys of representatives (see there for the other records), "title" whole titles, "search"
    whole titles as search results: b is held against a, found before. Keys under three characters take no part.
    All pairs of equal titles are among them, so their number may be large; a scan needs only node_pairs.
    """
    nodes = nodes_of(records, rule)
    if rule == "key":
        return node_pairs(nodes, rule)
    nodes = nodes.filter("batch_id IS NOT NULL AND name IS NOT NULL")
    pairs = written(matched(nodes, RULES[rule].decided), "pairs")
    of = records.filter(F.length("title_key") >= 3).select("batch_id", F.col("title").alias("name"), F.col("seq").alias("member"))
    members = written(of.join(nodes.select("batch_id", "name", "seq").hint("merge"), ["batch_id", "name"]).select("batch_id", "seq", "member"), "members")
    # a node's records in chunks, so that those of no node meet others in one task
    chunks = written(members.groupBy("seq").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")), "chunks")
    dealt = members.join(chunks.hint("merge"), "seq").withColumn("chunk", F.pmod(F.xxhash64("member"), F.col("chunks")).cast("int"))
    each = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    place = lambda c: chunks.select(F.col("seq").alias(c), each.alias(f"{c}_chunk")).hint("merge")
    side = lambda c: dealt.select(F.col("seq").alias(c), F.col("chunk").alias(f"{c}_chunk"), F.col("member").alias(f"{c}_member")).hint("merge")
    apart = _directed(pairs.filter("many")).join(place("a"), "a").join(place("b"), "b").join(side("a"), ["a", "a_chunk"]).join(side("b"), ["b", "b_chunk"])
    held = dealt.join(nodes.filter("many").select("seq").hint("merge"), "seq", "left_semi")
    spread = held.select("seq", F.col("member").alias("b_member"), each.alias("chunk")).hint("merge")
    equal = held.select("batch_id", "seq", "chunk", F.col("member").alias("a_member")).join(spread, ["seq", "chunk"])
    columns = ["batch_id", F.col("a_member").alias("a"), F.col("b_member").alias("b")]
    return apart.select(*columns).union(equal.select(*columns)).filter("a < b").union(_ahead(pairs.filter("NOT many")))


# --- the scan in order


def components(pairs: DataFrame) -> DataFrame:
    """node and component (its smallest node) of pairs(a, b): neighbours are drawn to the smallest one, larger and smaller ones in turn, until all hang on their component's smallest."""
    edges, before = written(pairs.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).filter("v <> u").distinct(), "edges"), None
    while True:
        each = edges.union(edges.select("u", "v"))
        least = each.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        large = each.join(least, "v").filter("u > v").select(F.col("u").alias("v"), F.col("m").alias("u"))
        small = large.groupBy("v").agg(F.min("u").alias("m"))
        joined = large.join(small, "v")
        now = written(joined.select("v", F.col("m").alias("u")).union(joined.filter("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))).distinct(), "edges")
        forget(edges)
        edges, state = now, now.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first()
        if state == before:
            break
        before = state
    return edges.select(F.col("v").alias("node"), F.col("u").alias("component")).union(edges.select(F.col("u").alias("node"), F.col("u").alias("component"))).distinct()


#: Pairs of a component that one task scans.
SCANNED = 200_000


def _scanned(rows: pd.DataFrame) -> pd.DataFrame:
    """The scan of one component: rows (a, b), a before b."""
    before: dict[int, list[int]] = {}
    for a, b in zip(rows["a"], rows["b"], strict=True):
        before.setdefault(b, []).append(a)
        before.setdefault(a, [])
    leader: dict[int, int] = {}
    for node in sorted(before):
        leader[node] = min((a for a in before[node] if leader[a] == a), default=node)
    return pd.DataFrame({"seq": list(leader), "leader": list(leader.values())})


def scan_leaders(nodes: DataFrame, pairs: DataFrame, most: int = SCANNED) -> DataFrame:
    """seq and leader of nodes(seq): scanning in order, a node joins the first earlier leader that pairs(a, b) links it with, else it leads.

    What a node becomes hangs on its component alone. Components of up to `most` pairs are scanned each in one
    task; in larger ones a round decides all nodes whose earlier neighbours are decided.
    """
    pairs = written(pairs.select("a", "b").distinct(), "pairs")
    found = written(components(pairs), "components")
    dealt = pairs.join(found.withColumnRenamed("node", "a"), "a")
    large = written(dealt.groupBy("component").agg(F.count("*").alias("n")).filter(F.col("n") > most).select("component"), "large")
    led = dealt.join(large, "component", "left_anti").select("component", "a", "b").groupBy("component").applyInPandas(_scanned, "seq long, leader long")
    if not large.isEmpty():
        held = found.join(large, "component", "left_semi").select(F.col("node").alias("seq"))
        led = led.union(_rounds(held, dealt.join(large, "component", "left_semi").select("a", "b")))
    return nodes.select("seq").join(led, "seq", "left").select("seq", F.coalesce("leader", "seq").alias("leader"))


def _rounds(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """scan_leaders for large components: in each round the open nodes that an earlier leader meets join it, and those without open earlier neighbours lead; pairs of nodes that are decided go."""
    left, open_ = written(pairs, "pairs"), written(nodes, "open")
    done: list[DataFrame] = []
    while not open_.isEmpty():
        leading = open_.join(left.select(F.col("b").alias("seq")), "seq", "left_anti")
        joined = left.join(leading.select(F.col("seq").alias("a")), "a", "left_semi").select(F.col("b").alias("seq")).distinct()
        now = written(leading.withColumn("leads", F.lit(True)).union(joined.withColumn("leads", F.lit(False))), "decided")
        done.append(now)
        gone = now.select("seq")
        rest = left.join(gone.withColumnRenamed("seq", "a"), "a", "left_anti").join(gone.withColumnRenamed("seq", "b"), "b", "left_anti")
        left_now, open_now = written(rest, "pairs"), written(open_.join(gone, "seq", "left_anti"), "open")
        forget(left, open_)
        left, open_ = left_now, open_now
    state = _all(done)
    first = pairs.join(state.filter("leads").select(F.col("seq").alias("a")), "a", "left_semi").groupBy(F.col("b").alias("seq")).agg(F.min("a").alias("first"))
    return state.join(first, "seq", "left").select("seq", F.when(F.col("leads"), F.col("seq")).otherwise(F.col("first")).alias("leader"))


#: Nodes of a large batch that are scanned first, at least, and how many times as many the next stretches reach.
FIRST, WIDER = 8192, 4


def leaders(nodes: DataFrame, rule: str) -> DataFrame:
    """seq of the nodes of nodes_of that lead in the scan in order.

    Large batches are scanned in stretches of the order. What leads in one meets the nodes behind it, and those it
    matches go, so that only few of many nodes that all match each other are ever paired among themselves.
    """
    most = nodes.groupBy("batch_id").count().agg(F.max("count")).first()[0] or 0
    shares = []
    while most * (shares[0] if shares else 1) / WIDER >= FIRST:
        shares.insert(0, (shares[0] if shares else 1) / WIDER)
    left, done = nodes.withColumn("stretch", F.lit(0)), []
    if shares:
        salt = F.pmod(F.xxhash64("seq"), F.lit(SALTS)).cast("int")
        ends = nodes.groupBy(F.xxhash64("batch_id").alias("batch")).agg(F.percentile_approx("seq", shares).alias("ends"))
        copies = written(ends.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), "ends")
        placed = nodes.withColumn("batch", F.xxhash64("batch_id")).withColumn("salt", salt).join(copies.hint("merge"), ["batch", "salt"])
        left = written(placed.withColumn("stretch", F.size(F.filter("ends", lambda e: e < F.col("seq")))).select(*nodes.columns, "stretch"), "left")
    for k in range(len(shares) + 1):
        now, rest = left.filter(F.col("stretch") == k), left.filter(F.col("stretch") > k)
        led = scan_leaders(now, node_pairs(now, rule)).filter("seq = leader").select("seq")
        if k == len(shares):
            return _all([*done, led])
        done.append(written(led, "led"))
        marked = now.join(done[-1].hint("merge"), "seq", "left_semi").withColumn("led", F.lit(True)).unionByName(rest.withColumn("led", F.lit(False)))
        gone = node_pairs(marked, rule).select(F.col("b").alias("seq")).distinct()
        left = written(rest.join(gone.hint("merge"), "seq", "left_anti"), "left")


def fuzzy_cluster(records: DataFrame, pairs: DataFrame) -> DataFrame:
    """seq and its leader: scanning in order, a record joins the first earlier leader it matches, else it leads.

    The representatives are scanned; a record with an earlier one's key matches what that one matches.
    """
    reps = written(representatives(records), "representatives")
    led = scan_leaders(reps, pairs)
    return records.select("batch_id", "title_key", "seq").join(reps.join(led, "seq").select("batch_id", "title_key", "leader"), ["batch_id", "title_key"]).select("seq", "leader")


def in_order(df: DataFrame, order: list[Column | str]) -> DataFrame:
    """df, written, with seq: numbers that go up with the order, with gaps. Rows are dealt by ranges of it, so no task gets all."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(ranged.withColumn("seq", F.monotonically_increasing_id()), "in_order")
