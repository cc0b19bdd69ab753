"""Merkle manifest of a dataset: hash trees over rows, with nodes labelled by the intervals of leaf ranks they cover.

Leaves are ranked within their tree. A node of level k covers the ranks [lo, hi); its parent's interval contains
its own, and the interval difference between a parent and a node is what its siblings cover. Levels are built and
read in bands of BAND: nodes of a band's lowest level whose ancestors at its top are the same share a bucket, so
containment is looked for within a bucket and level only. A tree over n leaves takes log(n) / log(FAN ** BAND)
shuffles in each direction, of one row for each bucket.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

FAN, BAND = 3, 7
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def digest(values: list[Column]) -> Column:
    """sha256 of the values, each `-` if null, else its UTF-8 byte count, `:` and the value."""
    said = [F.coalesce(F.concat(F.octet_length(v), F.lit(":"), v), F.lit("-")) for v in (v.cast("string") for v in values)]
    return F.sha2(F.concat(*said), 256)


def tampered_text(doc_id: Column, text: Column) -> Column:
    """The text without line feeds where 2 divides the crc32 of the decimal doc_id."""
    return F.when(F.crc32(doc_id.cast("string").cast("binary")) % 2 == 0, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text)


def with_ranks(leaves: DataFrame, order: list[str]) -> DataFrame:
    """leaves(tree, ...) with lo, the rank in the tree from 0, and n, the tree's leaves.

    Rows are dealt by ranges of (tree, order); a row's rank is its place in its range behind the tree's rows in
    the ranges before. So no tree needs a task of its own; rows equal in tree and order are told by where they
    were read, and may take each other's rank.
    """
    ranged = materialize(leaves.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange("tree", *order, "_tie").withColumn("_range", F.spark_partition_id()), "ranged")
    counts = ranged.groupBy("tree", "_range").agg(F.count("*").alias("_n"))
    trees = counts.groupBy("tree").agg(F.sum("_n").alias("n"), F.array_sort(F.collect_list(F.struct("_range", "_n"))).alias("_ranges"))
    # one entry for each range that the tree's rows lie in, at most as many as partitions
    before = F.transform("_ranges", lambda r, i: F.struct(r["_range"].alias("_range"), F.aggregate(F.slice("_ranges", 1, i), F.lit(0).cast("long"), lambda a, x: a + x["_n"]).alias("_before")))
    offsets = trees.select("tree", "n", F.inline(before))
    place = F.row_number().over(Window.partitionBy("tree", "_range").orderBy(*order, "_tie")) - 1
    o = offsets.withColumnsRenamed({"tree": "_t", "_range": "_r"})
    joined = ranged.withColumn("_place", place).join(o, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("_range") == F.col("_r")))
    return joined.withColumn("lo", F.col("_before") + F.col("_place")).drop("_tie", "_range", "_place", "_t", "_r", "_before")


def _at(k: int) -> Column:
    return F.col(f"l{k}")


def _parents(level: Column) -> Column:
    """The nodes above those of an array of nodes in order: each run of FAN becomes one, a shorter last run too."""

    def parent(i: Column) -> Column:
        run = F.slice(level, i * FAN + 1, FAN)
        h = F.sha2(F.array_join(F.transform(run, lambda x: x["h"]), ""), 256)
        return F.struct(F.element_at(run, 1)["lo"].alias("lo"), F.element_at(run, -1)["hi"].alias("hi"), h.alias("h"))

    return F.transform(F.sequence(F.lit(0), F.ceil(F.size(level) / FAN).cast("int") - 1), parent)


def _buckets(nodes: DataFrame, level: int) -> DataFrame:
    """nodes(tree, n, lo, hi, h, own) of one level, in buckets under one ancestor BAND levels above: l0 has them in order, l1 to l{BAND} their ancestors, null above the tree's root."""
    bucket = F.floor(F.col("lo") / FAN ** (level + BAND))
    held = nodes.groupBy("tree", "n", bucket.alias("bucket")).agg(F.array_sort(F.collect_list(F.struct("lo", "hi", "h", "own"))).alias("l0"))
    for k in range(BAND):
        held = held.withColumn(f"l{k + 1}", F.when(F.col("n") > FAN ** (level + k), _parents(_at(k))))
    return held


def _siblings(k: int, lo: Column, place: Column) -> Column:
    """What stands left and right of a member's ancestor at level k of the band, under its parent: the parent's interval without the ancestor's."""
    run = F.floor(place / FAN ** (k + 1)).cast("int")
    parent = F.get(_at(k + 1), run)
    inside = F.filter(F.slice(_at(k), run * FAN + 1, FAN), lambda x: (x["lo"] >= parent["lo"]) & (x["hi"] <= parent["hi"]))
    left, right = F.filter(inside, lambda x: x["hi"] <= lo), F.filter(inside, lambda x: x["lo"] > lo)
    joined = lambda nodes: F.array_join(F.transform(nodes, lambda x: x["h"]), "")
    return F.when(_at(k + 1).isNotNull(), F.struct(joined(left).alias("left"), joined(right).alias("right")))


def _member(m: Column, place: Column) -> Column:
    """A member of a bucket with its path: its siblings in the band, then those of the bucket."""
    inside = F.filter(F.array(*[_siblings(k, m["lo"], place) for k in range(BAND)]), lambda x: x.isNotNull())
    return F.struct(*[m[c].alias(c) for c in ("lo", "hi", "h", "own")], F.concat(inside, F.col("up")).alias("path"))


def interval_tree(leaves: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Trees over leaves(tree, n, lo, h, own): the leaves with path, an entry (left, right) of sibling digests for each level upwards, and root; and the bands of nodes, written.

    `own` is a column that a leaf carries along. A lone leaf is its tree's root and has an empty path.
    """
    most = leaves.agg(F.max("n")).first()[0] or 0
    nodes, level, bands = leaves.withColumn("hi", F.col("lo") + 1), 0, []
    while True:
        held = materialize(_buckets(nodes, level), "buckets")
        bands.append(held)
        level += BAND
        if most <= FAN**level:
            break
        nodes = held.filter(F.col("n") > FAN**level).select("tree", "n", F.inline(_at(BAND))).withColumn("own", F.lit(None).cast("int"))
    above = None
    for b in range(len(bands) - 1, -1, -1):
        held = bands[b]
        root = F.coalesce(*[F.when(F.size(_at(k)) == 1, F.element_at(_at(k), 1)["h"]) for k in range(BAND, -1, -1)])
        kind = "array<struct<left:string,right:string>>"
        if above is None:
            held = held.withColumns({"up": F.array().cast(kind), "root": root})
        else:
            # the bucket's top node lies in the interval of one node of the band above
            a, size = above.select(F.col("tree").alias("_t"), F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.col("path").alias("up"), F.col("root").alias("_root")), FAN ** ((b + 1) * BAND)
            a = a.withColumn("_bucket", F.floor(F.col("_lo") / size))
            first = F.element_at(F.col("l0"), 1)["lo"]
            held = held.join(a, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("bucket") == F.col("_bucket")) & (F.col("_lo") <= first) & (first < F.col("_hi")), "left")
            held = held.withColumns({"up": F.coalesce("up", F.array().cast(kind)), "root": F.coalesce("_root", root)})
        above = held.select("tree", "n", "root", F.inline(F.transform("l0", _member)))
    return above, bands


def _labelled(nodes: Column, level: int) -> Column:
    return F.transform(nodes, lambda x: F.struct(F.lit(level).alias("level"), x["lo"].alias("lo"), x["hi"].alias("hi"), x["h"].alias("h")))


def tree_nodes(bands: list[DataFrame]) -> DataFrame:
    """All nodes (tree, level, lo, hi, h) of the trees whose bands interval_tree gave, leaves and roots among them."""
    parts = []
    for b, held in enumerate(bands):
        lists = []
        for k in range(BAND + (b + 1 == len(bands))):
            lists.append(F.coalesce(_labelled(_at(k), b * BAND + k), F.array().cast("array<struct<level:int,lo:bigint,hi:bigint,h:string>>")))
        parts.append(held.select("tree", F.inline(F.concat(*lists))))
    return reduce(DataFrame.unionByName, parts)


def _proof(path: Column) -> Column:
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["left"], x["right"])), ""), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path of siblings give."""
    return F.aggregate(path, leaf, lambda h, x: F.sha2(F.concat(x["left"], h, x["right"]), 256))


def manifest(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, source, leaf, tampered, subroot, root, path) of docs, and the nodes (tree, level, lo, hi, h) of the sources' trees.

    tampered is the leaf of the row as it is after tampered_text.
    """
    c = {f: F.col(f) for f in FIELDS}
    changed = digest([tampered_text(c["doc_id"], c["text"]) if f == "text" else c[f] for f in FIELDS])
    rows = docs.select(c["source"].cast("string").alias("tree"), c["doc_id"].cast("long").alias("doc_id"), digest(list(c.values())).alias("h"), changed.alias("tampered"))
    ranks = with_ranks(rows, ["doc_id", "h"])
    leaves, bands = interval_tree(ranks.select("tree", "n", "lo", "h", F.struct("doc_id", "tampered").alias("own")))
    leaves = materialize(leaves, "paths")
    tops = leaves.groupBy("tree").agg(F.first("root").alias("h"))
    sources = with_ranks(tops.select(F.lit(0).alias("tree"), F.col("tree").alias("source"), "h"), ["source"])
    sources, _ = interval_tree(sources.select("tree", "n", "lo", "h", F.struct("source").alias("own")))
    s = materialize(sources.select(F.col("own.source").alias("_source"), F.col("path").alias("_up"), F.col("root").alias("_root")), "sources")
    rows = leaves.join(s, F.col("tree").eqNullSafe(F.col("_source")))
    return rows.select(F.col("own.doc_id").alias("doc_id"), F.col("tree").alias("source"), F.col("h").alias("leaf"), F.col("own.tampered").alias("tampered"), F.col("root").alias("subroot"), F.col("_root").alias("root"), F.concat("path", "_up").alias("path")), tree_nodes(bands)


def merkle_manifest(docs: DataFrame) -> DataFrame:
    """For each of docs(doc_id, source, lang, n_chars, text): its leaf, its source's and the dataset's root, a digest of its proof, and whether the row, tampered with, still proves.

    A null field counts as `-`; a null doc_id comes first in its source and is not tampered with; repeated rows are
    leaves each; an empty table gives no rows; other columns are ignored.
    """
    rows = manifest(docs)[0]
    out = rows.withColumn("folded_root", folded(F.col("tampered"), F.col("path")))
    return out.select("doc_id", "leaf", "subroot", "root", _proof(F.col("path")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
