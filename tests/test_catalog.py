"""Every registered catalog query against its SQL at the smallest scale, and the clustering against a sequential scan."""

import pytest

from shelfwright import catalog_queries, detail_queries, search_queries, store_queries  # noqa: F401
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog_queries.ORACLES))
def test_oracle(spark, name):
    assert compare(spark, SF, catalog_queries.QUERIES[name], catalog_queries.ORACLES[name]) == ""


def test_clusters_equal_a_sequential_scan(spark):
    from shelfwright.operators.catalog import fuzzy_cluster, fuzzy_pairs
    from shelfwright.sources.adapters import records

    r = records(spark, SF)
    pairs = {(x["a"], x["b"]) for x in fuzzy_pairs(r).collect()}
    rows = sorted((x["seq"], x["batch_id"], x["title_key"]) for x in r.collect() if len(x["title_key"] or "") >= 3)
    rep = {}
    for seq, *key in rows:
        rep.setdefault(tuple(key), seq)
    got = {x["seq"]: x["leader"] for x in fuzzy_cluster(r, fuzzy_pairs(r)).collect()}
    leaders, expected = [], {}
    for seq, *key in rows:
        own = rep[tuple(key)]
        expected[seq] = next((a for a in leaders if a == own or (a, own) in pairs), seq)
        if expected[seq] == seq:
            leaders.append(seq)
    assert got == expected
