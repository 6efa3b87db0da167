"""Components of links against union-find, on long chains and on the whole table part."""

import random

from gridloom.operators import fields
from gridloom.plans import catalog

D = "/root/testdata/sf0.001"


def roots(links):
    up = {}

    def find(k):
        while up.setdefault(k, k) != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    for a, b in links:
        p, q = sorted((find(a), find(b)))
        up[q] = p
    return {k: find(k) for k in list(up)}


def test_long_chain(spark):
    names = list(range(600))
    random.Random(6).shuffle(names)
    links = list(zip(names, names[1:])) + [(1000 + i, 1001 + i) for i in range(300)] + [(2000, 2000), (2002, 2001)]
    got = {r.node: r.root for r in fields.components_of(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == roots(links) and len(set(got.values())) == 4


def test_query_takes_every_row(spark):
    links = [(r.p_partkey, r.p_partkey + 1 + r.p_size % 3) for r in spark.read.parquet(f"{D}/part.parquet").collect()]
    got = {r.node: r.root for r in catalog.QUERIES["connected_components"](spark, D).collect()}
    assert got == roots(links) and {a for a, _ in links} <= set(got)
