"""The greedy choice of controls against a walk over the deals, and the nearest candidates against sorting."""

import math
import random

import pytest

from veilmark.operators import matching

KIND = "id {}, sector string, band int, size double"


def size(row):
    return math.log1p(max(0.0, row[3] or 0.0))


def tier(d, c):
    return 2 if d[1] != c[1] else 0 if d[2] == c[2] else 1


def walk(deals, pool):
    used, out = set(), {}
    for d in sorted(deals):
        c = min((c for c in pool if c[0] not in used), key=lambda c: (tier(d, c), round(abs(size(c) - size(d)), 9), c[0]))
        used.add(c[0])
        out[d[0]] = (c[0], tier(d, c))
    return out


def rows(r, n, name, sizes):
    return [(name(i), r.choice(["a", "a", "a", "b", None]), r.randrange(2), r.choice([None, 0.0, -3.0, *sizes, r.uniform(0, 1e3)])) for i in r.sample(range(1000), n)]


@pytest.mark.parametrize(("seed", "at_once", "spare"), [(1, 2, 0), (2, 3, 2)])
def test_rounds_give_the_walk(spark, monkeypatch, seed, at_once, spare):
    """Scarce candidates, many equal sizes, one hot sector, rivals in several tasks."""
    monkeypatch.setattr(matching, "WALK", 10)
    r = random.Random(seed)
    name = (lambda i: i) if seed == 1 else (lambda i: f"k{i:04d}")
    deals, pool = rows(r, 18, name, [5.0, 5.0]), rows(r, 18 + spare, name, [5.0, 6.0])
    kind = KIND.format("bigint" if seed == 1 else "string")
    got = matching.match_controls(spark.createDataFrame(deals, kind).repartition(3), spark.createDataFrame(pool, kind), at_once)
    assert {m.deal: (m.cand, m.tier) for m in got.collect()} == walk(deals, pool)


def test_candidates_among_equal_sizes_and_missing_sectors(spark):
    r = random.Random(5)
    deals, pool = rows(r, 12, int, [5.0]), rows(r, 70, int, [5.0, 5.0, 6.0])
    kind = KIND.format("bigint")
    got = {(c.deal, c.tier, c["rank"]): c.cand for c in matching.control_candidates(spark.createDataFrame(deals, kind), spark.createDataFrame(pool, kind), 2).collect()}
    want = {}
    for d in deals:
        for t in (0, 1, 2):
            near = sorted((c for c in pool if tier(d, c) == t), key=lambda c: (round(abs(size(c) - size(d)), 9), c[0]))
            want |= {(d[0], t, i + 1): c[0] for i, c in enumerate(near[:2])}
    assert got == want


def test_no_deals(spark):
    none = spark.createDataFrame([], KIND.format("bigint"))
    assert matching.match_controls(none, none).count() == 0 and matching.control_candidates(none, none).count() == 0
