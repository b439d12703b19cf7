"""Coordinated pairs: the threshold join against the direct one, and the rows it joins where one minute is busy."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tradelens.operators import graph, pairs

SCHEMA = "wallet long, t long"


def brute(rows, window, least):
    x = sorted(rows, key=lambda r: r[1])
    out, start = Counter(), 0
    for k, (w, t) in enumerate(x):
        while x[start][1] < t - window:
            start += 1
        for other, _ in x[start:k]:
            if other != w:
                out[min(w, other), max(w, other)] += 1
    return {k: n for k, n in out.items() if n >= least}


def trades(seed, wallets, n, minutes, hot=(), most=1):
    r = random.Random(seed)
    rows = [(r.randrange(wallets), r.randrange(minutes * 60)) for _ in range(n)]
    for minute in hot:
        rows += [(w, minute * 60 + r.randrange(60)) for w in range(wallets) for _ in range(r.randint(1, most))]
    return rows


@pytest.mark.parametrize("least", [1, 2, 3, 5])
@pytest.mark.parametrize("hot, most", [((), 1), ((20, 41, 42), 1), ((20, 21), 3)])
def test_pairs_equal_brute_force(spark, least, hot, most):
    rows = trades(least, 40, 300, 200, hot, most)
    df = spark.createDataFrame(rows, SCHEMA)
    for busy in (0, 200, pairs.BUSY_PAIRS):
        got = {(r.w1, r.w2): r.pairs for r in pairs.near_pairs(df, 60, least, busy).collect()}
        assert got == brute(rows, 60, least)


def test_busy_minute_is_not_joined_outright(spark):
    """2,000 wallets trade once in one minute and a few times elsewhere: under a tenth of the direct join's rows."""
    rows = trades(7, 2000, 6000, 40_000, (500,))
    df = spark.createDataFrame(rows, SCHEMA).cache()
    direct = pairs._met(*pairs._sides(df, 60), 60, ["b"]).count()
    parts = pairs.joined_rows(df, 60, 3, 50_000)
    assert direct > 1_900_000 and 10 * sum(x.count() for x in parts) < direct
    got = {(r.w1, r.w2): r.pairs for r in pairs.near_pairs(df, 60, 3, 50_000).collect()}
    assert got == brute(rows, 60, 3)


def test_one_very_active_wallet_in_a_busy_minute(spark):
    """Its count does not make all other pairs of that minute candidates."""
    rows = trades(9, 600, 500, 40_000, (500,)) + [(0, 500 * 60 + k % 60) for k in range(50)]
    df = spark.createDataFrame(rows, SCHEMA)
    quiet, found, near = pairs.joined_rows(df, 60, 3, 10_000)
    assert found.count() < 5_000
    got = {(r.w1, r.w2): r.pairs for r in pairs.near_pairs(df, 60, 3, 10_000).collect()}
    assert got == brute(rows, 60, 3) and len(got) > 500


def test_correlations_of_nothing(spark):
    none = graph.coordinated_pairs(spark.createDataFrame([], SCHEMA), 60, 3)
    assert none.count() == 0 and graph.wallet_correlations(none).count() == 0
    alone = spark.createDataFrame([(1, 5), (1, 6), (1, 7)], SCHEMA)
    assert graph.coordinated_pairs(alone, 60, 2).where(F.col("pairs") > 0).count() == 0


def test_wallets_of_the_same_seconds_are_joined_once(spark):
    """Thirty copies of forty wallets: all pairs, sums and components, from the joins of forty."""
    base = trades(11, 40, 500, 300, (20, 41), 3)
    rows = [(w + 40 * k, t) for w, t in base for k in range(30)]
    df = spark.createDataFrame(rows, SCHEMA).cache()
    want = brute(rows, 60, 3)
    found, who = pairs.class_pairs(df, 60, 3)
    assert who.count() == 1200 and who.where("size = 30").count() == 1200 and found.count() <= 40 * 41 // 2
    assert {(r.w1, r.w2): r.pairs for r in pairs.near_pairs(df, 60, 3).collect()} == want
    plain = sorted(map(tuple, graph.wallet_correlations(spark.createDataFrame([(*k, n) for k, n in want.items()], "w1 long, w2 long, pairs long")).collect()))
    assert sorted(map(tuple, graph.correlations(df, 60, 3).collect())) == plain
    edges = spark.createDataFrame(list(want), "w1 long, w2 long")
    assert sorted(map(tuple, graph.wallet_clusters(df, 60, 3).collect())) == sorted(map(tuple, graph.clusters(edges).collect()))


def test_same_seconds_but_other_counts(spark):
    """A wallet with one more trade in a second is a class of its own; a lone pair of copies is a cluster."""
    rows = [(w, t) for w in (1, 2, 3) for t in (0, 1000, 2000)] + [(3, 2000), (8, 50_000), (8, 90_000), (9, 50_000), (9, 90_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {tuple(r) for r in pairs.near_pairs(df, 60, 2).collect()} == {(1, 2, 3), (1, 3, 4), (2, 3, 4), (8, 9, 2)}
    assert {r.wallet: (r.cluster_id, r["size"]) for r in graph.wallet_clusters(df, 60, 2).collect()} == {1: (1, 3), 2: (1, 3), 3: (1, 3), 8: (8, 2), 9: (8, 2)}
