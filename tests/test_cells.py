"""Cells of wallets: pairs, sums, lists and components of dense tables against brute force, and that pairs are not shuffled."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import __spark_entry__ as entry
from test_pairs import SCHEMA, brute, trades
from tradelens.operators import cells, graph, pairs


def related(want):
    """(wallet, related, coordinated, addresses) of the pairs."""
    others, sums = defaultdict(list), Counter()
    for (a, b), n in want.items():
        for one, two in ((a, b), (b, a)):
            others[one].append(two)
            sums[one] += n
    return sorted((w, len(x), sums[w], ",".join(map(str, sorted(x)))) for w, x in others.items())


def components(want):
    at = {w: w for pair in want for w in pair}
    for _ in at:
        for a, b in want:
            at[a] = at[b] = min(at[a], at[b])
    size = Counter(at.values())
    return sorted((w, x, size[x], size[x] - 1) for w, x in at.items())


def table(copies):
    rows = [(w + 50 * k, t) for w, t in trades(3, 50, 900, 150, (20, 41), 2) for k in range(copies)]
    return rows + [(7, 1000)] * 3 + [(9, 1000)] * 5  # some trades of one second


def dense(monkeypatch, rows=300):
    monkeypatch.setattr(pairs, "DENSE", 0)
    monkeypatch.setattr(pairs, "DECIDE", 10**6, raising=False)
    monkeypatch.setattr(cells, "FEW_ROWS", rows)


@pytest.mark.parametrize("copies, least, rows", [(1, 1, 300), (1, 3, 300), (1, 5, 10**6), (3, 2, 900), (3, 3, 200)])
def test_cells_equal_brute_force(spark, monkeypatch, copies, least, rows):
    dense(monkeypatch, rows)
    x = table(copies)
    df, want = spark.createDataFrame([*x, (None, 5), (3, None)], SCHEMA), brute(x, 60, least)
    found = pairs.near_pairs(df, 60, least)
    assert "mapInArrow" in found._jdf.queryExecution().toString() or "MapInArrow" in found._jdf.queryExecution().toString()
    assert {(r.w1, r.w2): r.pairs for r in found.collect()} == want and found.count() == len(want)
    assert sorted(map(tuple, graph.correlations(df, 60, least).collect())) == related(want)
    sums = {w: (n, s) for w, n, s, _ in related(want)}
    got = graph.cluster_sums(df, 60, least).select("wallet", "cluster_id", "size", "related", "coordinated").collect()
    assert sorted(r[:4] for r in map(tuple, got)) == components(want) == sorted(map(tuple, graph.wallet_clusters(df, 60, least).collect()))
    assert {r.wallet: r.coordinated for r in got} == {w: s for w, (_, s) in sums.items()}


def test_pairs_of_a_dense_table_are_not_shuffled(spark):
    """Some hundred others around every trade: no exchange by pairs, nor of pairs, in any plan that makes them."""
    df = spark.createDataFrame(trades(5, 300, 9000, 100), SCHEMA)
    found = pairs.near_pairs(df, 60, 3)
    found.count()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"hashpartitioning\((w1|w2)#", plan) and len(re.findall(r"Exchange hashpartitioning|Exchange REPARTITION", plan)) <= 1
    assert {(r.w1, r.w2): r.pairs for r in found.collect()} == brute([tuple(r) for r in df.collect()], 60, 3)


@pytest.mark.parametrize("strip, waiting", [(50, 40), (4000, 10**6)])
@pytest.mark.parametrize("many", [1, 9])
def test_strips_and_lists_of_any_size(monkeypatch, strip, waiting, many):
    """Wallets whose meetings fill more than a strip, lists written in parts, and counts that are weighed."""
    monkeypatch.setattr(cells, "STRIP", strip)
    monkeypatch.setattr(cells, "WAITING", waiting)
    rows = list(dict.fromkeys(trades(1, 40, 600, 60))) + [(0, 30 * k) for k in range(60)]
    n = Counter(rows)
    w, t, k = (np.array(x, np.int64) for x in zip(*((w, t, k * many) for (w, t), k in n.items())))
    want = {p: x * many * many for p, x in brute(rows, 60, 1).items() if x * many * many >= 4}
    own = np.arange(40, dtype=np.int64)

    def side(keep, kept):
        row = lambda kind, *x: {"kind": kind, **{name: cells._bytes(v) for name, v in zip("abn", x)}}
        return cells._side([row(0, w[keep], t[keep], k[keep]), row(1, own[kept], own[kept], np.ones(kept.sum(), np.int64))])

    low, high = side(w < 15, own < 15), side(w >= 15, own >= 15)
    got, sums, lists = {}, defaultdict(lambda: [0, 0]), defaultdict(list)
    for one, two in ((low, None), (low, high), (high, None)):
        for b in cells._as_pairs(one, two, 60, 4):
            got.update(((r["w1"], r["w2"]), r["pairs"]) for r in b.to_pylist())
        for b in cells._as_links(one, two, 60, 4):
            for r in b.to_pylist():
                sums[r["class"]][0] += r["related"]
                sums[r["class"]][1] += r["coordinated"]
        for b in cells._as_lists(one, two, 60, 4):
            for r in b.to_pylist():
                assert r["related"] == len(r["others"])
                lists[r["class"]] += r["others"]
    assert got == want
    assert sorted((w, *sums[w], ",".join(map(str, sorted(lists[w])))) for w in sums) == related(want)


def test_whole_numbers_packed():
    for x in ([5], [-3, 2**40, 7], [-(2**63), 2**63 - 1, 0], [9, 9]):
        assert cells._values(cells._bytes(np.array(x, np.int64))).tolist() == x


def test_labels_of_a_long_path():
    label = cells.joined_labels(np.arange(1000), np.arange(0, 998), np.arange(1, 999))
    assert set(label[:999]) == {0} and label[999] == 999


def test_correlations_name_the_others(spark):
    """Each wallet's correlated addresses, in order, and not their number alone; a class of equal wallets names all its own but itself."""
    rows = [(w, t) for w in (2, 10, 9) for t in (0, 1000, 2000)] + [(4, 0), (4, 1000), (4, 2001)]
    got = {r.wallet: r.addresses for r in graph.correlations(spark.createDataFrame(rows, SCHEMA), 60, 3).collect()}
    assert got == {2: "4,9,10", 4: "2,9,10", 9: "2,4,10", 10: "2,4,9"}


@pytest.mark.parametrize("name", ["wallet_clusters", "score_cluster_detector", "coordinated_pairs", "sybil_sync", "wallet_correlations"])
def test_queries_of_dense_tables_use_cells(spark, monkeypatch, name):
    """No query adds up shuffled pairs where many trade around each trade."""

    def never(*_):
        raise AssertionError("pairs were shuffled")

    dense(monkeypatch, 100)
    monkeypatch.setattr(pairs, "_pairs", never)
    entry.queries()[name](spark, "/root/testdata/sf0.001").collect()


def test_cluster_scores_search_pairs_once(spark, monkeypatch):
    seen, plain = [], pairs._classes
    monkeypatch.setattr(pairs, "_classes", lambda x: seen.append(x) or plain(x))
    entry.queries()["score_cluster_detector"](spark, "/root/testdata/sf0.001").collect()
    assert len(seen) == 1
