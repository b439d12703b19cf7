"""Related wallets up to a number: the rounds against brute force, and how the joined rows grow."""

import random
import re
from collections import Counter

import pytest

import __spark_entry__ as entry
from test_pairs import SCHEMA, brute, trades
from tradelens.operators import graph, pairs

DATA = "/root/testdata/sf0.001"
SCORED = ["risk_score", "risk_score_full", "risk_level", "wallet_risk", "summary_table", "filter_high_risk", "profile_summary", "critical_wallet_semi", "v1_alert_level",
          "critical_trader_alerts", "score_cluster"]


def related(rows, window, least, most):
    n = Counter(w for pair in brute(rows, window, least) for w in pair)
    return {w: min(k, most) for w, k in n.items()}


@pytest.mark.parametrize("copies, hot, most", [(1, (20, 41, 42), 3), (3, (20, 21), 1)])
@pytest.mark.parametrize("least, upto, busy, first, dense", [(3, 5, pairs.BUSY_PAIRS, 4, 0), (2, 10**6, 200, 8, 0), (3, 5, 200, 16, 10**6)])
def test_rounds_equal_brute_force(spark, copies, hot, most, least, upto, busy, first, dense):
    rows = [(w + 60 * k, t) for w, t in trades(copies, 60, 500, 200, hot, most) for k in range(copies)]
    found = pairs.related_up_to(spark.createDataFrame(rows, SCHEMA), 60, least, upto, busy, first, dense)
    assert {r.wallet: r.related for r in found.collect()} == related(rows, 60, least, upto)


def test_few_related_wallets_in_a_dense_table(spark):
    """Wallets of one trade fill all minutes; the exact number is found for those that have fewer than five others."""
    r = random.Random(5)
    rows = [(1000 + k, r.randrange(6000)) for k in range(3000)] + [(w, w // 3 * 1000 + k) for w in range(9) for k in range(2)]
    got = {x.wallet: x.related for x in pairs.related_up_to(spark.createDataFrame(rows, SCHEMA), 60, 4, 5, first=4, dense=8).collect()}
    assert got == related(rows, 60, 4, 5) == {w: 2 for w in range(9)}


def test_joined_rows_grow_with_the_wallets(spark, monkeypatch):
    """Four times the wallets in the same month: four times the joined rows and not sixteen times."""
    made, plain = [], pairs._rows_of_sides

    def counted(*args):
        out = plain(*args)
        made.append(sum(x.count() for x in out))
        return out

    monkeypatch.setattr(pairs, "_rows_of_sides", counted)
    rows = {n: [(k % n, random.Random(k).randrange(200_000)) for k in range(60 * n)] for n in (300, 1200)}
    work = {}
    for n, x in rows.items():
        got = {r.wallet: r.related for r in pairs.related_up_to(spark.createDataFrame(x, SCHEMA), 60, 3, 5, first=4, dense=8).collect()}
        work[n] = sum(made)
        made.clear()
        assert got == related(x, 60, 3, 5)
    assert 0 < work[1200] < 6 * work[300]


@pytest.mark.parametrize("sent, first, busy", [(10**6, 4, pairs.BUSY_PAIRS), (10**6, 16, 200), (0, 4, pairs.BUSY_PAIRS), (200, 4, pairs.BUSY_PAIRS), (200, 8, 200)])
def test_pairs_of_a_round_are_not_shuffled(spark, monkeypatch, sent, first, busy):
    """Others of up to ``SENT_ROWS`` rows go to all tasks, where a wallet's pairs are added up; the numbers are those of brute force however few go."""
    plans, plain = [], pairs._added

    def seen(state, new):
        plans.append(new._jdf.queryExecution().executedPlan().toString())
        return plain(state, new)

    monkeypatch.setattr(pairs, "_added", seen)
    monkeypatch.setattr(pairs, "SENT_ROWS", sent, raising=False)
    monkeypatch.setattr(pairs, "TASK_ROWS", 500, raising=False)
    rows = trades(5, 60, 700, 200, (20, 41) if busy == 200 else ())
    got = {r.wallet: r.related for r in pairs.related_up_to(spark.createDataFrame(rows, SCHEMA), 60, 3, 10**6, busy, first, 0).collect()}
    assert got == related(rows, 60, 3, 10**6) and len(plans) > 1
    if busy == pairs.BUSY_PAIRS and sent != 200:
        assert all(bool(re.search(r"hashpartitioning\(w1#\d+L?, w2#", p)) == (sent == 0) for p in plans)


@pytest.mark.parametrize("name", SCORED)
def test_scores_do_not_sum_all_pairs(spark, monkeypatch, name):
    def never(*_):
        raise AssertionError("all pairs were summed")

    monkeypatch.setattr(graph, "correlations", never)
    entry.queries()[name](spark, DATA)


@pytest.mark.parametrize("name", ["profile_type", "score_pnl", "score_off_hours"])
def test_parts_that_need_no_pairs(spark, monkeypatch, name):
    def never(*_):
        raise AssertionError("pairs were searched")

    monkeypatch.setattr(graph, "correlations", never)
    monkeypatch.setattr(graph, "related_wallets", never)
    entry.queries()[name](spark, DATA)
