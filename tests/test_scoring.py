"""Each ladder at every edge and beside it."""

import math

import pytest
from pyspark.sql import functions as F

from tradelens.functions import scalars
from tradelens.operators import scoring as s


def values(spark, rows, names, column):
    df = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(rows)], f"k int, {', '.join(f'{n} double' for n in names)}")
    return [r.x for r in df.select("k", column().alias("x")).orderBy("k").collect()]


c = F.col
CASES = [
    ("winrate", ["a", "b"], lambda: s.winrate_score(c("a"), c("b")),
     {(0.9, 4): 0, (0.49, 5): -2, (0.5, 5): 0, (0.549, 9): 0, (0.55, 9): 1, (0.65, 9): 2, (0.75, 9): 3, (0.849, 9): 3, (0.85, 9): 4}),
    ("pnl", ["a"], lambda: s.pnl_score(c("a")), {(0,): -1.5, (-5,): -1.5, (1e6,): 4, (5e6,): 4, (1000,): math.log1p(1000) / math.log1p(1e6) * 4}),
    ("timing", ["a", "b"], lambda: s.timing_score(c("a"), c("b")),
     {(0.5, 0.3): 2.5, (0.5, 0): 2, (0.499, 0): 1.5, (0.3, 0.15): 2, (0.15, 0): 1, (0.149, 0.149): 0, (0, 0.3): 1}),
    ("cross", ["a", "b"], lambda: s.cross_market_score(c("a"), c("b")),
     {(8, 0.3): 3, (8, 0): 2.5, (7, 0): 2, (6, 0): 2, (5, 0): 1.5, (4, 0): 1.5, (3, 0): 1, (2, 0.15): 1.5, (1, 0.149): 0}),
    ("camouflage", ["a", "b", "c"], lambda: s.camouflage_score(c("a"), c("b"), c("c")),
     {(50001, 0.549, 99): 2, (50000, 0.549, 99): 0, (25001, 0.499, 99): 1.5, (10001, 0.479, 99): 1, (10001, 0.48, 99): 0, (50001, 0.5, 49): 3, (10001, 0.9, 49): 1}),
    ("freshness", ["a", "b"], lambda: s.freshness_score(c("a"), c("b"), F.lit(200 * 86400)),
     {(0, 5): 0, (5, 0): 0, (170 * 86400 + 1, 1): 1.5, (170 * 86400, 1): 1, (110 * 86400, 1): 0.5, (110 * 86400 + 1, 1): 1, (20 * 86400 + 1, 1): 0.5, (20 * 86400, 1): 0}),
    ("activity", ["a"], lambda: s.activity_penalty(c("a")), {(1001,): -2, (1000,): -1.5, (501,): -1.5, (500,): -1, (201,): -1, (200,): 0}),
    ("fresh wallet", ["a", "b"], lambda: s.fresh_wallet_score(c("a"), c("b")),
     {(4, 1000): 2.5, (4, 999): 2, (5, 1000): 2, (9, 499): 1.5, (19, 250): 1.5, (20, 250): 1, (49, 100): 1, (50, 100): 0, (49, 99): 0}),
    ("sizing", ["a", "b"], lambda: s.position_sizing_score(c("a"), c("b")), {(60, 100): 2, (59, 100): 1.5, (40, 100): 1.5, (25, 100): 1, (15, 100): 0.5, (14, 100): 0, (5, 0): 0}),
    ("early", ["a", "b"], lambda: s.early_entry_score(c("a"), c("b")),
     {(3601, 1): 2, (3602, 1): 1.5, (6 * 3600 + 1, 1): 1.5, (12 * 3600 + 1, 1): 1, (24 * 3600 + 1, 1): 0.5, (24 * 3600 + 2, 1): 0, (0, 1): 0, (1, 0): 0}),
    ("off hours", ["a"], lambda: s.off_hours_score(c("a")), {(0.5,): 1.5, (0.49,): 1, (0.3,): 1, (0.15,): 0.5, (0.14,): 0}),
    ("impact", ["a", "b"], lambda: s.volume_impact_score(c("a"), c("b")), {(5, 100): 2, (4.9, 100): 1.5, (2, 100): 1.5, (1, 100): 1, (0.9, 100): 0, (0, 100): 0, (5, 0): 0}),
    ("cluster", ["a", "b"], lambda: s.cluster_score(c("a"), c("b")), {(5, 1): 2.5, (5, 0): 2, (3, 9): 2, (2, 9): 1.5, (1, 9): 1, (0, 9): 0}),
    ("detector", ["a", "b", "c"], lambda: s.cluster_detector_score(c("a"), c("b"), c("c")),
     {(0, 99, 9): 0, (4, 10, 5): 2.5, (4, 9, 5): 2, (2, 5, 3): 1.5, (1, 4, 2): 0.5}),
    ("fast position", ["a", "b", "c"], lambda: s.fast_position_score(c("a"), c("b"), c("c")), {(0, 0, 0): 2, (4, 1, 3): 2, (100, 9, 3): 2.2}),
    ("fast activity", ["a", "b"], lambda: s.fast_activity_score(c("a"), c("b")), {(20, 10): 3, (10, 0): 1.5, (5, 1001): 1, (2, 1000): 1, (1, 50): 1.5, (0, 200): 1}),
    ("level", ["a"], lambda: scalars.risk_level(c("a")), {(8,): "CRITICAL", (7.99,): "HIGH", (5,): "HIGH", (4.99,): "MEDIUM", (2,): "MEDIUM", (1.99,): "LOW"}),
]


@pytest.mark.parametrize(("name", "names", "column", "cases"), CASES, ids=[x[0] for x in CASES])
def test_ladder(spark, name, names, column, cases):
    got = values(spark, list(cases), names, column)
    for g, want in zip(got, cases.values(), strict=True):
        assert g == want if isinstance(want, str) else abs(g - want) < 1e-12


def test_profile_types(spark):
    rows = [(0.49, 0, 0, 0, 0), (0.5, 2, 0, 0, 0), (0.5, 0, 2, 1.5, 0), (0.55, 0, 0, 0, 200), (0.54, 0, 0, 0, 200)]
    got = values(spark, rows, list("abcde"), lambda: scalars.profile_type(*map(c, "abcde")))
    assert got == ["LOSER", "CAMOUFLAGED_INSIDER", "INSIDER", "PRO", "CASUAL"]


def test_first_match_follows_the_table(spark):
    df = spark.createDataFrame([("Fed Technology",), ("the federal election",), ("bitcoin sports",), ("x",)], "q string")
    got = [r.x for r in df.select(scalars.risk_category(c("q"), F.lit(""), F.lit("")).alias("x")).collect()]
    assert got == [5.0, 4.0, 1.5, 1.0]


def test_epochs_and_addresses(spark):
    df = spark.createDataFrame([(1_700_000_000_000, "0xABCDEF0123456789"), (1_700_000_000, "0xabc")], "t long, a string")
    got = df.select(scalars.epoch_seconds(c("t")).alias("t"), scalars.short_address(c("a")).alias("a")).collect()
    assert got[0].t == got[1].t == 1_700_000_000 and got[0].a == "0xABCD...6789"
