"""The registered filter keeps every wallet from the level MEDIUM on."""

import os

import pytest

import __spark_entry__ as entry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_filter_high_risk_from_two_on(spark):
    got = {tuple(r) for r in entry.queries()["filter_high_risk"](spark, DATA).collect()}
    scores = {(r.wallet, r.risk_score) for r in entry.queries()["risk_score"](spark, DATA).collect()}
    assert got == {r for r in scores if r[1] >= 2} and any(r[1] < 5 for r in got)
