"""Near copies against brute-force Jaccard similarity of five-word shingles, by kind of edit."""

import random

import pytest

from tradelens.llm import simhash


def shingles(text):
    w = text.split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


def word(r):
    return "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8)))


def edited(r, base, kind):
    if kind == "appended":
        return base + [word(r) for _ in range(60)]
    if kind == "truncated":
        return base[:250]
    if kind == "cut in the middle":
        return base[:120] + base[170:]
    copy = list(base)
    for at in r.sample(range(5, 295), 6):
        copy[at] = word(r)
    return copy


@pytest.mark.parametrize("kind", ["appended", "truncated", "cut in the middle", "word edits"])
def test_copies_at_the_threshold_are_found(spark, kind):
    r = random.Random(kind)
    rows, pairs = [], []
    for g in range(60):
        base = [word(r) for _ in range(300)]
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(edited(r, base, kind)))]
        pairs.append(jaccard(rows[-2][1], rows[-1][1]) >= 0.8)
    kept = {x.doc_id for x in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(pairs) >= 40
    assert {g for g in range(60) if 2 * g + 1 not in kept} == {g for g in range(60) if pairs[g]}
    assert {2 * g for g in range(60)} <= kept


def test_family_around_the_threshold(spark, monkeypatch):
    """Edited copies of one text, most pairs of which are near the threshold: the groups are those of brute force."""
    from test_operators import slow_keep

    r = random.Random(8)
    base = [word(r) for _ in range(150)]
    rows = []
    for k in range(250):
        copy = list(base)
        for at in r.sample(range(150), r.randint(1, 5)):
            copy[at] = word(r)
        rows.append((k, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = slow_keep(rows)
    assert 5 < len(want) < 200
    assert {x.doc_id for x in simhash.keep_one(df).collect()} == want
    monkeypatch.setattr(simhash, "PART_HASHES", 5_000)  # buckets in parts
    monkeypatch.setattr(simhash, "BROADCAST_IDS", 0)
    assert {x.doc_id for x in simhash.keep_one(df).collect()} == want
