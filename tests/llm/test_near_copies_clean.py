"""Documents that share their words but not four fifths of their five-word shingles stay."""

import random

from test_near_copies import jaccard, word

from tradelens.llm import simhash


def test_reordered_documents_stay(spark):
    r = random.Random(3)
    rows = []
    for g in range(30):
        base = [word(r) for _ in range(300)]
        parts = [base[k : k + 20] for k in range(0, 300, 20)]
        r.shuffle(parts)  # the same words, a similarity of about 0.7
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(w for p in parts for w in p))]
        assert 0.5 < jaccard(rows[-2][1], rows[-1][1]) < 0.8
    kept = {x.doc_id for x in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {k for k, _ in rows}


def test_bridges_join_and_pairs_below_do_not(spark):
    r = random.Random(4)
    a = [word(r) for _ in range(300)]
    b = a[:270] + [word(r) for _ in range(28)]
    c = b[30:] + [word(r) for _ in range(28)]
    a, b, c = (" ".join(x) for x in (a, b, c))
    assert jaccard(a, b) >= 0.8 <= jaccard(b, c) and jaccard(a, c) < 0.8
    ids = lambda *rows: sorted(x.doc_id for x in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert ids((1, a), (2, b), (3, c)) == [1] and ids((1, a), (3, c)) == [1, 3]
