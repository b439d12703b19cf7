"""Filter audit and importance resampling against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tradelens.llm import filter_audit, resampling

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LABELS = "doc_id long, quality int, toxic int"


def texts():
    long = " ".join(f"w{k % 97}x{k % 89}" for k in range(9000))
    return [
        "word " * 150, "word " * 150, " ".join(f"a{k}" for k in range(120)), " ".join(f"A{k}B" for k in range(120)), None, "", None,
        " ".join(f"b{k}" for k in range(110)) + " #tag", "SHOUT " * 120, long, long, "é ß ü " * 60, "mit|pipe & more\n" * 40, " \t\n", "😀 " * 130,
        "The Cat, the-cat THE cat's 42 Äpfel äpfel x" * 3, " ".join(f"c{k}" for k in range(100)), " ".join(f"c{k}" for k in range(100)),
    ]


def corpus():
    rows = [(k, t, ["en", "de", None, ""][k % 4], "s", 0) for k, t in enumerate(texts())]
    return [*rows, rows[9], rows[9], (None, texts()[0], "en", None, None), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


MARKS = [(0, 1, 0), (1, 1, 1), (2, 0, 1), (3, None, 1), (9, 0, 0), (9, 1, 0), (10, 1, None), (None, 1, 1), (77, 1, 1), (16, 1, 1), (17, 1, 1)]


def audited(rows, marks):
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    out = Counter()
    parts = {r[2] or "" for r in rows}
    good, toxic = {m[0] for m in marks if m[1] == 1} - {None}, {m[0] for m in marks if m[2] == 1} - {None}
    shapley = Counter()
    for order in map("".join, permutations("ABCDE")):
        for part in parts:
            for step in range(1, 6):
                for k in filter_audit.MEASURES:
                    out[part, order, step, k] += 0
        for i, t, part, *_ in rows:
            t, part = t or "", part or ""
            w = re.findall(r"[^\x20\x09-\x0D]+", t)
            fails = {
                "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
                "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and least[t] < i,
            }
            gone = False
            for step, f in enumerate(order, 1):
                own, at = fails[f], (part, order, step)
                out[*at, "kept"] += not gone and not own
                out[*at, "removed"] += not gone and own
                out[*at, "redundant"] += gone and own
                out[*at, "unique_fails"] += own and sum(fails.values()) == 1
                out[*at, "good_lost"] += not gone and own and i in good
                out[*at, "toxic_lost"] += not gone and own and i in toxic
                shapley[part, f] += not gone and own
                gone |= own
    return out, shapley


def check_audit(df, rows, marks):
    want, shapley = audited(rows, marks)
    got = df.collect()
    assert len(got) == len(want) / len(filter_audit.MEASURES)
    for r in got:
        assert r.shapley == shapley[r.part, r.filter] and r.filter == r.filter_order[r.step - 1]
        for m in filter_audit.MEASURES:
            assert r[m] == want[r.part, r.filter_order, r.step, m], (r, m)


def test_filter_audit(spark, docs):
    marks = spark.createDataFrame(MARKS, LABELS)
    check_audit(filter_audit.filter_audit(docs, marks), corpus(), MARKS)
    clash = docs.withColumns({c: F.lit("clash") for c in ("mask", "part", "digest", "n", "quality", "toxic", "x", "at", "first")})
    check_audit(filter_audit.filter_audit(clash, marks.withColumn("text", F.lit("x")).withColumn("lang", F.lit("y"))), corpus(), MARKS)
    check_audit(filter_audit.filter_audit(docs, marks.limit(0)), corpus(), [])
    assert filter_audit.filter_audit(docs.limit(0), marks).count() == 0


def runs(text, longest):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(w), [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]


def resampled(rows, target, longest, buckets, percent, least):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for r in rows for f in runs(r[1], longest)[1])
    t = Counter(bucket(f) for x in target for f in runs(x, longest)[1])
    every_s, every_t = sum(s.values()), sum(t.values())
    out = []
    for i, text, *_ in rows:
        n, found = runs(text, longest)
        b = [bucket(f) for f in found]
        weight = sum(math.floor(1000 * math.log((t[x] + 1) * (every_s + buckets) / ((s[x] + 1) * (every_t + buckets)))) for x in b)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    ranked = [(*r, k + 1 if k < len(fit) * percent // 100 else None) for k, r in enumerate(fit)]
    return Counter([*ranked, *[(*r, None) for r in out if r[1] < least]])


TARGET = ["The cat c1 c2 c3 and b7 b8", None, "", "äpfel ÄPFEL w1x1 w2x2"]


@pytest.mark.parametrize("longest, percent", [(1, 10), (1, 60), (3, 50), (1, 100)])
def test_resampling(spark, docs, longest, percent):
    target = spark.createDataFrame([(x,) for x in TARGET], "text string")
    scored = resampling.importance_scores(docs, target, longest, 997)
    got = Counter(map(tuple, resampling.draw(scored, percent).collect()))
    assert got == resampled(corpus(), TARGET, longest, 997, percent, 20)


def test_resampling_cases(spark, docs):
    target = spark.createDataFrame([(x,) for x in TARGET], "text string")
    clash = docs.withColumns({c: F.lit("clash") for c in ("weight", "score", "rank", "n_words", "_t", "_n", "bucket", "_drawn_")})
    got = Counter(map(tuple, resampling.draw(resampling.importance_scores(clash, target), 40).collect()))
    assert got == resampled(corpus(), TARGET, 1, 10_000, 40, 20)
    assert resampling.draw(resampling.importance_scores(docs.limit(0), target)).count() == 0
    none = resampling.draw(resampling.importance_scores(docs, target.limit(0)), 40)
    assert Counter(map(tuple, none.collect())) == resampled(corpus(), [], 1, 10_000, 40, 20)
    kept = resampling.resampled(clash, target, 40)
    assert kept.columns == clash.columns
    drawn = {r[0] for r in got if r[5] is not None}
    assert Counter(r.doc_id for r in kept.collect()) == Counter(r[0] for r in corpus() if r[0] in drawn)
