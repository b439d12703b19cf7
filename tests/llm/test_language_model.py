"""The recurrent language model: base scores by brute force, the model word by word, and held-out documents."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tradelens.llm import gru, language_model
from tradelens.llm.language_model import Settings

SCHEMA = "doc_id long, text string, lang string"
SMALL = Settings(vocabulary=12, dictionary=20, hidden=4, classes=4, rare_inputs=5, lanes=3, steps=5, rounds=2)


def corpus():
    r = random.Random(3)
    words = [f"w{k}" for k in range(60)]
    texts = [" ".join(r.choices(words, [1 / (k + 1) for k in range(60)], k=r.randint(1, 60))) for _ in range(60)]
    texts += [None, "", " \n\t", "ÄB Ab ab c", texts[0], texts[0], "once " * 700, "Unseen1 unseen2 UNSEEN1"]
    rows = [(k, t, "en") for k, t in enumerate(texts)]
    return [*rows, rows[4], rows[4], (None, texts[1], None), (None, None, None)]


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["\n"]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


def base_scores(rows):
    count = Counter(w for r in rows if not held(r[0]) for w in tokens(r[1]))
    n, v = sum(count.values()), len(count)
    return n, [
        (r[0], held(r[0]), len(tokens(r[1])), sum(count[w] > 0 for w in tokens(r[1])), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens(r[1])))
        for r in rows
    ], count


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


def slow_score(text, words, net, count):
    """log10 probability of a text, one word after another in double precision."""
    p = {k: v.astype(float) for k, v in net.p.items()}
    place = {w: k for k, w in enumerate(words.names[: words.known])}
    k, h, out, before = net.hidden, np.zeros(net.hidden), 0.0, None
    for w in tokens(text):
        key = w.encode()
        row = words.known + SMALL.rare_inputs if before is None else place.get(before, words.known + zlib.crc32(before[-2:]) % SMALL.rare_inputs)
        x, a = p["inputs"][row], h @ p["gates"]
        z, r = sigmoid(x[:k] + a[:k]), sigmoid(x[k : 2 * k] + a[k : 2 * k])
        h = (1 - z) * np.tanh(x[2 * k :] + r * a[2 * k :]) + z * h
        logits = h @ p["classes"] + p["class_bias"]
        kind = net.class_of[place.get(key, -1)]
        out += logits[kind] - np.log(np.exp(logits).sum())
        if key in place:
            low, high = net.first[kind], net.first[kind + 1]
            inner = p["words"][low:high] @ h + p["word_bias"][low:high]
            out += inner[place[key] - low] - np.log(np.exp(inner).sum())
        else:
            out += math.log((count[w] + 1) / (words.rare_tokens + words.rare_distinct + 1))
        before = key
    return out / math.log(10)


def check(got, rows, net=None, words=None):
    _, want, count = base_scores(rows)
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[3], r[5])
    assert len(got) == len(want)
    text_of = {(r[0], len(tokens(r[1]))): r[1] for r in rows}
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(want, key=key)):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-12)
        if net is not None:
            assert a[6] == pytest.approx(slow_score(text_of[a[0], a[2]], words, net, count), rel=1e-4)


def test_scores_equal_brute_force(docs):
    learnt = language_model.learn_model(docs, SMALL)
    net = language_model._model(learnt.words, SMALL)
    untrained = net.packed().copy()
    net.unpack(learnt.model)
    assert not np.allclose(untrained, learnt.model)
    check(language_model.score_with(learnt, docs, SMALL).collect(), corpus(), net, learnt.words)


def test_cases(spark, docs):
    clash = docs.withColumns({c: F.lit("clash") for c in ("_t", "held_out", "tokens", "times", "base", "score", "n", "token", "_row")})
    check(language_model.score_documents(clash, SMALL).collect(), corpus())
    check(language_model.score_documents(docs).collect(), corpus())
    assert language_model.score_documents(docs.limit(0), SMALL).count() == 0
    only = [r for r in corpus() if held(r[0])]
    check(language_model.score_documents(spark.createDataFrame(only, SCHEMA), SMALL).collect(), only)


def test_probabilities_sum_to_one():
    net = gru.Model(np.array([9, 7, 5, 3, 2, 2, 1, 1, 1]), 4, 3, 3, 2, 1)
    r = np.random.default_rng(1)
    for k in ("classes", "words"):
        net.p[k] += r.standard_normal(net.p[k].shape).astype(np.float32)
    h = r.standard_normal((3, 1)).astype(np.float32)
    logs = [net._foretell(h, np.array([w]))[0][0] for w in range(-1, 9)]
    assert sum(map(math.exp, logs)) == pytest.approx(1, rel=1e-5)


def test_windows_carry_whole_documents():
    r = random.Random(1)
    docs = [(k, np.arange(n, dtype=np.int32), np.arange(n, dtype=np.int32)) for k, n in enumerate(r.choices([1, 2, 7, 50], k=40))]
    got, began, ended = {k: [] for k, _, _ in docs}, 0, []
    for w in gru.windows(iter(docs), 4, 5):
        flat = w.targets.ravel()
        for a, b, k in zip(w.at, [*w.at[1:], len(flat)], w.of):
            piece = flat[a:b]
            got[k] += piece[piece >= 0].tolist()
        began += int(w.starts.sum())
        ended += w.ended
    assert all(got[k] == n.tolist() for k, n, _ in docs) and began == len(docs) and sorted(ended) == list(range(40))


def test_gradient():
    """A small step lowers the loss by the rate times the squared gradient, as plain descent should."""
    r = np.random.default_rng(0)
    net = gru.Model(np.array([9, 7, 5, 3, 2, 2, 1, 1, 1]), 4, 6, 3, 2, 1)
    for k, v in net.p.items():
        net.p[k] = (v + 0.3 * r.standard_normal(v.shape)).astype(np.float32)
    docs = [(k, r.integers(0, 11, 12).astype(np.int32), r.integers(-1, 9, 12).astype(np.int32)) for k in range(4)]
    w = next(gru.windows(iter(docs), 4, 12))
    zero, before = np.zeros((6, 4), np.float32), {k: v.copy() for k, v in net.p.items()}
    loss = lambda: -net.score(w, zero)[0].mean()
    first, squares, eps = loss(), 0.0, 1e-3
    net._move = lambda name, rows, grad, rate: squared.append((name, rows, grad))
    squared = []
    net.learn(w, zero, 0)
    for name, rows, grad in squared:
        squares += float((grad.astype(float) ** 2).sum())
        net.p[name][rows] -= eps * grad
    assert first - loss() == pytest.approx(eps * squares, rel=0.05)
    assert any((before[k] != net.p[k]).any() for k in before)


def test_held_out_documents_are_foretold_better_than_by_counts(spark):
    r = random.Random(5)
    nouns, verbs = [f"n{k}" for k in range(30)], [f"v{k}" for k in range(30)]
    rows = [(k, " ".join(x for _ in range(40) for x in ("the", r.choice(nouns), "did", r.choice(verbs))), "en") for k in range(400)]
    got = language_model.score_documents(spark.createDataFrame(rows, SCHEMA).repartition(2), Settings(lanes=32)).where("held_out").collect()
    assert len(got) > 30 and sum(x.score for x in got) > 0.75 * sum(x.base_score for x in got)
