"""Words of many texts at once: equal to those of each text alone, and read without a Python object for each."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from tradelens.llm import language_model
from tradelens.llm.language_model import END, Settings, Words, _Reader, pieces, words_of

TEXTS = [None, "", " \n\t", "A", "  Ab\tc\x0bd\x85e \xa0É x ", "a\x1cb\x00c  a", "\n\nÄÖ zwei\r\nzwei\x0c", "One two ONE", *(" ".join(random.Random(k).choices("abcDEfg", k=k)) for k in range(9))]


def plain(text):
    return [bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())]


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_words_and_rows_of_texts(kind):
    texts = pa.array(TEXTS, kind)
    for part in (texts, texts.slice(3, 4), texts.slice(0, 0)):
        words, at = words_of(part)
        assert [words.to_pylist()[a:b] for a, b in zip(at, at[1:])] == [plain(t) for t in part.to_pylist()]
    names = [END, b"a", b"one", b"zwei", b"x"]
    reader = _Reader(Words(names, [9, 4, 3, 2, 1], 40, 9, 20, 6, 3, 0), Settings(rare_inputs=8))
    for text, (places, inputs, targets, absent) in zip(TEXTS, reader.read(texts), strict=True):
        own = plain(text)
        assert places.tolist() == [names.index(w) if w in names else -1 for w in own] + [0]
        assert targets.tolist() == [k if k < 3 else -1 for k in places] and absent == [w for w in own if w not in names]
        rows = [k if 0 <= k < 3 else 3 + language_model.zlib.crc32(w[-2:]) % 8 for k, w in zip(places, own)]
        assert inputs.tolist() == [3 + 8, *rows]


def test_pieces_hold_each_text_once_longest_first(monkeypatch):
    texts = pa.array(TEXTS)
    whole = [k for x in pieces(texts) for k in x.tolist()]
    assert whole == sorted(range(len(TEXTS)), key=lambda k: -len((TEXTS[k] or "").encode()))
    monkeypatch.setattr(language_model, "PIECE", 16)
    cut = [x.tolist() for x in pieces(texts)]
    assert len(cut) > 3 and sum(cut, []) == whole
    assert not list(pieces(texts.slice(0, 0)))


def test_counts_of_texts(spark):
    got = {bytes(r.token): r.n for r in language_model.word_counts(spark.createDataFrame([(t,) for t in TEXTS], "_t string").repartition(3)).collect()}
    assert got == Counter([w for t in TEXTS for w in plain(t)] + [END] * len(TEXTS))
