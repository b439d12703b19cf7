"""Scores documents by a gated recurrent language model that is trained here, beside a base score by word counts.

Counts of all words of all training documents come first (a shuffle). The most frequent words, a bounded number, go to the
tasks with their counts; the other words of a document are looked up by a join, so no vocabulary is too large. The
model learns in rounds: every training document is used in one of them, every task trains a copy on its own
documents, and the copies are averaged by Spark, weighted by their tokens. Scoring reads every document once more.

``gru`` has the model itself. It foretells the class of the next word and the word in its class; a word beyond the
model's vocabulary has the probability of the class of such words times its share of their counts, of which unseen
words have one.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradelens.llm.common import cut
from tradelens.llm.gru import Model, Sequence, windows

#: The end of a text; no word holds a line end.
END = b"\n"
#: Bytes of texts that a task splits into words together; a longer text is a piece of its own.
PIECE = 1 << 24
#: Parameters that travel as one row between copies, and copies that are averaged together.
BLOCK, TOGETHER = 4096, 64


class Settings(NamedTuple):
    """Sizes of the model and of what is sent to tasks; none of them depends on the input."""

    vocabulary: int = 2048  # words that the model knows
    dictionary: int = 100_000  # words whose counts every task gets
    hidden: int = 16
    classes: int = 32
    rare_inputs: int = 64  # input rows that all other words share, by their last two bytes
    lanes: int = 384
    steps: int = 32  # twice as many in scoring
    updates: int = 100  # a copy that would learn in fewer windows takes fewer lanes, down to 64
    rounds: int = 2
    rate: float = 0.1
    seed: int = 13


class Words(NamedTuple):
    """What is known of words after counting."""

    names: list[bytes]  # the dictionary, the end first and then by falling count
    counts: list[int]
    tokens: int  # all of the training documents
    distinct: int
    rare_tokens: int  # those beyond the model's vocabulary
    rare_distinct: int
    known: int  # words of the model's vocabulary
    least: int  # the least block of counts in the dictionary


def held_out(doc_id: Column) -> Column:
    """Documents that are not learnt from; one without id is learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def pieces(texts: pa.Array) -> Iterator[np.ndarray]:
    """Places of the texts of a batch, the longest first, so that lanes end at about the same time; together in pieces of some ``PIECE`` bytes."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.argsort(-size, kind="stable")
    full = np.cumsum(size[order]) // PIECE
    yield from (x for x in np.split(order, np.flatnonzero(np.diff(full)) + 1) if len(x))


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words of all texts in one array, as bytes, and the places in it where each text begins and the last one ends."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.large_string()), "")))
    words, at = lists.flatten().cast(pa.large_binary()), lists.offsets.to_numpy()
    real = pc.greater(pc.binary_length(words), 0)  # white space at either end of a text leaves an empty one
    return words.filter(real), np.append(0, np.cumsum(real.to_numpy(zero_copy_only=False)))[at]


def word_counts(docs: DataFrame) -> DataFrame:
    """(token, n) over the texts in ``_t``, each with its end."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("_t")
            for piece in pieces(texts):
                found = pc.value_counts(words_of(texts.take(pa.array(piece)))[0])
                yield pa.RecordBatch.from_arrays([found.field("values").cast(pa.binary()), found.field("counts")], ["token", "n"])
                yield pa.RecordBatch.from_pydict({"token": pa.array([END], pa.binary()), "n": pa.array([len(piece)], pa.int64())})

    return docs.mapInArrow(count, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def _block() -> Column:
    """Blocks of counts, some fifty for each factor of e; small counts have one each."""
    return F.floor(50 * F.log(F.col("n"))).cast("int")


def gathered(counts: DataFrame, s: Settings) -> Words:
    """The dictionary and the sums. The dictionary has all words of the highest blocks of counts, ``dictionary`` words at most.

    What reaches the driver are the sizes of the blocks and those words; no task sorts more than its own.
    """
    end = F.lit(END)
    sizes = counts.groupBy(_block().alias("block"), (F.col("token") == end).alias("end")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    tokens, distinct, ends = sum(r.n for r in sizes), sum(r.v for r in sizes), sum(r.n for r in sizes if r.end)
    room, least = s.dictionary - 1, 1 + max((r.block for r in sizes), default=0)
    for r in sorted((r for r in sizes if not r.end), key=lambda r: -r.block):
        room -= r.v
        if room < 0:
            break
        least = r.block
    top = counts.where((F.col("token") != end) & (_block() >= least)).toArrow()
    found = sorted(zip(top.column("n").to_pylist(), top.column("token").to_pylist()), key=lambda x: (-x[0], x[1]))
    names, own = [END, *(w for _, w in found)], [ends, *(n for n, _ in found)]
    known = min(s.vocabulary, len(names))
    seen = sum(1 for n in own[:known] if n)
    return Words(names, own, tokens, distinct, tokens - sum(own[:known]), distinct - seen, known, least)


class _Reader:
    """Texts as rows of the model's input table and words to foretell."""

    def __init__(self, words: Words, s: Settings):
        self.names = pa.array(words.names, pa.large_binary())
        self.known, self.rare_inputs = words.known, s.rare_inputs
        tails = np.array([zlib.crc32(w[-2:]) % s.rare_inputs for w in words.names], np.int32)
        self.rows = np.where(np.arange(len(tails)) < self.known, np.arange(len(tails)), self.known + tails).astype(np.int32)
        self.start = np.int32(self.known + s.rare_inputs)

    def read(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]]:
        """Of each text the places in the dictionary (-1: none), input rows, words to foretell, and the words that have no place."""
        words, at = words_of(texts)
        found = pc.index_in(words, value_set=self.names)
        at = at + np.arange(len(at))  # a text is followed by its end
        places, ends = np.zeros(at[-1], np.int32), np.zeros(at[-1], bool)  # the end has place 0
        ends[at[1:] - 1] = True
        places[~ends] = pc.fill_null(found, -1).to_numpy()
        rows, other, absent = self.rows[places], np.flatnonzero(places < 0), words.filter(pc.is_null(found)).to_pylist()
        rows[other] = [self.known + zlib.crc32(w[-2:]) % self.rare_inputs for w in absent]
        inputs = np.empty_like(rows)
        inputs[1:], inputs[at[:-1]] = rows[:-1], self.start
        targets, cuts = np.where(places < self.known, places, -1), np.searchsorted(other, at).tolist()
        for (a, b), (c, d) in zip(pairwise(at.tolist()), pairwise(cuts)):
            yield places[a:b], inputs[a:b], targets[a:b], absent[c:d]


def _model(words: Words, s: Settings) -> Model:
    return Model(np.array(words.counts[: words.known]), words.rare_tokens, s.hidden, s.classes, s.rare_inputs, s.seed)


def averaged(copies: DataFrame) -> DataFrame:
    """(block, values) of ``copies(block, copy, weight, values)``, each the weighted mean, in two levels of bounded groups."""

    def mean(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("copy")
        values = np.average(np.stack(frame["values"].to_numpy()), axis=0, weights=frame["weight"])
        return pd.DataFrame({"block": [key[0]], "copy": [int(frame["copy"].iloc[0])], "weight": [frame["weight"].sum()], "values": [values]})

    kind = "block int, copy long, weight double, values array<float>"
    once = copies.groupBy("block", F.expr(f"copy div {TOGETHER}")).applyInPandas(mean, kind)
    return once.groupBy("block").applyInPandas(mean, kind)


def training_lanes(words: Words, copies: int, s: Settings) -> int:
    """Lanes with which ``copies`` copies of the model make about ``updates`` steps a round or more."""
    tokens = words.tokens // max(1, copies * s.rounds)
    return max(min(64, s.lanes), min(s.lanes, tokens // (s.steps * s.updates)))


def train(docs: DataFrame, words: Words, s: Settings) -> np.ndarray:
    """The packed model after all rounds over the texts in ``_t`` of ``docs(doc_id, _t)``.

    A round's documents are found by a hash of their id, so each is used once. What reaches the driver is one model.
    """
    context = docs.sparkSession.sparkContext
    shared, now = context.broadcast(words), _model(words, s).packed()
    lanes = training_lanes(words, docs.rdd.getNumPartitions(), s)
    for turn in range(s.rounds):
        start = context.broadcast(now)

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            reader, model = _Reader(shared.value, s), _model(shared.value, s)
            model.unpack(start.value)
            state, tokens = np.zeros((s.hidden, lanes), np.float32), 0

            def read() -> Iterator[Sequence]:
                for batch in batches:
                    texts = batch.column("_t")
                    for piece in pieces(texts):
                        for _, inputs, targets, _ in reader.read(texts.take(pa.array(piece))):
                            yield 0, inputs, targets

            for w in windows(read(), lanes, s.steps):
                tokens += int((w.targets > -2).sum())
                state[:, w.lanes] = model.learn(w, state[:, w.lanes], s.rate)
            if tokens:
                flat, copy = model.packed(), TaskContext.get().partitionId()
                parts = [flat[k : k + BLOCK] for k in range(0, len(flat), BLOCK)]
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array(range(len(parts)), pa.int32()), "copy": pa.array([copy] * len(parts), pa.int64()),
                    "weight": pa.array([float(tokens)] * len(parts)), "values": pa.array(parts, pa.list_(pa.float32())),
                })

        own = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(s.rounds)) == turn).select("_t")
        copies = own.mapInArrow(learn, "block int, copy long, weight double, values array<float>")
        found = {r.block: r["values"] for r in averaged(copies).collect()}
        if found:
            now = np.concatenate([np.array(found[k]) for k in range(len(found))]).astype(np.float32)
    return now


def _scored(docs: DataFrame, words: Words, model: np.ndarray, s: Settings) -> DataFrame:
    """Each document's tokens and sums over dictionary words, and its other words with their numbers."""
    context = docs.sparkSession.sparkContext
    shared, parameters = context.broadcast(words), context.broadcast(model)
    kind = "doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, tokens array<binary>, times array<int>"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, reader, net = shared.value, _Reader(shared.value, s), _model(shared.value, s)
        net.unpack(parameters.value)
        logs_of, no_end = np.log10(np.array(w.counts) + 1.0), w.counts[0] == 0
        whole, rare = math.log10(w.tokens + w.distinct + 1), math.log10(w.rare_tokens + w.rare_distinct + 1)
        state, opened, sums = np.zeros((s.hidden, s.lanes), np.float32), {}, {}

        def read() -> Iterator[Sequence]:
            number = 0
            for batch in batches:
                ids, helds, texts = batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), batch.column("_t")
                for piece in pieces(texts):
                    for k, (places, inputs, targets, absent) in zip(piece.tolist(), reader.read(texts.take(pa.array(piece)))):
                        here = places[places >= 0] if absent else places
                        found, beyond, other = logs_of[here], here >= w.known, Counter(absent)
                        opened[number] = (
                            ids[k], helds[k], len(places), len(here) - no_end, float(found.sum()) - len(places) * whole,
                            float(found[beyond].sum()) - (int(beyond.sum()) + len(absent)) * rare, list(other), list(other.values()),
                        )
                        sums[number] = 0.0
                        yield number, inputs, targets
                        number += 1

        for window in windows(read(), s.lanes, 2 * s.steps):
            logs, state[:, window.lanes] = net.score(window, state[:, window.lanes])
            for number, x in zip(window.of, np.add.reduceat(logs, window.at)):
                sums[number] += float(x)
            done = []
            for number in window.ended:
                row = opened.pop(number)
                done.append((*row[:5], row[5] + sums.pop(number) / math.log(10), *row[6:]))
            if done:
                c = list(zip(*done))
                yield pa.RecordBatch.from_arrays([
                    pa.array(c[0], pa.int64()), pa.array(c[1], pa.bool_()), pa.array(c[2], pa.int64()), pa.array(c[3], pa.int64()), pa.array(c[4], pa.float64()),
                    pa.array(c[5], pa.float64()), pa.array(c[6], pa.list_(pa.binary())), pa.array(c[7], pa.list_(pa.int32())),
                ], names=[x.split()[0] for x in kind.split(", ")])

    return docs.mapInArrow(score, kind)


class Learnt(NamedTuple):
    """What scoring needs: all word counts as a table, the dictionary, and the packed model."""

    counts: DataFrame
    words: Words
    model: np.ndarray


def _rows(docs: DataFrame, text: str) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("_t"))
    return rows.withColumn("held_out", held_out(F.col("doc_id")))


def learn_model(docs: DataFrame, settings: Settings = Settings(), text: str = "text") -> Learnt:
    """Counts and model from the documents that are not held out."""
    learnt = _rows(docs, text).where("not held_out")
    counts = cut(word_counts(learnt.select("_t")))
    words = gathered(counts, settings)
    return Learnt(counts, words, train(learnt.select("doc_id", "_t"), words, settings))


def score_with(learnt: Learnt, docs: DataFrame, settings: Settings = Settings(), text: str = "text") -> DataFrame:
    """The columns of ``score_documents`` for ``docs``, by what has been learnt."""
    words = learnt.words
    found = cut(_scored(_rows(docs, text), words, learnt.model, settings).withColumn("_row", F.monotonically_increasing_id()))
    other = found.select("_row", F.explode(F.arrays_zip("tokens", "times")).alias("x")).select("_row", "x.*")
    low = learnt.counts.where(_block() < words.least).select(F.col("token").alias("tokens"), "n")  # the words that tasks do not have
    more = other.join(low, "tokens").groupBy("_row").agg(F.sum("times").alias("_known"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("_log"))
    all_ = found.drop("tokens", "times").join(more, "_row", "left")
    zero = lambda name: F.coalesce(F.col(name), F.lit(0))
    return all_.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + zero("_known")).alias("n_known"), F.lit(words.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + zero("_log")).alias("base_score"), (F.col("score") + zero("_log")).alias("score"),
    )


def score_documents(docs: DataFrame, settings: Settings = Settings(), text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document.

    Tokens are the lower-cased words and one end. The base score is the sum of the logarithms of smoothed relative
    frequencies among training tokens; ``score`` is the model's log10 probability of the whole text, its end included. A null
    or empty text is its end alone. A document without id is learnt from. Repeated rows are learnt from and scored
    as often as they occur, one row each; texts of any length are scored to their end. Only ``doc_id`` and the text are
    read, so further columns, of any name, do no harm. If no document is learnt from, counts are zero, the base scores are zero
    and the model is the untrained one; an empty table gives no rows.
    """
    return score_with(learn_model(docs, settings, text), docs, settings, text)
