"""Importance resampling toward a target: hashed n-gram features, gains by bucket, noise, and the highest scores.

Texts are UTF-8 bytes all along: a table of 256 bytes lower-cases A-Z and turns separators into blanks,
``bytes.split`` gives words, and ``zlib.crc32`` seeded with the value of the shorter run gives that of a longer one.
Counts go by bucket, of which there are a fixed number (a parameter), so what tasks exchange and what the driver
passes on, the gains, do not grow with the input; scores and ranks stay distributed.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradelens.llm.common import cut, sums_before

#: Separators are the ASCII characters other than letters and digits.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
#: Words whose gains a task remembers; it starts anew beyond that.
REMEMBERED = 1_000_000


def words_of_bytes(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(TABLE).split()


def hashes_of(words: list[bytes], longest: int) -> Iterator[int]:
    """CRC-32 of all runs of 1 to ``longest`` words, joined by one blank."""
    seeds = list(map(zlib.crc32, words))
    yield from seeds
    for k in range(1, longest):
        seeds = [zlib.crc32(b" " + word, seed) for seed, word in zip(seeds, words[k:])]
        yield from seeds


def _texts(batch: pa.RecordBatch) -> list[bytes | None]:
    return batch.column("_t").cast(pa.large_binary()).to_pylist()


def bucket_counts(docs: DataFrame, longest: int = 1, buckets: int = 10_000, text: str = "text") -> DataFrame:
    """(bucket, n): features of all texts by bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[int] = Counter()
        for batch in batches:
            if longest == 1:
                words: Counter[bytes] = Counter()
                for t in _texts(batch):
                    words.update(words_of_bytes(t))
                for word, n in words.items():
                    found[zlib.crc32(word) % buckets] += n
            else:
                for t in _texts(batch):
                    found.update(h % buckets for h in hashes_of(words_of_bytes(t), longest))
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(list(found), pa.int32()), "n": pa.array(list(found.values()), pa.int64())})

    parts = docs.select(F.col(f"`{text}`").cast("string").alias("_t")).mapInArrow(count, "bucket int, n long")
    return parts.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, text: str = "text") -> list[int]:
    """The gain of every bucket in thousandths of a natural logarithm; ``buckets`` numbers reach the driver."""
    own = bucket_counts(docs, longest, buckets, text).select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"))
    other = bucket_counts(target, longest, buckets, text).select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t"))
    rows = own.unionByName(other).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).collect()
    all_s, all_t = sum(r.s for r in rows), sum(r.t for r in rows)
    counts = {r.bucket: (r.s, r.t) for r in rows}

    def gain(s: int, t: int) -> int:
        return math.floor(1000 * math.log(float(t + 1) * float(all_s + buckets) / (float(s + 1) * float(all_t + buckets))))

    return [gain(*counts.get(b, (0, 0))) for b in range(buckets)]


def noise(doc_id: int | None, seed: str) -> int:
    """Gumbel noise in thousandths from the hash of ``seed`` and the id."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


class _Gains(dict):
    """Gains by word, hashed when a word is first met."""

    def __init__(self, gains: list[int]):
        super().__init__()
        self.gains = gains

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = found = self.gains[zlib.crc32(word) % len(self.gains)]
        return found


def importance_scores(
    docs: DataFrame, target: DataFrame, longest: int = 1, buckets: int = 10_000, seed: str = "2024", text: str = "text"
) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every document.

    The weight is the sum of the gains of its features; the score adds noise that depends on the id alone. A null
    or empty text has no features and weighs 0. A null doc_id takes part; its noise is that of the empty id.
    Repeated rows get the same score, one row each. Only ``doc_id`` and the text are read, so further columns, of
    any name, do no harm. An empty table gives no rows, and an empty target counts as one without features.
    """
    gains = docs.sparkSession.sparkContext.broadcast(bucket_gains(docs, target, longest, buckets, text))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain, of_word = gains.value, _Gains(gains.value)
        for batch in batches:
            ids, out = batch.column("doc_id").to_pylist(), []
            for doc_id, t in zip(ids, _texts(batch)):
                words = words_of_bytes(t)
                if longest == 1:
                    n, weight = len(words), sum(map(of_word.__getitem__, words))
                else:
                    found = [gain[h % buckets] for h in hashes_of(words, longest)]
                    n, weight = len(found), sum(found)
                out.append((doc_id, len(words), n, weight, weight + noise(doc_id, seed)))
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "n_words", "n_features", "weight", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col(f"`{text}`").cast("string").alias("_t"))
    return rows.mapInArrow(score, "doc_id long, n_words long, n_features long, weight long, score long")


def draw(scored: DataFrame, percent: int = 10, least_words: int = 20) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, ... by falling score for ``percent`` of the documents of enough words, else null.

    Ties go to the smaller doc_id, a null one last. Rows equal in all columns travel as one with a number. Documents are
    numbered within their score, and the counts of higher scores, added up in two levels, come on top. Noise
    spreads scores: at equal weights a score holds under one in 2,700 of the documents.
    """
    names = scored.columns
    x = cut(scored.groupBy(*names).agg(F.count("*").alias("_n")))
    fits = x.where(F.col("n_words") >= least_words)
    by_score = fits.groupBy((-F.col("score")).alias("_block")).agg(F.sum("_n").alias("_sum"))
    above = sums_before(by_score, [], "_block", "_sum", "_above")
    places = fits.select(*names, "_n", (-F.col("score")).alias("_block")).join(above, "_block")
    inside = F.expr("sum(_n) over (partition by _block order by doc_id nulls last, n_features, weight, n_words rows unbounded preceding)")
    last = places.select(*names, "_n", (F.col("_above") + inside).alias("_last"))
    most = fits.select(F.expr(f"coalesce(sum(_n), 0) * {percent} div 100")).scalar()
    each = F.explode(F.sequence(F.col("_last") - F.col("_n") + 1, F.col("_last"))).alias("_place")
    drawn = last.select(*names, each).withColumn("rank", F.when(F.col("_place") <= most, F.col("_place"))).drop("_place")
    other = x.where((F.col("n_words") < least_words) | F.col("n_words").isNull())
    rest = other.select(*names, F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("_place")).select(*names, F.lit(None).cast("long").alias("rank"))
    return drawn.unionByName(rest)


def resampled(docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, longest: int = 1, buckets: int = 10_000, seed: str = "2024") -> DataFrame:
    """The rows of ``docs`` whose doc_id was drawn, with their own columns."""
    drawn = draw(importance_scores(docs, target, longest, buckets, seed), percent, least_words).where("rank is not null")
    return docs.join(drawn.select(F.col("doc_id").alias("_drawn")).distinct(), F.col("doc_id").eqNullSafe(F.col("_drawn")), "left_semi")
