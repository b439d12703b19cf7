"""Temperature mixing of sources: weights from token shares, realised by budgeted permutations.

A source with token share p gets the weight p**a / sum(p**a). The exponent a falls from 1 (natural
mixture) until the mixture reaches a target entropy, or as far as the repetition limit of the smallest
source allows; it is found by many-way bisection, each pass one small aggregate over the sources. The
token budget is the least one at which no source falls below one full pass, so no document is lost.
Every full pass of a source holds all its documents; the last, partial pass is the head of a seeded
permutation of the source that fits the rest of the budget. The permutation runs through hash blocks:
block sums combine on the map side, and only the one block of each source in which the budget ends is
ordered row by row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradelens.llm.common import blocks_for, cut, restored, sheltered, sums_before, text_or_empty, words_of

ROWS_PER_BLOCK = 2_000
#: Points of each bisection pass and passes: 16**6 is finer than the rounding of the exponent.
POINTS, PASSES, DIGITS = 16, 6, 6
#: Up to so many sources the per-source table is broadcast (some 100 bytes each), beyond it is shuffled.
BROADCAST_SOURCES = 100_000


def solve_exponent(shares: DataFrame, entropy: float | None = None, max_repeat: float | None = None) -> float:
    """The exponent in [0, 1] for ``shares(share)``, rounded to six digits.

    With ``entropy`` (nats) the largest exponent at which the mixture reaches it, else the least one at
    which the smallest source is repeated at most ``max_repeat`` times. Where no exponent does, the
    nearest end of [0, 1].
    """
    low, high = 0.0, 1.0

    def enough(at: list[float]) -> list[bool]:
        """Whether an exponent is flat enough (entropy) or still within the limit (repetition)."""
        parts = []
        for k, a in enumerate(at):
            power = F.pow("share", F.lit(a))
            if entropy is not None:
                # H = ln Z - sum(q ln q) / Z for q = share**a
                parts.append((F.log(F.sum(power)) - F.sum(power * F.log(power)) / F.sum(power)).alias(f"h{k}"))
            else:
                parts.append(F.pow(F.max("share") / F.min("share"), F.lit(1 - a)).alias(f"h{k}"))
        row = shares.agg(*parts).first()
        return [v is not None and (v >= entropy if entropy is not None else v <= max_repeat) for v in row]

    for _ in range(PASSES):
        grid = [low + (high - low) * k / POINTS for k in range(POINTS + 1)]
        fits = enough(grid)
        if entropy is not None:  # true on the left, false on the right
            k = max((k for k, ok in enumerate(fits) if ok), default=0)
            low, high = grid[k], grid[min(k + 1, POINTS)]
        else:  # false on the left, true on the right
            k = min((k for k, ok in enumerate(fits) if ok), default=POINTS)
            low, high = grid[max(k - 1, 0)], grid[k]
    return round(low if entropy is not None else high, DIGITS)


def mix_sources(
    docs: DataFrame,
    max_repeat: float = 1.5,
    entropy: float | None = None,
    seed: int = 42,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """``docs`` repeated to the target mixture, with ``epoch`` (from 0), ``order_key`` and ``mix_tokens``.

    Tokens are white-space words. A null source is a source of its own; null and empty texts have no
    tokens and come in every full pass; a source without tokens comes once. Rows are ordered by a hash of
    their doc_id (null: of none), rows that repeat a doc_id enter the partial pass together. Input columns
    with the names added here are replaced. An empty table gives an empty result.
    """
    docs, inner = sheltered(docs, "epoch", "order_key", "mix_tokens")
    kept = list(inner.values())
    key = F.coalesce(F.concat(F.lit("s:"), F.col(inner[source]).cast("string")), F.lit("null"))
    seeded = lambda *more: F.md5(
        F.concat_ws(":", F.lit(str(seed)), *more, F.col(inner[doc_id]).cast("string")).cast("binary")
    )
    rows = docs.select(
        *kept, key.alias("_source"), seeded().alias("_h"),
        F.size(words_of(text_or_empty(inner[text]))).cast("long").alias("mix_tokens"),
    )
    narrow = cut(rows.select("_source", "_h", "mix_tokens"))
    blocks = blocks_for(narrow.count(), ROWS_PER_BLOCK)
    block = F.floor(F.conv(F.substring("_h", 1, 8), 16, 10).cast("long") * blocks / F.lit(2**32)).cast("int")
    sums = cut(narrow.groupBy("_source", block.alias("_block")).agg(F.sum("mix_tokens").alias("_tokens")))
    sources = sums.groupBy("_source").agg(F.sum("_tokens").alias("_total"))
    all_tokens = sources.agg(F.sum("_total")).first()[0] or 0
    shares = sources.where("_total > 0").withColumn("share", F.col("_total") / F.lit(float(max(all_tokens, 1))))
    exponent = solve_exponent(shares, entropy, max_repeat)
    top, n_sources = shares.agg(F.max("share"), F.count("*")).first()
    # passes of a source: weight * budget / tokens, with the budget at which the largest source has one
    rate = F.when(
        F.col("_total") > 0,
        F.pow(F.lit(top or 1.0) / (F.col("_total") / F.lit(float(max(all_tokens, 1)))), F.lit(1 - exponent)),
    ).otherwise(F.lit(1.0))
    plan = sources.select("_source", "_total", rate.alias("_rate")).select(
        "_source", F.floor("_rate").cast("int").alias("_full"),
        ((F.col("_rate") - F.floor("_rate")) * F.col("_total")).alias("_rest"),
    )
    bases = sums.join(sums_before(sums, ["_source"], "_block", "_tokens", "_base"), ["_source", "_block"])
    ends = bases.join(plan, "_source").where("_base + _tokens > _rest and _base <= _rest")
    ends = ends.groupBy("_source").agg(F.min(F.struct("_block", "_base", "_rest")).alias("e")).select("_source", "e.*")
    small = F.broadcast if n_sources <= BROADCAST_SOURCES else (lambda df: df)
    # equal hashes enter together: a row a hash, however many rows share it
    inside = narrow.withColumn("_block", block).join(small(ends), ["_source", "_block"])
    inside = inside.groupBy("_source", "_base", "_rest", "_h").agg(F.sum("mix_tokens").alias("mix_tokens"))
    running = F.sum("mix_tokens").over(Window.partitionBy("_source").orderBy("_h"))
    last = (
        inside.withColumn("_sum", F.col("_base") + running).where("_sum <= _rest").groupBy("_source").agg(F.max("_h").alias("_last"))
    )
    limits = cut(
        plan.join(ends.select("_source", F.col("_block").alias("_end")), "_source", "left").join(last, "_source", "left")
    )
    mixed = rows.join(small(limits), "_source").withColumn("_block", block)
    # no end block: the rest covers the whole source only if it has no tokens at all
    partial = F.when(F.col("_rest") <= 0, False).otherwise(
        (F.col("_block") < F.col("_end"))
        | ((F.col("_block") == F.col("_end")) & (F.col("_h") <= F.coalesce("_last", F.lit(""))))
    )
    copies = F.col("_full") + F.coalesce(partial, F.lit(False)).cast("int")
    return mixed.select(
        *kept, "mix_tokens", F.explode(F.sequence(F.lit(0), copies - 1)).alias("epoch")
    ).select(*restored(inner), "epoch", seeded(F.col("epoch").cast("string")).alias("order_key"), "mix_tokens")
