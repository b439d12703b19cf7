"""Shards that all match the corpus mixture, by proportional stratified interleaving.

Rows are shuffled by a seeded hash within each source, ranked there, given the fractional rank
``(rank - 1/2) / rows of the source``, sorted by it and cut into runs of equal row count. Ranks are
found in blocks: a block is a range of the hash (or of the fractional rank), its rows are numbered
inside one task and the counts of earlier blocks are added, so a source with a third of all rows is
spread like any other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tradelens.llm.common import blocks_for, cut, sums_before, text_or_empty

ROWS_PER_BLOCK = 2_000


def _rank_in_blocks(df: DataFrame, by: list[str], block: str, order: list, out: str) -> DataFrame:
    """``out``: how many rows of ``by`` come before; ``block`` never falls along ``order``, a row stands for ``w``."""
    sums = df.groupBy(*by, block).agg(F.sum("w").alias("_n"))
    bases = sums_before(sums, by, block, "_n", "_base")
    before = Window.partitionBy(*by, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = df.withColumn("_in", F.coalesce(F.sum("w").over(before), F.lit(0)))
    return inside.join(bases, [*by, block]).withColumn(out, F.col("_base") + F.col("_in")).drop("_base", "_in", "w")


def interleaved_shards(
    docs: DataFrame, shards: int = 8, seed: int = 42, doc_id: str = "doc_id", text: str = "text", source: str = "source"
) -> DataFrame:
    """(doc_id, source, size, text_crc32, position, shard, slot) for every row of ``docs``.

    Shard row counts differ by at most one and each shard holds every source in proportion, within one
    row for each source. ``position`` is the global place, ``slot`` the gapless place in the shard. A
    null source is a source of its own, a null text has size 1, a null doc_id takes part like any id.
    Rows are shuffled by a hash of doc_id, checksum and size; rows equal in all of these are interchangeable
    and travel as one row with their number until they have their places. Extra columns are ignored; an empty table gives an empty result; with fewer
    rows than shards, late shards stay empty.
    """
    body = text_or_empty(f"`{text}`")
    rows = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        F.coalesce(F.col(f"`{source}`").cast("string"), F.lit("")).alias("source"),
        F.col(f"`{source}`").isNull().alias("no_source"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
    )
    hashed = F.md5(F.concat_ws(":", F.lit(str(seed)), "doc_id", "text_crc32", "size").cast("binary"))
    group, ties = ["source", "no_source"], ["h", "doc_id", "text_crc32", "size"]
    rows = cut(rows.withColumn("h", hashed).groupBy(*group, *ties).agg(F.count("*").alias("copies")))
    total = rows.agg(F.sum("copies")).first()[0] or 0
    blocks = blocks_for(total, ROWS_PER_BLOCK)
    number = F.conv(F.substring("h", 1, 8), 16, 10).cast("long")
    parts = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {ROWS_PER_BLOCK}"))).alias("copy")
    weighed = rows.select(*group, *ties, "copies", parts, F.floor(number * blocks / F.lit(2**32)).cast("int").alias("block"))
    weighed = weighed.withColumn("w", F.least(F.lit(ROWS_PER_BLOCK).cast("long"), F.col("copies") - F.col("copy") * ROWS_PER_BLOCK))
    ranked = _rank_in_blocks(weighed.withColumn("many", F.col("w")), group, "block", [*ties, "copy"], "before").drop("block")
    ranked = ranked.withColumn("rank", F.explode(F.sequence(F.col("before") + 1, F.col("before") + F.col("many"))))
    totals = rows.groupBy(*group).agg(F.sum("copies").alias("source_rows"))
    spread = ranked.join(totals, group).withColumn("part", (F.col("rank") - F.lit(0.5)) / F.col("source_rows"))
    spread = spread.withColumns({"block": F.floor(F.col("part") * blocks).cast("int"), "w": F.lit(1).cast("long")})
    placed = _rank_in_blocks(spread, [], "block", ["part", *group, *ties], "position")
    n = max(total, 1)
    shard = F.expr(f"cast(position * {shards} div {n} as int)")
    first = F.expr(f"((position * {shards} div {n}) * {n} + {shards - 1}) div {shards}")
    return placed.select(
        "doc_id", F.when(~F.col("no_source"), F.col("source")).alias("source"), "size", "text_crc32", "position",
        shard.alias("shard"), (F.col("position") - first).alias("slot"),
    )
