"""Global ranks without a task that holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Blocks a factor of e in the magnitude of a value.
FINENESS = 50


def value_block(value: Column) -> Column:
    """A block of values of like magnitude, which never falls as the value rises."""
    x = value.cast("double")
    return F.floor(F.signum(x) * F.log1p(F.abs(x)) * FINENESS).cast("long")


def ranked(df: DataFrame, by: list[str], block: Column, order: list[Column], out: str = "place", ties: bool = False) -> DataFrame:
    """``df`` with the place of each row in ``by``; ``order`` has to go through the blocks from the highest down.

    Rows are numbered inside their block and the counts of the blocks above are added. Counts combine on the
    map side, and the window over them sees one row a block. With ``ties`` equal rows share a place.
    """
    x = df.withColumn("_block", block)
    sums = x.groupBy(*by, "_block").agg(F.count("*").alias("_n"))
    above = Window.partitionBy(*by or [F.lit(0)]).orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(*by, "_block", F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_base"))
    inside = (F.rank() if ties else F.row_number()).over(Window.partitionBy(*by, "_block").orderBy(*order))
    placed = x.withColumn("_in", inside).join(bases, [*by, "_block"])
    return placed.withColumn(out, (F.col("_base") + F.col("_in")).cast("int")).drop("_block", "_base", "_in")


def ranked_values(df: DataFrame, by: list[str], value: str, out: str = "rank") -> DataFrame:
    """``df`` with the rank of its ``value`` in ``by``, highest first; equal values share a place.

    Values are counted first, so that a value of very many rows is one row in the windows.
    """
    counts = df.groupBy(*by, value).agg(F.count("*").alias("_n")).withColumn("_block", value_block(F.col(value)))
    sums = counts.groupBy(*by, "_block").agg(F.sum("_n").alias("_sum"))
    above = Window.partitionBy(*by or [F.lit(0)]).orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.select(*by, "_block", F.coalesce(F.sum("_sum").over(above), F.lit(0)).alias("_base"))
    higher = Window.partitionBy(*by, "_block").orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, -1)
    places = counts.withColumn("_in", F.coalesce(F.sum("_n").over(higher), F.lit(0))).join(bases, [*by, "_block"])
    placed = places.select(*by, value, (F.col("_base") + F.col("_in") + 1).cast("int").alias(out))
    return df.join(placed, [*by, value]).select(*df.columns, out)
