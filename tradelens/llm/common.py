"""Helpers that the corpus operators share: table reading, lineage cuts and block sizing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradelens.sources.shared import shared_folder

#: Blocks whose counts one window task adds up; their sums are added up one level higher.
BLOCKS_TOGETHER = 64
#: Characters that separate words: space and U+0009 to U+000D.
WORD_SPACE = " \t\n\x0b\x0c\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the corpus tables as Spark reads it."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the checkpoint folder, reliably, and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def text_or_empty(name: str = "text") -> Column:
    """The text column with null read as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))


def words_of(text: Column) -> Column:
    """Maximal runs of characters that are no word space."""
    bare = F.btrim(text, F.lit(WORD_SPACE))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[ \t-\r]+"))


def blocks_for(rows: int, rows_per_block: int) -> int:
    """How many equal hash blocks keep a block near ``rows_per_block`` rows."""
    return max(1, -(-rows // rows_per_block))


def sums_before(sums: DataFrame, by: list[str], block: str, amount: str, out: str) -> DataFrame:
    """(*by, block, out): the ``amount`` of all earlier blocks of ``by``, in two levels.

    ``sums`` has one row a block. A window task adds up ``BLOCKS_TOGETHER`` blocks, one more the sums of those.
    """
    x = sums.withColumn("_above", F.floor(F.col(block) / BLOCKS_TOGETHER))
    whole = x.groupBy(*by, "_above").agg(F.sum(amount).alias("_whole"))
    earlier = lambda *keys: Window.partitionBy(*keys or [F.lit(0)]).rowsBetween(Window.unboundedPreceding, -1)
    upper = whole.select(*by, "_above", F.coalesce(F.sum("_whole").over(earlier(*by).orderBy("_above")), F.lit(0)).alias("_upto"))
    inside = x.withColumn("_within", F.coalesce(F.sum(amount).over(earlier(*by, "_above").orderBy(block)), F.lit(0)))
    return inside.join(upper, [*by, "_above"]).select(*by, block, (F.col("_upto") + F.col("_within")).alias(out))


def sheltered(docs: DataFrame, *added: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` under names that no work column has, without the columns ``added``, and name -> inner name."""
    inner = {c: f"__in{k}" for k, c in enumerate(c for c in docs.columns if c not in added)}
    return docs.select(*[F.col(f"`{c}`").alias(i) for c, i in inner.items()]), inner


def restored(inner: dict[str, str]) -> list[Column]:
    """The columns of ``sheltered`` under their own names."""
    return [F.col(i).alias(c) for c, i in inner.items()]
