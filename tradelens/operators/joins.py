"""Joins and merges between trades, profiles, leaderboards and registries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def price_lookahead(prices: DataFrame, ahead_s: int = 86400) -> DataFrame:
    """Extremes of the following day at each point: a range frame in place of a self join."""
    w = Window.partitionBy("condition_id").orderBy("t").rangeBetween(1, ahead_s)
    return prices.select("condition_id", "t", "p", F.max("p").over(w).alias("next_max"), F.min("p").over(w).alias("next_min"), F.count("*").over(w).alias("points"))


def profiles_with_board(computed: DataFrame, board: DataFrame) -> DataFrame:
    """Leaderboard PnL wins over the computed one."""
    b = board.where("category = 'OVERALL' and period = 'MONTH'").select("wallet", F.col("pnl_c").alias("board_c"), "rank")
    return computed.join(b, "wallet", "left").select("wallet", F.coalesce("board_c", "pnl_c").alias("pnl_c"), "rank")


def semi(trades: DataFrame, wallets: DataFrame) -> DataFrame:
    return trades.join(wallets.select("wallet"), "wallet", "left_semi")


def anti(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right.select(key), key, "left_anti")


def merge_override(base: DataFrame, better: DataFrame, key: str = "wallet") -> DataFrame:
    """Rows of ``base``, each replaced where ``better`` has its key; both have the same columns."""
    names = [c for c in base.columns if c != key]
    b = better.select(key, F.struct(*names).alias("_b"))
    x = base.join(b, key, "left")
    return x.select(key, *[F.when(F.col("_b").isNotNull(), F.col(f"_b.{n}")).otherwise(F.col(n)).alias(n) for n in names])
