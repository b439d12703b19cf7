"""Open positions, portfolio snapshots and their alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

c = F.col


def positions_from_trades(trades: DataFrame, prices: DataFrame) -> DataFrame:
    """Net shares of each (wallet, market, outcome) at the market's last price; PnL against the mean buy price."""
    buy = c("side") == "BUY"
    net = trades.groupBy("wallet", "condition_id", "outcome_index").agg(
        F.sum(F.when(buy, c("size")).otherwise(-c("size"))).alias("size"), F.sum(F.when(buy, c("size")).otherwise(0)).alias("bought"),
        F.sum(F.when(buy, c("value_c")).otherwise(0)).alias("paid_c"),
    ).where("size > 0")
    last = prices.groupBy("condition_id").agg(F.max_by("p", "t").alias("cur_price_c"))
    out = net.join(last, "condition_id")
    return out.select(
        "wallet", "condition_id", "outcome_index", "size", (c("paid_c") / c("bought")).alias("avg_price_c"), "cur_price_c",
        (c("size") * c("cur_price_c")).alias("current_value_c"), F.round(c("size") * (c("cur_price_c") - c("paid_c") / c("bought")), 2).alias("total_pnl_c"),
    )


def daily_snapshots(trades: DataFrame) -> DataFrame:
    """(wallet, day, pnl_c): running cash result of each wallet at the end of each day it traded."""
    flow = F.when(c("side") == "SELL", c("value_c")).otherwise(-c("value_c"))
    daily = trades.groupBy("wallet", F.expr("t div 86400").alias("day")).agg(F.sum(flow).alias("d"))
    w = Window.partitionBy("wallet").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return daily.select("wallet", "day", F.sum("d").over(w).alias("pnl_c"))


def _top(df: DataFrame, order: list, most: int) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy("wallet").orderBy(*order))).where(c("place") <= most)


def _by_pnl() -> list:
    return [F.desc("total_pnl_c"), "condition_id", "outcome_index"]


def portfolio_summary(positions: DataFrame, first: int = 50, min_value_c: int = 500_000) -> DataFrame:
    kept = _top(positions, _by_pnl(), first).where(c("current_value_c") >= min_value_c)
    return kept.groupBy("wallet").agg(F.count("*").alias("positions"), F.round(F.sum("total_pnl_c"), 2).alias("pnl_c"), F.sum("current_value_c").alias("value_c"))


def portfolio_change_alerts(snapshots: DataFrame, min_change_c: int = 500_000) -> DataFrame:
    before = F.lag("pnl_c", 1, 0).over(Window.partitionBy("wallet").orderBy("day"))
    x = snapshots.withColumn("before_c", before)
    return x.where((c("before_c") == 0) | (F.abs(c("pnl_c") - c("before_c")) >= min_change_c))


def top_positions(positions: DataFrame, most: int = 5) -> DataFrame:
    return _top(positions, _by_pnl(), most).select("wallet", "condition_id", "outcome_index", "total_pnl_c", "place")


def top_holdings(positions: DataFrame, most: int = 10) -> DataFrame:
    kept = _top(positions, _by_pnl(), most).drop("place")
    return _top(kept, [F.desc("current_value_c"), "condition_id", "outcome_index"], most).select("wallet", "condition_id", "outcome_index", "current_value_c", "place")
