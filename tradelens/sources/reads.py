"""Scans, batch look-ups and sinks. Each takes all wallets or markets at once; none loops over keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tradelens.sources.shared import matching


def _first(df: DataFrame, by: list[str], order: list, most: int) -> DataFrame:
    """The first rows of each group; the limit is applied before the shuffle as well."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= most).drop("_r")


def trades_of(trades: DataFrame, wallet: int, start: int | None = None, end: int | None = None, min_size: int = 0, limit: int = 500, offset: int = 0) -> DataFrame:
    out = trades.where((F.col("wallet") == wallet) & (F.col("size") >= min_size))
    if start is not None:
        out = out.where(F.col("t") >= start)
    if end is not None:
        out = out.where(F.col("t") <= end)
    return out.orderBy(F.desc("t"), F.desc("trade_id")).offset(offset).limit(limit)


def full_history(trades: DataFrame, max_trades: int) -> DataFrame:
    return _first(trades, ["wallet"], [F.desc("t"), F.desc("trade_id")], max_trades)


def histories_batch(trades: DataFrame, wallets: DataFrame, max_trades: int = 500, min_size: int = 0) -> DataFrame:
    chosen = trades.where(F.col("size") >= min_size).join(wallets.select("wallet"), "wallet", "left_semi")
    return full_history(chosen, max_trades)


def incremental_trades(trades: DataFrame, marks: DataFrame) -> DataFrame:
    """Trades after each wallet's high-water mark ``last_t``; wallets without a mark come whole."""
    return trades.join(marks, "wallet", "left").where(F.col("t") > F.coalesce("last_t", F.lit(-1))).drop("last_t")


def large_trades(trades: DataFrame, min_size: int) -> DataFrame:
    return trades.where(F.col("size") >= min_size)


def market_window(trades: DataFrame, market: int, start: int, end: int, limit: int = 50_000) -> DataFrame:
    return trades.where((F.col("condition_id") == market) & F.col("t").between(start, end)).orderBy(F.desc("t"), F.desc("trade_id")).limit(limit)


def markets_by_status(markets: DataFrame, active: bool | None = None, closed: bool | None = None) -> DataFrame:
    if active is not None:
        markets = markets.where(F.col("active") == active)
    if closed is not None:
        markets = markets.where(F.col("closed") == closed)
    return markets


def market_info(markets: DataFrame) -> DataFrame:
    """The ten columns that describe a market; numbers that are missing are 0, and so is a missing description empty."""
    described = F.coalesce("description", F.lit("")) if "description" in markets.columns else F.lit("")
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
    return markets.select(
        "condition_id", "question", "group_item_title", "category", described.alias("description"), "slug", number("volume"), number("liquidity"), "active", "closed"
    )


def resolutions(markets: DataFrame) -> DataFrame:
    """Closed markets with the first highest outcome price as winner; rows without prices are dropped."""
    prices = F.transform(F.from_json("outcome_prices", "array<string>"), lambda x: x.cast("double"))
    out = markets.where("closed").select("condition_id", prices.alias("p"), F.coalesce("closed_at", F.lit(0)).cast("long").alias("closed_at"))
    winner = F.array_position("p", F.array_max("p")) - 1
    return out.where(F.size("p") > 0).select("condition_id", winner.cast("int").alias("winner_idx"), "closed_at")


def fills_of(fills: DataFrame, wallet: int, start: int, end: int, limit: int) -> DataFrame:
    """Fills as maker and as taker; a fill with oneself counts twice."""
    made = fills.where(F.col("maker") == wallet).unionByName(fills.where(F.col("taker") == wallet))
    return made.where(F.col("t").between(start, end)).orderBy(F.desc("t"), F.desc("event_id")).limit(limit)


def recent_fills(fills: DataFrame, limit: int) -> DataFrame:
    """The newest fills as trade rows at the fixed price 0.5."""
    out = fills.orderBy(F.desc("t"), F.desc("event_id")).limit(limit)
    return out.select(F.split("id", "_")[0].alias("condition_key"), F.col("maker").alias("wallet"), "t", F.lit("0.5").alias("price"), F.lit("BUY").alias("side"), "event_id")


def positions_batch(positions: DataFrame, wallets: DataFrame, each: int = 1000) -> DataFrame:
    chosen = positions.join(wallets.select("wallet"), "wallet", "left_semi")
    return _first(chosen, ["wallet"], [F.desc("current_value_c"), "condition_id", "outcome_index"], each)


def payouts_batch(ids: DataFrame, payouts: DataFrame) -> DataFrame:
    return ids.join(payouts, "condition_id", "left")


def redemptions_of(redemptions: DataFrame, wallet: int, limit: int) -> DataFrame:
    return redemptions.where(F.col("wallet") == wallet).orderBy(F.desc("t"), "condition_id").limit(limit)


def price_history(trades: DataFrame, seconds: int = 3600) -> DataFrame:
    """Last price of each market and interval, by trade id."""
    return trades.groupBy("condition_id", F.expr(f"t div {seconds} * {seconds}").alias("t")).agg(F.max_by("price_c", "trade_id").alias("p"))


def transfers_of(transfers: DataFrame, wallet: int) -> DataFrame:
    way = lambda end, name: transfers.where(F.col(end) == wallet).withColumn("direction", F.lit(name))
    return way("to_wallet", "in").unionByName(way("from_wallet", "out")).orderBy("block", "transfer_id", "direction")


def market_tokens(markets: DataFrame) -> DataFrame:
    return markets.select("condition_id", F.posexplode(F.from_json("token_ids", "array<string>")).alias("outcome_index", "token_id"))


def collect_markets(tagged: DataFrame) -> DataFrame:
    """Active markets of several tags, one row a tag."""
    return tagged.where("condition_id is not null and active")


def distinct_traders(trades: DataFrame) -> DataFrame:
    return trades.select("wallet").dropna().distinct()


def uncollected_histories(trades: DataFrame, wanted: DataFrame, collected: DataFrame, max_trades: int) -> DataFrame:
    todo = wanted.select("wallet").join(collected.select("wallet"), "wallet", "left_anti")
    return histories_batch(trades, todo, max_trades).withColumn("trader_address", F.col("wallet"))


def append_batch(trades: DataFrame, path: str) -> None:
    """Append a batch, laid out by market bucket, so that later reads prune folders."""
    trades.withColumn("bucket", F.pmod("condition_id", F.lit(16))).write.mode("append").partitionBy("bucket").parquet(path)


def write_trader_files(trades: DataFrame, folder: str, name: str) -> None:
    """Histories collected trader by trader, beside the batches of ``write_batch_files``."""
    trades.write.mode("overwrite").parquet(f"{folder}/trader_trades_{name}")


def write_batch_files(trades: DataFrame, folder: str, name: str) -> None:
    trades.write.mode("overwrite").parquet(f"{folder}/trades_batch_{name}")


def collected_trades(spark: SparkSession, folder: str) -> DataFrame:
    """All collected trades of a folder: the traders' histories if there are any, else the batches.

    Files of either kind may lack columns that others have; nothing is read before an action but footers.
    """
    for kind in ("trader_trades_*", "trades_batch_*"):
        found = matching(spark, f"{folder}/{kind}")
        if found:
            return spark.read.option("mergeSchema", "true").parquet(*found)
    raise FileNotFoundError(f"no collected trades in {folder}")


def export_profiles(profiles: DataFrame, path: str, kind: str = "parquet") -> None:
    """Write profiles as parquet, json or csv; nested columns become JSON text in csv."""
    if kind == "csv":
        nested = [c for c, t in profiles.dtypes if t.startswith(("struct", "array", "map"))]
        profiles = profiles.withColumns({c: F.to_json(c) for c in nested})
    getattr(profiles.write.mode("overwrite"), kind)(path)


def json_rows(df: DataFrame, column: str = "json") -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias(column))
