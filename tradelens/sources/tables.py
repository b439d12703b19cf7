"""The engine's input tables, derived from the driver's tables as lazy DataFrames (see FIXTURES.md)."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Epoch seconds of the first day of the test tables.
DAY0 = 1704067200


class Tables:
    """Lazy views over one data folder; nothing is read before an action."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def wallets(self):
        """Number of wallets as a scalar subquery."""
        return self.read("events").select(F.max("user_id") + 1).scalar()

    @cached_property
    def trades(self) -> DataFrame:
        e = self.read("events").select(
            F.col("event_id").alias("trade_id"), F.col("user_id").alias("wallet"),
            F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("condition_id"),
            F.col("ts").cast("timestamp").alias("ts"), "event_type", "value",
        )
        e = e.withColumn("t", F.unix_timestamp("ts"))
        return e.select(
            "trade_id", "wallet", "condition_id", "ts", "t",
            F.expr("case when event_type in ('click', 'purchase', 'view') then 'BUY' else 'SELL' end").alias("side"),
            F.expr("5 + abs((t div 3600 + condition_id * 13) % 168 - 84) + (trade_id * 37) % 5").cast("long").alias("price_c"),
            F.expr("cast((trade_id div 3) % 2 as int)").alias("outcome_index"),
            F.round(F.col("value") * 100).cast("long").alias("size"),
        ).withColumn("value_c", F.col("size") * F.col("price_c"))

    @cached_property
    def markets(self) -> DataFrame:
        return self.read("part").select(
            F.col("p_partkey").cast("int").alias("condition_id"), F.col("p_name").alias("question"),
            F.lit("").alias("group_item_title"), F.expr("case when p_partkey % 2 = 0 then concat('Resolves on ', p_name) end").alias("description"),
            F.expr(
                "case p_type when 'PROMO' then 'tech' when 'ECONOMY' then 'economy' when 'LARGE' then 'politics' "
                "when 'MEDIUM' then 'sports' when 'SMALL' then 'crypto' else 'other' end"
            ).alias("category"),
            F.lit("").alias("slug"),
            F.round(F.col("p_retailprice") * F.col("p_size") * 4).cast("long").alias("liquidity"),
            F.expr("cast(round(p_retailprice * p_size * 4) as bigint) div 2").alias("volume"),
            F.expr("p_partkey % 5 = 0").alias("active"), F.expr("p_partkey % 5 <> 0").alias("closed"),
            F.expr("""case when p_size % 2 = 0 then '["1","0"]' else '["0","1"]' end""").alias("outcome_prices"),
            F.expr("concat('[\"', p_partkey * 2, '\",\"', p_partkey * 2 + 1, '\"]')").alias("token_ids"),
            F.expr(f"{DAY0} + ((p_partkey * 7) % 29 + 1) * 86400").alias("closed_at"),
            F.expr(f"{DAY0} + (p_partkey % 10) * 86400").alias("created_t"),
        ).withColumn("slug", F.concat_ws("-", "category", "condition_id"))

    @cached_property
    def resolutions(self) -> DataFrame:
        from tradelens.sources.reads import resolutions

        return resolutions(self.markets)

    @cached_property
    def fills(self) -> DataFrame:
        return self.read("events").select(
            "event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t"), F.col("user_id").alias("maker"),
            ((F.col("user_id") * 31 + 7) % self.wallets).alias("taker"),
        )

    @cached_property
    def transfers(self) -> DataFrame:
        o = self.read("orders").withColumn("n", self.wallets)
        return o.select(
            F.expr("(o_orderkey * 1103) % 2592000").alias("block"),
            F.expr("(o_orderkey * 7 + 3) % (n div 5)").alias("from_wallet"), F.expr("o_custkey % n").alias("to_wallet"),
            F.round(F.col("o_totalprice") * 100).cast("long").alias("value_c"), F.col("o_orderkey").alias("transfer_id"),
            F.expr(f"{DAY0} + (o_orderkey * 1103) % 2592000").alias("t"),
        )

    @cached_property
    def price_history(self) -> DataFrame:
        from tradelens.sources.reads import price_history

        return price_history(self.trades)

    @cached_property
    def quotes(self) -> DataFrame:
        return self.trades.groupBy("condition_id", F.expr("t div 3600 * 3600").alias("t")).agg(
            F.min("price_c").alias("bid"), F.max("price_c").alias("ask")
        )

    @cached_property
    def big_trades(self) -> DataFrame:
        """Order lines as trades, for load: some six times as many rows as ``events``."""
        o = self.read("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("wallet"))
        return self.read("lineitem").join(o, "l_orderkey").select(
            F.expr("l_orderkey * 10 + l_linenumber").alias("trade_id"), "wallet",
            F.col("l_partkey").cast("int").alias("condition_id"), F.col("l_shipdate").cast("timestamp").alias("ts"),
            F.unix_timestamp(F.col("l_shipdate").cast("timestamp")).alias("t"),
            F.expr("case when l_linenumber % 2 = 0 then 'SELL' else 'BUY' end").alias("side"),
            F.expr("cast(l_extendedprice as bigint) % 97 + 1").alias("price_c"),
            F.expr("cast(l_linenumber % 2 as int)").alias("outcome_index"),
            F.expr("cast(l_quantity * 100 as bigint)").alias("size"),
        ).withColumn("value_c", F.col("size") * F.col("price_c"))

    @cached_property
    def as_of(self):
        """One day after the last trade, as a scalar subquery."""
        return self.trades.select(F.max("t") + 86400).scalar()

    @cached_property
    def positions(self) -> DataFrame:
        from tradelens.operators.positions import positions_from_trades

        return positions_from_trades(self.trades, self.price_history)

    @cached_property
    def snapshots(self) -> DataFrame:
        from tradelens.operators.positions import daily_snapshots

        return daily_snapshots(self.trades)

    @cached_property
    def leaderboard(self) -> DataFrame:
        from tradelens.operators.profiles import leaderboard

        return leaderboard(self.trades, self.resolutions, self.markets, month_days=15)  # the test tables span a month

    @cached_property
    def contracts(self) -> DataFrame:
        return self.trades.select("wallet").distinct().where("wallet % 17 = 0")
