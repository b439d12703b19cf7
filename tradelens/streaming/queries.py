"""Registered streaming queries: each drains its stream over the whole events table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradelens.operators import incremental, market, positions, profiles
from tradelens.queries import MIN_VOLUME_C
from tradelens.sources import reads
from tradelens.sources.tables import DAY0, Tables
from tradelens.streaming import streams

c = F.col


def _feed(spark: SparkSession, folder: str) -> DataFrame:
    """A feed of message text: every trade, a message of the book for each purchase, and lines that cannot be used.

    Large trades come a second time cut short, and sales a second time without their market.
    """
    x, at = Tables(spark, folder).trades, f"{streams._folder(spark)}/feed"
    fields = ["trade_id", "wallet", "condition_id", "t", "side", "price_c", "size", "outcome_index"]
    message = lambda kind, *names: F.to_json(F.struct(F.lit(kind).alias("type"), *names))
    whole = message("trade", *fields)
    lines = F.array_compact(F.array(
        whole, F.when(c("side") == "BUY", message("book", "condition_id", "t", "price_c")),
        F.when(c("value_c") >= 500_000, F.expr("left(line, length(line) - 20)")), F.when(c("side") == "SELL", message("trade", "trade_id", "wallet", "t")),
    ))
    x.withColumn("line", whole).select(F.explode(lines).alias("value")).write.text(at)
    return streams.parse_messages(spark.readStream.text(at))


def src_stream_trades(spark: SparkSession, folder: str) -> DataFrame:
    """The trades of a mixed feed of text in which some lines are broken."""
    return streams.collected(streams.route(_feed(spark, folder)).select("trade_id", "wallet", "condition_id", "t"))


def st_unreadable_messages(spark: SparkSession, folder: str) -> DataFrame:
    """How many lines of the feed could not be used, by reason."""
    return streams.collected(streams.unreadable(_feed(spark, folder))).groupBy("reason").agg(F.count("*").alias("lines"))


def st_new_wallets(spark: SparkSession, folder: str) -> DataFrame:
    """Wallets without a profile stored on the first day."""
    x = Tables(spark, folder)
    n = x.read("events").agg(F.max("user_id") + 1).first()[0]
    fills = streams.trade_stream(spark, folder).select(
        c("trade_id").alias("event_id"), "ts", c("wallet").alias("maker"), ((c("wallet") * 31 + 7) % n).alias("taker")
    )
    return streams.collected(streams.new_wallets(fills, incremental.partials(x.trades.where(f"t < {DAY0 + 86400}"))))


def st_market_windows(spark: SparkSession, folder: str) -> DataFrame:
    """Windows that the final watermark has closed; ten minutes before the last trade on they stay open."""
    return streams.collected(streams.market_windows(streams.trade_stream(spark, folder)))


def st_market_windows_sliding(spark: SparkSession, folder: str) -> DataFrame:
    """Half hours that start every five minutes."""
    streams.rocksdb(spark)
    return streams.collected(streams.market_windows(streams.trade_stream(spark, folder), "30 minutes", 300))


def st_volume_anomalies(spark: SparkSession, folder: str) -> DataFrame:
    """Windows against the baseline of the hours before them, which moves with the stream."""
    streams.rocksdb(spark)
    return streams.collected(streams.volume_anomalies(streams.trade_stream(spark, folder), MIN_VOLUME_C))


def st_alert_cooldown(spark: SparkSession, folder: str) -> DataFrame:
    streams.rocksdb(spark)
    level = F.when(c("trade_id") % 7 == 0, "CRITICAL_TRADER").otherwise("STATISTICAL_ANOMALY")
    alerts = streams.trade_stream(spark, folder).where(c("value_c") >= 500_000)
    return streams.collected(streams.alert_cooldown(alerts.select("condition_id", "t", level.alias("alert_level")), 3600))


def st_large_trade_alerts(spark: SparkSession, folder: str) -> DataFrame:
    x = Tables(spark, folder)
    watched = profiles.winrate(x.trades, x.resolutions).where("winrate >= 0.5")
    out = streams.large_trade_alerts(streams.trade_stream(spark, folder), watched)
    return streams.collected(out.select("trade_id", "wallet", "condition_id", "value_c"))


def st_trade_batches(spark: SparkSession, folder: str) -> DataFrame:
    return streams.collected(streams.trade_batches(streams.trade_stream(spark, folder)))


def st_trade_notifications(spark: SparkSession, folder: str) -> DataFrame:
    """Batches that end ten days or more after the last one notified; a wallet seldom returns to a market of the test tables sooner."""
    streams.rocksdb(spark)
    return streams.collected(streams.trade_notifications(streams.trade_batches(streams.trade_stream(spark, folder)), 864_000))


def trade_batches_batch(spark: SparkSession, folder: str) -> DataFrame:
    return streams.trade_batches(Tables(spark, folder).trades)


def st_position_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Daily snapshots, written once and replayed as a stream."""
    streams.rocksdb(spark)
    at = f"{streams._folder(spark)}/snapshots"
    positions.daily_snapshots(Tables(spark, folder).trades).write.parquet(at)
    stream = spark.readStream.schema("wallet long, day long, pnl_c long").parquet(at)
    return streams.collected(streams.position_changes(stream))


def st_critical_count_milestones(spark: SparkSession, folder: str) -> DataFrame:
    """Wallets in order of their first whale trade stand for newly critical ones."""
    return streams.milestone_stream(streams.trade_stream(spark, folder).where("value_c >= 500000").select("wallet", "t"))


def critical_count_milestones_batch(spark: SparkSession, folder: str) -> DataFrame:
    whales = Tables(spark, folder).trades.where("value_c >= 500000")
    return streams.milestones(whales.groupBy("wallet").agg(F.min("t").alias("t")))


def st_late_data(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly counts under a watermark; ``streams.drained`` tells how many rows came later."""
    trades = streams.trade_stream(spark, folder)
    out = trades.withWatermark("ts", "2 hours").groupBy(F.window("ts", "1 hour").alias("win")).agg(F.count("*").alias("trades"))
    return streams.collected(out.select(F.unix_timestamp("win.start").alias("w"), "trades"))


def sink_trade_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Two appended batches, read back as one table."""
    trades = Tables(spark, folder).trades.drop("ts")
    at = f"{streams._folder(spark)}/trades"
    reads.append_batch(trades.where("trade_id % 2 = 0"), at)
    reads.append_batch(trades.where("trade_id % 2 = 1"), at)
    return spark.read.parquet(at).groupBy("bucket").agg(F.count("*").alias("trades"), F.sum("value_c").alias("value_c"))


def collected_trades(spark: SparkSession, folder: str) -> DataFrame:
    """A folder with batches of all trades and histories of the leaderboards' heads, which are preferred."""
    x, at = Tables(spark, folder), f"{streams._folder(spark)}/collected"
    reads.write_batch_files(x.trades, at, "0")
    reads.write_trader_files(reads.histories_batch(x.trades, profiles.elite_wallets(x.leaderboard), 1_000_000), at, "0")
    return reads.collected_trades(spark, at).groupBy("wallet").agg(F.count("*").alias("trades"), F.sum("value_c").alias("value_c"))


def stream_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        src_stream_trades, st_new_wallets, st_market_windows, st_market_windows_sliding, st_volume_anomalies, st_alert_cooldown,
        st_large_trade_alerts, st_trade_batches, st_trade_notifications, trade_batches_batch, st_position_changes,
        st_critical_count_milestones, critical_count_milestones_batch, st_late_data, sink_trade_batches,
        st_unreadable_messages, collected_trades,
    ]
    return {f.__name__: f for f in found}
