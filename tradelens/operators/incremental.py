"""Stale profiles and incremental maintenance from mergeable partials, in memory and as a stored table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradelens.functions.scalars import ratio
from tradelens.operators.profiles import resolved_trades
from tradelens.sources.shared import checkpointed, folder_exists

#: 2**LG_K registers a sketch of distinct markets: a standard error of 1.04 / sqrt(2**LG_K), 1.6 %.
LG_K = 12


def stale_profiles(spans: DataFrame, as_of, ttl_s: int = 86400) -> DataFrame:
    age = as_of - F.col("last_t")
    return spans.select("wallet", "last_t", (age > ttl_s).alias("stale"))


def stale_stats(spans: DataFrame, as_of, ttl_s: int = 86400) -> DataFrame:
    x = stale_profiles(spans, as_of, ttl_s)
    stale = F.sum(F.when(F.col("stale"), 1).otherwise(0)).cast("long")
    return x.agg(F.count("*").alias("profiles"), stale.alias("stale"), (F.count("*") - stale).alias("fresh"))


def partials(trades: DataFrame) -> DataFrame:
    """Additive state of a wallet: enough to continue without its old trades."""
    return trades.groupBy("wallet").agg(
        F.count("*").alias("trades"), F.sum("value_c").alias("volume_c"), F.max("value_c").alias("max_value_c"), F.min("t").alias("first_t"), F.max("t").alias("last_t")
    )


def merge_partials(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored and new partials folded by wallet; both sides may hold wallets that the other lacks."""
    return stored.unionByName(new).groupBy("wallet").agg(
        F.sum("trades").alias("trades"), F.sum("volume_c").alias("volume_c"), F.max("max_value_c").alias("max_value_c"), F.min("first_t").alias("first_t"), F.max("last_t").alias("last_t")
    )


def incremental_merge(stored: DataFrame, trades: DataFrame) -> DataFrame:
    """Fold the trades after each stored profile's last time into it."""
    mark = stored.select("wallet", F.col("last_t").alias("mark"))
    fresh = trades.join(mark, "wallet", "left").where(F.col("mark").isNull() | (F.col("t") > F.col("mark")))
    return merge_partials(stored, partials(fresh))


def profile_partials(trades: DataFrame, resolutions: DataFrame) -> DataFrame:
    """Mergeable state of a wallet: counts, sums, extremes, wins and losses, and a sketch of its markets.

    A trade counts as resolved if its market's outcome is known when it is folded in.
    """
    known, won = F.col("winner_idx").isNotNull(), F.col("win")
    one = lambda x: F.sum(F.when(x, 1).otherwise(0)).cast("long")
    return resolved_trades(trades, resolutions, "left").groupBy("wallet").agg(
        F.count("*").alias("trades"), F.sum("value_c").alias("volume_c"), F.max("value_c").alias("max_value_c"), F.min("t").alias("first_t"),
        F.max("t").alias("last_t"), one(known).alias("resolved"), one(won).alias("wins"), F.hll_sketch_agg("condition_id", LG_K).alias("market_sketch"),
    )


def merge_profiles(*sides: DataFrame) -> DataFrame:
    """The partials of all sides folded by wallet."""
    x = sides[0]
    for other in sides[1:]:
        x = x.unionByName(other)
    sums = [F.sum(n).cast("long").alias(n) for n in ("trades", "volume_c", "resolved", "wins")]
    return x.groupBy("wallet").agg(
        *sums, F.max("max_value_c").alias("max_value_c"), F.min("first_t").alias("first_t"), F.max("last_t").alias("last_t"),
        F.hll_union_agg("market_sketch").alias("market_sketch"),
    )


def with_rates(profiles: DataFrame) -> DataFrame:
    """Stored partials as a profile: rates, the mean value and the number of markets instead of their sketch."""
    return profiles.withColumns({
        "winrate": ratio(F.col("wins"), F.col("resolved")), "avg_value_c": ratio(F.col("volume_c"), F.col("trades")),
        "markets": F.hll_sketch_estimate("market_sketch"),
    }).drop("market_sketch")


class ProfileStore:
    """Profiles as a table of buckets of wallets, into which trades are folded; buckets without new trades are not written.

    A fold that is repeated after a failure is harmless: every wallet takes only trades after its own last one.
    """

    SCHEMA = (
        "wallet long, trades long, volume_c long, resolved long, wins long, max_value_c long, first_t long, last_t long, market_sketch binary, bucket int"
    )

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets

    def read(self) -> DataFrame:
        """All stored partials, with their bucket."""
        if not folder_exists(self.spark, self.path):
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    def fold(self, trades: DataFrame, resolutions: DataFrame) -> list[int]:
        """Fold in the trades after each wallet's last one; the buckets written are returned."""
        mark = self.read().select("wallet", F.col("last_t").alias("_mark"))
        fresh = trades.join(mark, "wallet", "left").where(F.col("_mark").isNull() | (F.col("t") > F.col("_mark"))).drop("_mark")
        bucket = F.pmod(F.xxhash64("wallet"), F.lit(self.buckets)).cast("int")
        new = checkpointed(profile_partials(fresh, resolutions).withColumn("bucket", bucket))
        touched = sorted(r.bucket for r in new.select("bucket").distinct().collect())  # no more than there are buckets
        if touched:
            old = self.read().where(F.col("bucket").isin(touched)).drop("bucket")
            # a written copy, as the files read here are replaced
            merged = checkpointed(merge_profiles(old, new.drop("bucket")).withColumn("bucket", bucket))
            out = merged.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            out.partitionBy("bucket").parquet(self.path)
        return touched
