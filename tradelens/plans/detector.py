"""Entry points: whole analyses as one lazy plan each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradelens.operators import graph, market, profiles, scoring


def wallet_clusters(trades: DataFrame, window_s: int = 60, min_pairs: int = 3) -> DataFrame:
    return graph.wallet_clusters(trades, window_s, min_pairs)


def fast_profiles(trades: DataFrame, resolutions: DataFrame, markets: DataFrame, positions: DataFrame) -> DataFrame:
    board = profiles.leaderboard(trades, resolutions, markets)
    return scoring.fast_profiles(
        trades.select("wallet").distinct(), board, profiles.markets_traded(trades), profiles.positions_value(positions)
    )


def score_profiles(trades: DataFrame, resolutions: DataFrame, markets: DataFrame, as_of, full: bool = False, min_pairs: int = 3) -> DataFrame:
    """Profiles with risk score, level, type and breakdown."""
    p = profiles.trader_profile(trades, resolutions, markets)
    if full:
        p = p.join(scoring.trade_extremes(trades, markets), "wallet")
    related = graph.related_wallets(trades, 60, min_pairs, scoring.MOST_RELATED)
    return scoring.risk_scores(p, related, as_of, full)


def analyze_traders(
    trades: DataFrame, resolutions: DataFrame, markets: DataFrame, positions: DataFrame, mode: str = "auto", threshold: float = 5.0, max_detailed: int = 50
) -> DataFrame:
    """(wallet, risk_score, level, ...) by mode: fast, detailed, hybrid, or auto (hybrid)."""
    if mode not in ("fast", "detailed", "hybrid", "auto"):
        raise ValueError(f"unknown mode {mode!r}")
    fast = fast_profiles(trades, resolutions, markets, positions)
    if mode == "fast":
        out = scoring.unified_fast(fast).withColumn("risk_score", F.col("fast_score"))
        return out.withColumn("level", scoring.risk_level(F.col("risk_score")))
    p = profiles.trader_profile(trades, resolutions, markets)
    if mode == "detailed":
        out = scoring.unified_detailed(fast, p).withColumn("risk_score", F.col("detailed_score"))
        return out.withColumn("level", scoring.risk_level(F.col("risk_score")))
    return scoring.hybrid_scores(fast, p, threshold, max_detailed)


def find_insiders(trades: DataFrame, resolutions: DataFrame, markets: DataFrame, positions: DataFrame, threshold: float = 5.0, mode: str = "auto") -> DataFrame:
    return analyze_traders(trades, resolutions, markets, positions, mode).where(F.col("risk_score") >= threshold)


def market_anomalies(trades: DataFrame, critical: DataFrame, min_volume_c: int = 50_000_000) -> DataFrame:
    """Statistical and critical-trader alerts after the cooldown."""
    scored = market.anomaly_scores(market.baseline_z(market.window_stats(trades)))
    statistical = market.anomaly_alerts(scored, min_volume_c).select("condition_id", F.col("w").alias("t"), "alert_level")
    own = market.critical_trader_alerts(trades, critical).select("condition_id", F.col("w").alias("t"), F.lit("CRITICAL_TRADER").alias("alert_level"))
    return market.cooldown(statistical.unionByName(own))
