"""The registered queries: each operator of the engine bound to its input tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradelens.functions import scalars as s
from tradelens.operators import graph, incremental, joins, market, ml, positions, profiles, scoring
from tradelens.plans import detector
from tradelens.sources import reads
from tradelens.sources.shared import checkpointed, shared_folder
from tradelens.sources.tables import DAY0, Tables

c = F.col
#: Settings for the size of the test tables, whose markets trade thousands and not millions of dollars: floor of
#: anomalies, largest trade of critical wallets, and floor, tiers and ceiling of the older monitor, in cents.
MIN_VOLUME_C, SINGLE_C, V1_C = 1_000_000, 1_000_000, {"min_c": 500_000, "tier2_c": 1_500_000, "tier3_c": 2_500_000, "high_c": 3_000_000}
DAY = 86400


def _wallets(x: Tables) -> DataFrame:
    return x.trades.select("wallet").distinct()


def _elite(x: Tables) -> DataFrame:
    """The head of the leaderboards: the look-up list of the batch reads."""
    return profiles.elite_wallets(x.leaderboard)


def _profile(x: Tables) -> DataFrame:
    return profiles.trader_profile(x.trades, x.resolutions, x.markets)


def _correlations(x: Tables) -> DataFrame:
    return graph.correlations(x.trades, 60, 3)


def _related(x: Tables) -> DataFrame:
    return graph.related_wallets(x.trades, 60, 3, scoring.MOST_RELATED)


def _extremes(x: Tables, full: bool) -> DataFrame:
    """Profiles, with ``full`` and the extremes of the trades."""
    return _profile(x).join(scoring.trade_extremes(x.trades, x.markets), "wallet") if full else _profile(x)


def _scored(x: Tables, full: bool = False) -> DataFrame:
    return scoring.risk_scores(_extremes(x, full), _related(x), x.as_of, full)


def _fast(x: Tables) -> DataFrame:
    return scoring.fast_profiles(_wallets(x), x.leaderboard, profiles.markets_traded(x.trades), profiles.positions_value(x.positions))


def _critical(x: Tables) -> DataFrame:
    """Wallets of the level CRITICAL."""
    return _scored(x).where("level = 'CRITICAL'").select("wallet")


def _stats(x: Tables) -> DataFrame:
    return market.window_stats(x.trades)


def _anomalies(x: Tables) -> DataFrame:
    return market.anomaly_scores(market.baseline_z(_stats(x)))


def _alerts(x: Tables) -> DataFrame:
    """All windows above the floor as alerts, every seventh of them of a critical trader."""
    big = _stats(x).where(c("volume_c") >= MIN_VOLUME_C)
    return big.select("condition_id", c("w").alias("t"), F.expr("case when w div 1800 % 7 = 0 then 'CRITICAL_TRADER' else 'STATISTICAL_ANOMALY' end").alias("alert_level"))


def _jumps(x: Tables) -> DataFrame:
    return market.price_jumps(x.price_history, 0.5)


def _iax(x: Tables) -> DataFrame:
    return profiles.iax_trade_edge(x.trades, x.resolutions, x.quotes)


def _chain(x: Tables) -> DataFrame:
    return graph.funding_chain(graph.first_funding(x.transfers), x.contracts)


def _features(x: Tables) -> DataFrame:
    labels = market.pre_jump_labels(x.trades, _jumps(x), x.markets)
    return ml.features(labels, x.trades, _profile(x), profiles.iax_wallet(_iax(x)), x.markets)


def _ml(x: Tables) -> DataFrame:
    starts = profiles.activity_span(x.trades).select("wallet", "first_t")
    data = checkpointed(ml.time_folds(_features(x), starts))
    return ml.out_of_fold(data)


def _profile_store(x: Tables) -> DataFrame:
    """Profiles stored after the first days, into whose table all later trades are folded."""
    store = incremental.ProfileStore(x.spark, f"{shared_folder(x.spark)}/profiles-{uuid.uuid4().hex}", 16)
    store.fold(x.trades.where(f"t < {DAY0 + 15 * DAY}"), x.resolutions)
    store.fold(x.trades, x.resolutions)
    return incremental.with_rates(store.read().drop("bucket"))


def _stored(x: Tables, days: int = 15) -> DataFrame:
    """Profiles as they were stored after the first days."""
    return incremental.partials(x.trades.where(f"t < {DAY0 + days * DAY}"))


def _tagged(x: Tables) -> DataFrame:
    tags = F.explode(F.array(F.lit("all"), c("category"))).alias("_tag")
    return x.markets.select("condition_id", "active", tags)


def _payouts(x: Tables) -> DataFrame:
    return x.resolutions.select("condition_id", F.expr("array(1 - winner_idx, winner_idx)").alias("payouts"))


def _redemptions(x: Tables) -> DataFrame:
    """Winning open positions, redeemed at the close."""
    won = x.positions.join(x.resolutions, "condition_id").where("outcome_index = winner_idx")
    return won.select("wallet", "condition_id", c("closed_at").alias("t"), "size")


def _level_input(x: Tables) -> DataFrame:
    return _scored(x).select("wallet", "risk_score", "trades", "winrate", "pnl_c", "level", "profile_type")


def _component(name: str, full: bool = False) -> Callable[[Tables], DataFrame]:
    def query(x: Tables) -> DataFrame:
        scored = _scored(x, full) if name == "cluster" else scoring.alone(_extremes(x, full), x.as_of, full)
        return scored.select("wallet", F.round(f"breakdown.{name}", 6).alias("score"))

    return query


def _pick(build: Callable[[Tables], DataFrame], *names: str) -> Callable[[Tables], DataFrame]:
    return lambda x: build(x).select(*names)


_TRADE = ("trade_id", "wallet", "condition_id", "t", "side", "price_c", "outcome_index", "size")


def _trades(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    return _pick(build, *_TRADE)


def _hex(x: Tables) -> DataFrame:
    """Wallets as mixed-case addresses."""
    return _wallets(x).select("wallet", F.concat(F.lit("0xAb"), F.lpad(c("wallet").cast("string"), 8, "C")).alias("address"))


BATCH: dict[str, Callable[[Tables], DataFrame]] = {
    "wallet_risk": lambda x: detector.score_profiles(x.trades, x.resolutions, x.markets, x.as_of).select("wallet", "risk_score", "level"),
    # sources and sinks
    "src_trades": _trades(lambda x: reads.trades_of(x.trades, 3, DAY0 + 86400, DAY0 + 20 * 86400, 1000, 100, 5)),
    "src_full_history": _trades(lambda x: reads.full_history(x.trades, 10_000)),
    "src_histories_batch": _trades(lambda x: reads.histories_batch(x.trades, _elite(x), 500)),
    "src_incremental_trades": _trades(lambda x: reads.incremental_trades(x.trades, _stored(x).select("wallet", "last_t"))),
    "src_large_trades": _trades(lambda x: reads.large_trades(x.trades, 10_000)),
    "src_market_window_trades": _trades(lambda x: reads.market_window(x.trades, 7, DAY0, DAY0 + 9 * 86400)),
    "src_markets": lambda x: reads.markets_by_status(x.markets, closed=True).select("condition_id", "question", "category", "closed"),
    "src_market_info": lambda x: reads.market_info(x.markets),
    "src_resolutions": lambda x: x.resolutions,
    "src_events_by_status": lambda x: reads.markets_by_status(x.markets, active=True).groupBy("category").agg(F.count("*").alias("markets")),
    "src_fills_for_trader": lambda x: reads.fills_of(x.fills, 5, DAY0, DAY0 + 25 * 86400, 200).select("event_id", "t", "maker", "taker"),
    "src_recent_fills": lambda x: reads.recent_fills(x.fills.withColumn("id", F.concat_ws("_", F.expr("event_id % 100"), "event_id")), 50),
    "src_user_positions_batch": lambda x: reads.positions_batch(x.positions, _elite(x), 1000).select("wallet", "condition_id", "outcome_index", "current_value_c"),
    "src_payouts_batch": lambda x: reads.payouts_batch(x.markets.select("condition_id"), _payouts(x)).select("condition_id", F.array_join("payouts", ",").alias("payouts")),
    "src_redemptions": lambda x: reads.redemptions_of(_redemptions(x), 5, 20),
    "src_price_history": lambda x: x.price_history,
    "src_transfers": lambda x: reads.transfers_of(x.transfers, 4).select("transfer_id", "block", "from_wallet", "to_wallet", "value_c", "direction"),
    "src_market_tokens": lambda x: reads.market_tokens(x.markets),
    "collect_markets": lambda x: reads.collect_markets(_tagged(x)).select("condition_id", "_tag"),
    "distinct_traders": lambda x: reads.distinct_traders(x.trades),
    "count_trades": lambda x: x.trades.agg(F.count("*").alias("trades")),
    "collect_histories_antijoin": _pick(lambda x: reads.uncollected_histories(x.trades, _wallets(x), _elite(x), 500), "trade_id", "trader_address", "t"),
    "sink_export": lambda x: reads.json_rows(profiles.volume(x.trades)),
    # scalar functions
    "trade_value": lambda x: x.trades.select("trade_id", s.notional().alias("value_c")),
    "epoch_normalise": lambda x: x.trades.select("trade_id", s.epoch_seconds(F.when(c("trade_id") % 2 == 0, c("t") * 1000).otherwise(c("t"))).alias("t")),
    "address_normalise": lambda x: _hex(x).select("wallet", s.address_key(c("address")).alias("address")),
    "market_risk_category": lambda x: x.markets.select("condition_id", s.risk_category(c("question"), c("group_item_title"), c("category")).alias("score")),
    "market_insider_probability": lambda x: x.markets.select("condition_id", s.insider_probability(c("category")).alias("probability")),
    "market_topic": lambda x: x.markets.select("condition_id", s.topic(F.concat_ws(" ", "slug", "question")).alias("topic")),
    "filter_by_liquidity": lambda x: x.trades.select("condition_id").distinct().join(x.markets, "condition_id", "left").where(F.coalesce("liquidity", F.lit(0)) >= 50_000).select("condition_id", "liquidity"),
    "liquid_events": lambda x: x.markets.where("active and not closed and volume >= 10000").orderBy(F.desc("volume"), "condition_id").limit(10).select("condition_id", "volume"),
    "active_markets": lambda x: x.markets.where("active and not closed and liquidity >= 20000").orderBy(F.desc("liquidity"), "condition_id").limit(10).select("condition_id", "liquidity"),
    "risk_level": lambda x: _scored(x).select("wallet", s.risk_level(c("risk_score")).alias("level")),
    "profile_type": lambda x: scoring.alone(_profile(x), x.as_of).select("wallet", "profile_type"),
    "profile_type_fast": lambda x: x.leaderboard.where("category = 'OVERALL' and period = 'ALL'").select("wallet", s.profile_type_fast(c("pnl_c") / 100, c("rank")).alias("profile_type")),
    "filter_high_risk": lambda x: _scored(x).where("risk_score >= 2").select("wallet", "risk_score"),
    "off_hours_flag": lambda x: x.trades.select("trade_id", s.off_hours(c("t")).alias("off_hours")),
    "short_address": lambda x: _hex(x).select("wallet", s.short_address(c("address")).alias("short")),
    # joins
    "trades_join_resolutions": lambda x: profiles.resolved_trades(x.trades, x.resolutions).select("trade_id", "winner_idx", "win", "secs"),
    "pre_jump_trades": lambda x: market.pre_jump_trades(x.trades, _jumps(x)).select("trade_id", "condition_id", "start_t", "direction", F.round("magnitude", 6).alias("magnitude")),
    "price_lookahead": lambda x: joins.price_lookahead(x.price_history),
    "coordinated_pairs": lambda x: graph.coordinated_pairs(x.trades, 60, 2),
    "profile_leaderboard_join": lambda x: joins.profiles_with_board(profiles.resolved_pnl(x.trades, x.resolutions), x.leaderboard),
    "critical_wallet_semi": lambda x: joins.semi(x.trades, _critical(x)).select("trade_id", "wallet"),
    "new_wallets_anti": lambda x: joins.anti(x.fills.select(c("taker").alias("wallet")).distinct(), _stored(x, 1), "wallet"),
    "hybrid_override_merge": lambda x: joins.merge_override(profiles.volume(x.trades).select("wallet", c("volume_c").alias("amount")), profiles.resolved_pnl(x.trades, x.resolutions).where("pnl_c > 0").select("wallet", c("pnl_c").alias("amount"))),
    "funding_join": lambda x: profiles.volume(x.trades).join(graph.first_funding(x.transfers), "wallet", "left").select("wallet", "trades", "source", "block"),
    "missing_ids_anti": lambda x: joins.anti(x.trades.select("condition_id").distinct(), x.resolutions, "condition_id"),
    # trader aggregates
    "value_weighted_accuracy": lambda x: profiles.value_weighted_accuracy(x.trades, x.resolutions),
    "trader_timing": lambda x: profiles.timing(x.trades, x.resolutions),
    "trader_whales": lambda x: profiles.whales(x.trades, x.resolutions),
    "trader_multi_market": lambda x: profiles.multi_market(x.trades, x.resolutions),
    "trader_cross_market": lambda x: profiles.cross_market(x.trades),
    "trader_category_mix": lambda x: profiles.category_mix(x.trades, x.markets),
    "trader_recent_winrate": lambda x: profiles.recent_winrate(x.trades, x.resolutions),
    "trader_market_share": lambda x: profiles.market_share(x.trades),
    "trader_category_score": lambda x: profiles.category_score(x.trades, x.markets).withColumn("category_score", F.round("category_score", 6)),
    "trader_activity_span": lambda x: profiles.activity_span(x.trades),
    "trader_profile": lambda x: _profile(x).withColumn("category_score", F.round("category_score", 6)),
    "trader_profile_big": lambda x: profiles.whales(x.big_trades, x.resolutions).select("wallet", "volume_c", "whale_trades", "mega_trades"),
    "trader_winrate_resolved": lambda x: profiles.winrate(x.trades, x.resolutions),
    "trader_resolved_pnl": lambda x: profiles.resolved_pnl(x.trades, x.resolutions),
    "trader_volume": lambda x: profiles.volume(x.trades),
    "trader_avg_cost_pnl": lambda x: profiles.avg_cost_pnl(x.trades),
    "qualified_traders": lambda x: profiles.qualified_traders(x.trades, 60, 0.05).select("wallet", "trades", "winrate"),
    "top_roi_traders_per_market": lambda x: profiles.top_roi_per_market(x.trades, 5),
    "scout_performance": lambda x: profiles.scout_performance(x.trades, x.resolutions),
    "trader_positions_value": lambda x: profiles.positions_value(x.positions),
    "markets_traded": lambda x: profiles.markets_traded(x.trades),
    "trader_fill_count": lambda x: profiles.fill_count(x.fills),
    "leaderboard": lambda x: x.leaderboard,
    "elite_wallets": lambda x: profiles.elite_wallets(x.leaderboard),
    "market_holders": lambda x: profiles.market_holders(x.trades),
    "iax_trade_edge": lambda x: _iax(x).select("trade_id", *[F.round(n, 6).alias(n) for n in ("edge", "conviction", "obscurity", "urgency", "te")]),
    "iax_wallet": lambda x: profiles.iax_wallet(_iax(x)),
    # scoring
    **{f"score_{n}": _component(n) for n in ("winrate", "pnl", "timing", "cross_market", "camouflage", "category", "freshness", "fresh_wallet", "position_sizing", "cluster")},
    "score_activity_penalty": _component("activity"),
    "score_early_entry": _component("early_entry", True),
    "score_off_hours": _component("off_hours", True),
    "score_volume_impact": _component("volume_impact", True),
    "score_cluster_detector": lambda x: graph.cluster_sums(x.trades, 60, 3).select("wallet", scoring.cluster_detector_score(c("related"), c("coordinated"), c("size")).alias("score")),
    "risk_score": lambda x: _scored(x).select("wallet", "risk_score", "level", "profile_type"),
    "risk_score_full": lambda x: _scored(x, True).select("wallet", "risk_score", "level"),
    "fast_position_score": lambda x: _fast(x).select("wallet", F.round(scoring.fast_position_score(c("positions"), c("value_c"), c("vol_c")), 6).alias("score")),
    "fast_activity_score": lambda x: _fast(x).select("wallet", scoring.fast_activity_score(c("markets_traded"), c("rank")).alias("score")),
    "fast_risk_score": lambda x: scoring.fast_risk_scores(_fast(x)),
    "unified_fast_risk": lambda x: scoring.unified_fast(_fast(x)).select("wallet", "fast_score"),
    "unified_timing_whale_multi": lambda x: scoring.unified_parts(_profile(x)).drop("winrate"),
    "unified_detailed_risk": lambda x: scoring.unified_detailed(_fast(x), _profile(x)).select("wallet", "detailed_score"),
    "hybrid_scores": lambda x: scoring.hybrid_scores(_fast(x), _profile(x), 4.0, 30),
    "trader_profile_fast": lambda x: _fast(x),
    "market_priority": lambda x: scoring.market_priority(x.trades.select("condition_id").distinct(), x.markets, s.insider_probability(c("category"))),
    "summary_table": lambda x: scoring.summary_table(_level_input(x)),
    "profile_summary": lambda x: scoring.profile_summary(_level_input(x)),
    # graph
    "wallet_correlations": _correlations,
    "wallet_clusters": lambda x: detector.wallet_clusters(x.trades),
    "funding_clusters": lambda x: graph.funding_clusters(_wallets(x), graph.first_funding(x.transfers)),
    "first_funding": lambda x: graph.first_funding(x.transfers, 2_000_000),
    # transfers of $450,000 and more stand for token transfers, the others for native ones
    "first_funding_any": lambda x: graph.first_funding(x.transfers.where("value_c >= 45000000"), 2_000_000, x.transfers.where("value_c < 45000000")),
    "funding_chain": _chain,
    "common_funding_sources": lambda x: graph.common_sources(_chain(x)),
    "address_flow_summary": lambda x: graph.flow_summary(x.transfers, 500_000),
    "just_in_time_funding": lambda x: graph.just_in_time_funding(x.trades, x.resolutions, x.transfers),
    # market microstructure
    "market_window_stats": lambda x: _stats(x).select("condition_id", "w", "volume_c", "buy_c", "sell_c", "traders"),
    "market_hhi": lambda x: _stats(x).select("condition_id", "w", "hhi"),
    "market_gini": lambda x: _stats(x).select("condition_id", "w", "gini"),
    "whale_dominance": lambda x: _stats(x).select("condition_id", "w", "whale_dominance"),
    "trades_per_minute": lambda x: _stats(x).select("condition_id", "w", "trades_per_minute"),
    "market_baseline_z": lambda x: market.baseline_z(_stats(x)).select("condition_id", "w", "points", "volume_z", "trader_z", "velocity_z"),
    "anomaly_score": lambda x: _anomalies(x).select("condition_id", "w", "anomaly_score"),
    "anomaly_alerts": lambda x: market.anomaly_alerts(_anomalies(x), MIN_VOLUME_C).select("condition_id", "w"),
    "anomaly_level": lambda x: _anomalies(x).where("anomaly_score >= 6").select("condition_id", "w", market.anomaly_level(c("anomaly_score"), c("hhi"), c("whale_dominance")).alias("alert_level")),
    "critical_trader_alerts": lambda x: market.critical_trader_alerts(x.trades, _critical(x), SINGLE_C),
    "alert_cooldown": lambda x: market.cooldown(_alerts(x), 5400),
    "top_markets_by_volume": lambda x: market.top_markets(x.trades, x.markets, 10),
    "v1_window_metrics": lambda x: market.v1_metrics(x.trades, V1_C["min_c"], V1_C["high_c"]),
    "v1_alert_level": lambda x: market.v1_alerts(x.trades, _critical(x), **V1_C),
    "hourly_market_baseline": lambda x: market.hourly_baseline(x.trades),
    "hourly_volume_dense": lambda x: market.densified_hours(x.trades),
    "pump_dump_pattern": lambda x: market.pump_dump(x.trades, 2, 0.01, 3600),
    "wash_trading": lambda x: market.wash_trading(x.trades),
    "sybil_sync": lambda x: market.sybil_sync(x.trades, detector.wallet_clusters(x.trades, 60, 3), DAY),
    "price_jump_candidates": lambda x: market.jump_candidates(x.price_history, 0.5).withColumn("magnitude", F.round("magnitude", 6)),
    "price_jumps": lambda x: _jumps(x).withColumn("magnitude", F.round("magnitude", 6)),
    "pre_jump_labels": lambda x: market.pre_jump_labels(x.trades, _jumps(x), x.markets).select("trade_id", "start_t", "direction", "is_pre_jump"),
    "token_quotes": lambda x: market.token_quotes(x.quotes),
    # positions
    "portfolio_summary": lambda x: positions.portfolio_summary(x.positions, 50, 100_000),
    "portfolio_change_alerts": lambda x: positions.portfolio_change_alerts(x.snapshots),
    "top_positions": lambda x: positions.top_positions(x.positions),
    "top_holdings": lambda x: positions.top_holdings(x.positions),
    # incremental
    "stale_profiles": lambda x: incremental.stale_profiles(profiles.activity_span(x.trades), x.as_of, 90_000),
    "stale_profile_stats": lambda x: incremental.stale_stats(profiles.activity_span(x.trades), x.as_of, 90_000),
    "incremental_profile_merge": lambda x: incremental.incremental_merge(_stored(x), x.trades),
    "incremental_profile_store": _profile_store,
    # learning
    "ml_features": _features,
    "ml_train_predict": _ml,
    "categorical_cardinality": lambda x: ml.categorical_columns(x.trades.select("side", "condition_id", "outcome_index").withColumn("market", c("condition_id").cast("string")), 50),
}


def batch_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bound(build: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, folder: build(Tables(spark, folder))

    return {name: bound(build) for name, build in BATCH.items()}
