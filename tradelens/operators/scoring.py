"""Rule ladders over profile columns. All are plain column expressions: scoring adds no shuffle."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradelens.functions.scalars import ladder, ladder_below, ladder_upto, profile_type, profile_type_fast, ratio, risk_level
from tradelens.operators.ranks import ranked, value_block

c = F.col
#: The edges and points of every ladder below are those of the scoring rules.
#: The result that scores full marks, on the log scale.
_LOG_MILLION = math.log1p(1_000_000)


def winrate_score(winrate: Column, trades: Column) -> Column:
    steps = [(0.5, -2), (0.55, 0), (0.65, 1), (0.75, 2), (0.85, 3)]
    return F.when(trades < 5, 0.0).otherwise(ladder_below(winrate, steps, 4))


def pnl_score(pnl: Column) -> Column:
    return F.when(pnl <= 0, -1.5).otherwise(F.least(F.lit(4.0), F.log1p(F.greatest(pnl, F.lit(0.0))) / _LOG_MILLION * 4))


def timing_score(late: Column, pre: Column) -> Column:
    return F.least(F.lit(2.5), ladder(late, [(0.5, 2), (0.3, 1.5), (0.15, 1)]) + ladder(pre, [(0.3, 1), (0.15, 0.5)]))


def cross_market_score(markets: Column, share: Column) -> Column:
    return F.least(F.lit(3.0), ladder(markets, [(8, 2.5), (6, 2), (4, 1.5), (2, 1)]) + ladder(share, [(0.3, 1), (0.15, 0.5)]))


def camouflage_score(pnl: Column, winrate: Column, trades: Column) -> Column:
    main = (
        F.when((pnl > 50000) & (winrate < 0.55), 2.0).when((pnl > 25000) & (winrate < 0.5), 1.5)
        .when((pnl > 10000) & (winrate < 0.48), 1.0).otherwise(0.0)
    )
    return F.least(F.lit(3.0), main + F.when((trades < 50) & (pnl > 10000), 1.0).otherwise(0.0))


def category_bonus(score: Column) -> Column:
    return score * 0.3


def freshness_score(first_t: Column, last_t: Column, as_of: Column) -> Column:
    age = (as_of - first_t) / 86400
    known = (F.coalesce(first_t, F.lit(0)) != 0) & (F.coalesce(last_t, F.lit(0)) != 0)
    return F.when(known, ladder_below(age, [(30, 1.5), (90, 1), (180, 0.5)])).otherwise(0.0)


def activity_penalty(trades: Column) -> Column:
    return F.when(trades > 1000, -2.0).when(trades > 500, -1.5).when(trades > 200, -1.0).otherwise(0.0)


def fresh_wallet_score(trades: Column, avg_size: Column) -> Column:
    return (
        F.when((trades < 5) & (avg_size >= 1000), 2.5).when((trades < 10) & (avg_size >= 500), 2.0)
        .when((trades < 20) & (avg_size >= 250), 1.5).when((trades < 50) & (avg_size >= 100), 1.0).otherwise(0.0)
    )


def position_sizing_score(max_size: Column, total: Column) -> Column:
    return ladder(ratio(max_size, total), [(0.6, 2), (0.4, 1.5), (0.25, 1), (0.15, 0.5)])


def early_entry_score(trade_t: Column, created_t: Column) -> Column:
    known = (F.coalesce(trade_t, F.lit(0)) != 0) & (F.coalesce(created_t, F.lit(0)) != 0)
    return F.when(known, ladder_upto((trade_t - created_t) / 3600, [(1, 2), (6, 1.5), (12, 1), (24, 0.5)])).otherwise(0.0)


def off_hours_score(share: Column) -> Column:
    return ladder(share, [(0.5, 1.5), (0.3, 1), (0.15, 0.5)])


def volume_impact_score(size: Column, daily: Column) -> Column:
    return F.when((daily > 0) & (size > 0), ladder(ratio(size, daily), [(0.05, 2), (0.02, 1.5), (0.01, 1)])).otherwise(0.0)


#: Related wallets from which on ``cluster_score`` rises no more.
MOST_RELATED = 5


def cluster_score(related: Column, coordinated: Column) -> Column:
    return F.when((related >= MOST_RELATED) & (coordinated > 0), 2.5).otherwise(ladder(related, [(3, 2), (2, 1.5), (1, 1)]))


def cluster_detector_score(related: Column, coordinated: Column, size: Column) -> Column:
    score = ladder(size, [(5, 1.5), (3, 1), (2, 0.5)]) + ladder(coordinated, [(10, 1), (5, 0.5)])
    return F.when(related == 0, 0.0).otherwise(F.least(F.lit(2.5), score))


def trade_extremes(trades: DataFrame, markets: DataFrame) -> DataFrame:
    """Per wallet the highest early-entry and volume-impact scores of its trades."""
    daily = trades.groupBy("condition_id", F.expr("t div 86400").alias("day")).agg(F.sum("value_c").alias("daily_c"))
    x = trades.withColumn("day", F.expr("t div 86400")).join(daily, ["condition_id", "day"]).join(markets.select("condition_id", "created_t"), "condition_id", "left")
    return x.groupBy("wallet").agg(
        F.max(early_entry_score(c("t"), c("created_t"))).alias("early_entry"), F.max(volume_impact_score(c("value_c"), c("daily_c"))).alias("volume_impact")
    )


COMPONENTS = (
    "winrate", "pnl", "timing", "cross_market", "camouflage", "category", "freshness", "activity",
    "fresh_wallet", "position_sizing", "early_entry", "off_hours", "volume_impact", "cluster",
)


def components(as_of, full: bool = False, legacy: bool = False) -> dict[str, Column]:
    """The fourteen components over profile columns; 11 to 13 count only with ``full``."""
    pnl, zero = c("pnl_c") / 100, F.lit(0.0)
    return {
        "winrate": winrate_score(c("winrate"), c("trades")), "pnl": pnl_score(pnl), "timing": timing_score(c("late_ratio"), c("pre_ratio")),
        "cross_market": cross_market_score(c("unique_markets"), zero if legacy else c("max_market_share")),
        "camouflage": camouflage_score(pnl, c("winrate"), c("trades")), "category": category_bonus(F.lit(1.0) if legacy else c("category_score")),
        "freshness": freshness_score(c("first_t"), c("last_t"), as_of), "activity": activity_penalty(c("trades")),
        "fresh_wallet": fresh_wallet_score(c("trades"), c("avg_value_c") / 100), "position_sizing": position_sizing_score(c("max_value_c"), c("volume_c")),
        "early_entry": c("early_entry") if full else zero, "off_hours": off_hours_score(c("off_hours_ratio")) if full else zero,
        "volume_impact": c("volume_impact") if full else zero, "cluster": cluster_score(c("related"), c("coordinated")),
    }


def risk_scores(profiles: DataFrame, clusters: DataFrame, as_of, full: bool = False, legacy: bool = False) -> DataFrame:
    """Profiles with ``risk_score``, ``level``, ``profile_type`` and the struct ``breakdown``.

    ``clusters(wallet, related, coordinated)``, or ``(wallet, related)`` up to ``MOST_RELATED`` of wallets that have pairs; with ``full`` the
    profiles carry ``early_entry`` and ``volume_impact``.
    """
    upto = "coordinated" not in clusters.columns
    p = profiles.join(clusters.withColumn("coordinated", c("related")) if upto else clusters, "wallet", "left").fillna(0, ["related", "coordinated"])
    p = typed(p, components(as_of, full, legacy))
    total = sum((c(f"breakdown.{n}") for n in COMPONENTS), F.lit(0.0))
    # two digits, halves up in plain arithmetic: the same wherever it is computed
    p = p.withColumn("risk_score", F.floor(F.least(total, F.lit(10.0)) * 100 + (0.5 + 1e-9)) / 100)
    return p.withColumn("level", risk_level(c("risk_score"))).drop(*["related", "coordinated"] * upto)


def typed(p: DataFrame, parts: dict[str, Column]) -> DataFrame:
    """Profiles with the struct ``breakdown`` of ``parts`` and ``profile_type``, on which related wallets have no say."""
    p = p.withColumn("breakdown", F.struct(*[x.alias(n) for n, x in parts.items()]))
    kind = profile_type(c("winrate"), c("breakdown.camouflage"), c("breakdown.cross_market"), c("breakdown.timing"), c("trades"))
    return p.withColumn("profile_type", kind)


def alone(profiles: DataFrame, as_of, full: bool = False) -> DataFrame:
    """``risk_scores`` without what needs related wallets: no ``cluster`` in the breakdown, no ``risk_score`` and no ``level``."""
    parts = components(as_of, full)
    return typed(profiles, {n: x for n, x in parts.items() if n != "cluster"})


def fast_position_score(n: Column, value: Column, volume: Column) -> Column:
    return F.least(2.0 / F.sqrt(F.greatest(n, F.lit(1))), F.lit(2.0)) + F.least(ratio(value, volume) * 3, F.lit(2.0))


def fast_activity_score(markets: Column, rank: Column) -> Column:
    return F.least(
        F.lit(3.0), ladder(markets, [(20, 2), (10, 1.5), (5, 1), (2, 0.5)]) + ladder_upto(F.nullif(rank, F.lit(0)), [(10, 2), (50, 1.5), (200, 1), (1000, 0.5)])
    )


def fast_profiles(wallets: DataFrame, board: DataFrame, traded: DataFrame, positions: DataFrame) -> DataFrame:
    """Leaderboard, markets traded and positions of each wallet; missing parts are null rank and zeros."""
    b = board.where("category = 'OVERALL' and period = 'ALL'").select("wallet", "pnl_c", "vol_c", "rank")
    out = wallets.join(b, "wallet", "left").join(traded, "wallet", "left").join(positions, "wallet", "left")
    return out.select(
        "wallet", F.coalesce("pnl_c", F.lit(0)).alias("pnl_c"), F.coalesce("vol_c", F.lit(0)).alias("vol_c"), "rank",
        F.coalesce("markets_traded", F.lit(0)).alias("markets_traded"), F.coalesce("positions", F.lit(0)).alias("positions"),
        F.coalesce("value_c", F.lit(0)).alias("value_c"),
    )


def fast_risk_scores(fast: DataFrame) -> DataFrame:
    pnl = c("pnl_c") / 100
    score = F.least(
        pnl_score(pnl) + fast_position_score(c("positions"), c("value_c"), c("vol_c")) + fast_activity_score(c("markets_traded"), c("rank")), F.lit(10.0)
    )
    on = c("rank").isNotNull()
    out = fast.withColumn("risk_score", F.when(on, F.round(score, 4)).otherwise(0.0))
    return out.withColumns({
        "level": risk_level(c("risk_score")),
        "profile_type": F.when(on, profile_type_fast(pnl, c("rank"))).otherwise("UNKNOWN"),
    }).select("wallet", "risk_score", "level", "profile_type")


def unified_fast(fast: DataFrame) -> DataFrame:
    pnl = c("pnl_c") / 100
    score = (
        F.when(pnl > 0, F.log1p(F.greatest(pnl, F.lit(0.0))) / _LOG_MILLION * 4).otherwise(0.0)
        + ladder_upto(F.nullif(c("rank"), F.lit(0)), [(10, 2), (50, 1.5), (200, 1)]) + ladder(c("markets_traded"), [(20, 2), (10, 1)])
        + F.when((c("positions") > 0) & (c("vol_c") > 0), F.least(2 / F.sqrt(F.greatest(c("positions"), F.lit(1))), F.lit(2.0))).otherwise(0.0)
    )
    return fast.withColumn("fast_score", F.round(F.least(score, F.lit(10.0)), 4))


def unified_parts(profiles: DataFrame) -> DataFrame:
    part = lambda x, k: F.least(x * k, F.lit(4.0))
    return profiles.select(
        "wallet", part(c("pre_ratio"), 4).alias("timing"), part(c("whale_ratio"), 10).alias("whale"),
        part(c("market_success_rate"), 4).alias("multi_market"), "winrate",
    )


def unified_detailed(fast: DataFrame, profiles: DataFrame) -> DataFrame:
    x = unified_fast(fast).join(unified_parts(profiles), "wallet")
    bonus = F.when(c("winrate") > 0.7, 2.0).when(c("winrate") > 0.6, 1.0).otherwise(0.0)
    return x.withColumn("detailed_score", F.round(F.least(c("fast_score") + c("timing") + c("whale") + c("multi_market") + bonus, F.lit(10.0)), 4))


def hybrid_scores(fast: DataFrame, profiles: DataFrame, threshold: float = 5.0, max_detailed: int = 50) -> DataFrame:
    """Cheap scores for all; the first ``max_detailed`` at or above the threshold get the detailed score."""
    cheap = unified_fast(fast)
    chosen = cheap.where(c("fast_score") >= threshold).orderBy(F.desc("fast_score"), "wallet").limit(max_detailed).select("wallet")
    detail = unified_detailed(fast.join(chosen, "wallet", "left_semi"), profiles.join(chosen, "wallet", "left_semi")).select("wallet", "detailed_score")
    out = cheap.join(detail, "wallet", "left").withColumn("risk_score", F.coalesce("detailed_score", "fast_score"))
    return out.select("wallet", "risk_score", risk_level(c("risk_score")).alias("level"), c("detailed_score").isNotNull().alias("detailed"))


def market_priority(ids: DataFrame, markets: DataFrame, probability: Column, keep: float = 0.7) -> DataFrame:
    """Markets by weighted liquidity, volume and insider probability; the first share of them stays."""
    known = ids.join(markets, "condition_id")
    score = c("liquidity") * 0.5 + c("volume") * 0.3 + probability * 1e5 * 0.2
    scored = known.select("condition_id", F.round(score, 4).alias("priority"))
    n = scored.select(F.greatest(F.floor(F.count("*") * keep), F.lit(1)).cast("int").alias("n"))
    placed = ranked(scored, [], value_block(c("priority")), [F.desc("priority"), c("condition_id")])
    return placed.where(c("place") <= n.scalar())


def summary_table(scored: DataFrame, page: int = 25) -> DataFrame:
    order = F.when(c("level") == "CRITICAL", 0).otherwise(1)
    chosen = scored.where(c("level").isin("HIGH", "CRITICAL"))
    # all blocks of CRITICAL wallets lie above those of HIGH ones
    block = value_block(c("pnl_c")) - order * F.lit(10**6)
    out = ranked(chosen, [], block, [order, F.desc("pnl_c"), c("wallet")])
    return out.select("wallet", "level", "pnl_c", "place", F.expr(f"cast((place - 1) div {page} as bigint)").alias("page"))


def profile_summary(scored: DataFrame) -> DataFrame:
    return scored.groupBy("level").agg(
        F.count("*").alias("wallets"), F.round(F.avg("risk_score"), 6).alias("avg_risk"), F.max("risk_score").alias("max_risk"), F.round(F.avg(c("pnl_c") / 100), 4).alias("avg_pnl")
    )
