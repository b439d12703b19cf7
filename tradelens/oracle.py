"""DuckDB SQL equivalent to the registered queries, over the same tables."""

from __future__ import annotations

from tradelens.functions.scalars import INSIDER_PROBABILITY, RISK_CATEGORY, TOPICS

DAY0 = 1704067200


def _cases(cases: list[tuple[tuple[str, ...], object]], text: str, default: object) -> str:
    lit = lambda v: f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE"
    whens = " ".join(f"WHEN {' OR '.join(f"contains({text}, '{w}')" for w in words)} THEN {lit(v)}" for words, v in cases)
    return f"CASE {whens} ELSE {lit(default)} END"


_RISK = _cases([((k,), v) for k, v in RISK_CATEGORY.items()], "lower(concat_ws(' ', question, '', category))", 1.0)
_INSIDER = _cases([((k,), v) for k, v in INSIDER_PROBABILITY.items()], "lower(category)", 0.5)
_TOPIC = _cases([(w, n) for n, w in TOPICS.items()], "lower(slug || ' ' || question)", "other")

#: Input tables, shared by all queries.
BASE = f"""
nw AS (SELECT max(user_id) + 1 AS n FROM events),
trades AS (SELECT *, size * price_c AS value_c FROM (SELECT event_id AS trade_id, user_id AS wallet, condition_id, t,
    CASE WHEN event_type IN ('click', 'purchase', 'view') THEN 'BUY' ELSE 'SELL' END AS side,
    CAST(5 + abs((t // 3600 + condition_id * 13) % 168 - 84) + (event_id * 37) % 5 AS BIGINT) AS price_c,
    CAST((event_id // 3) % 2 AS INT) AS outcome_index, CAST(round(value * 100) AS BIGINT) AS size
  FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS condition_id, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events))),
markets AS (SELECT CAST(p_partkey AS INT) AS condition_id, p_name AS question, '' AS group_item_title,
  CASE p_type WHEN 'PROMO' THEN 'tech' WHEN 'ECONOMY' THEN 'economy' WHEN 'LARGE' THEN 'politics'
    WHEN 'MEDIUM' THEN 'sports' WHEN 'SMALL' THEN 'crypto' ELSE 'other' END AS category, category || '-' || p_partkey AS slug,
  CAST(round(p_retailprice * p_size * 4) AS BIGINT) AS liquidity, CAST(round(p_retailprice * p_size * 4) AS BIGINT) // 2 AS volume,
  p_partkey % 5 = 0 AS active, p_partkey % 5 <> 0 AS closed, CAST(p_size % 2 AS INT) AS winner, p_partkey,
  {DAY0} + ((p_partkey * 7) % 29 + 1) * 86400 AS closed_at, {DAY0} + (p_partkey % 10) * 86400 AS created_t
  FROM part),
resolutions AS (SELECT condition_id, winner AS winner_idx, closed_at FROM markets WHERE closed),
fills AS (SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS t, user_id AS maker, (user_id * 31 + 7) % n AS taker FROM events, nw),
transfers AS (SELECT (o_orderkey * 1103) % 2592000 AS block, (o_orderkey * 7 + 3) % (n // 5) AS from_wallet, o_custkey % n AS to_wallet,
  CAST(round(o_totalprice * 100) AS BIGINT) AS value_c, o_orderkey AS transfer_id, {DAY0} + (o_orderkey * 1103) % 2592000 AS t FROM orders, nw),
price_history AS (SELECT condition_id, t // 3600 * 3600 AS t, arg_max(price_c, trade_id) AS p FROM trades GROUP BY 1, t // 3600 * 3600),
quotes AS (SELECT condition_id, t // 3600 * 3600 AS t, min(price_c) AS bid, max(price_c) AS ask FROM trades GROUP BY 1, t // 3600 * 3600),
as_of AS (SELECT max(t) + 86400 AS now FROM trades),
contracts AS (SELECT DISTINCT wallet FROM trades WHERE wallet % 17 = 0),
resolved AS (SELECT trades.*, winner_idx, closed_at, outcome_index = winner_idx AS win, closed_at - t AS secs,
  CASE WHEN outcome_index = winner_idx THEN size * (100 - price_c) ELSE -value_c END AS gain FROM trades JOIN resolutions USING (condition_id)),
maybe AS (SELECT trades.*, winner_idx, closed_at, outcome_index = winner_idx AS win, closed_at - t AS secs,
  CASE WHEN outcome_index = winner_idx THEN size * (100 - price_c) ELSE -value_c END AS gain FROM trades LEFT JOIN resolutions USING (condition_id))
"""

_LN = "ln(1 + {x}) / ln(1000001.0) * 4"
#: Derived tables, added to a query only where it names them.
PARTS = {
    "recent": """recent AS (SELECT wallet, coalesce(sum((win)::INT) / nullif(count(winner_idx), 0), 0)::DOUBLE AS recent_winrate,
  count(winner_idx) AS recent_resolved FROM (SELECT *, row_number() OVER (PARTITION BY wallet ORDER BY t DESC, trade_id DESC) AS r FROM maybe)
  WHERE r <= 50 GROUP BY 1)""",
    "prof1": f"""prof1 AS (SELECT wallet, condition_id, count(*) AS n, sum(value_c) AS v, max(value_c) AS max_v, min(t) AS t0, max(t) AS t1,
  count(winner_idx) AS resolved, count(*) FILTER (win) AS wins, sum(gain) FILTER (winner_idx IS NOT NULL) AS pnl_c,
  sum(greatest(secs, 0)) FILTER (winner_idx IS NOT NULL) AS secs, count(*) FILTER (secs < 3600) AS pre, count(*) FILTER (secs < 600) AS late,
  count(*) FILTER (value_c >= 500000) AS whales, count(*) FILTER (value_c >= 2500000) AS megas, sum(coalesce(score, 1.0)) AS score, any_value(topic) AS topic,
  min(greatest(secs, 0)) FILTER (winner_idx IS NOT NULL) AS min_s, max(greatest(secs, 0)) FILTER (winner_idx IS NOT NULL) AS max_s,
  count(*) FILTER (value_c >= 500000 AND secs > 0 AND secs < 3600) AS early, count(*) FILTER (value_c >= 500000 AND secs > 0 AND secs < 3600 AND win) AS early_wins,
  count(*) FILTER (dayofweek(to_timestamp(t)) IN (0, 6) OR hour(to_timestamp(t)) >= 22 OR hour(to_timestamp(t)) < 6) AS off
  FROM maybe LEFT JOIN (SELECT condition_id, {_RISK} AS score, {_TOPIC} AS topic FROM markets) USING (condition_id) GROUP BY 1, 2)""",
    "profile": """profile AS (SELECT *, coalesce(wins / nullif(resolved, 0), 0)::DOUBLE AS winrate, volume_c / trades AS avg_value_c,
  coalesce(pre_resolution_whales / nullif(whale_trades, 0), 0)::DOUBLE AS pre_resolution_whale_ratio, coalesce(winning_pre_resolution_whales / nullif(whale_trades, 0), 0)::DOUBLE AS winning_whale_ratio,
  whale_trades / trades AS whale_ratio, coalesce(winning_markets / nullif(resolved_markets, 0), 0)::DOUBLE AS market_success_rate
  FROM (SELECT wallet, sum(n)::BIGINT AS trades, sum(v)::BIGINT AS volume_c, max(max_v) AS max_value_c, min(t0) AS first_t, max(t1) AS last_t,
    count(*) AS unique_markets, count(*) FILTER (wins > 0) AS winning_markets, sum(resolved)::BIGINT AS resolved, sum(wins)::BIGINT AS wins,
    coalesce(sum(pnl_c), 0)::BIGINT AS pnl_c, coalesce(max(v) / nullif(sum(v), 0), 0)::DOUBLE AS max_market_share,
    coalesce(sum(pre) / nullif(sum(resolved), 0), 0)::DOUBLE AS pre_ratio, coalesce(sum(late) / nullif(sum(resolved), 0), 0)::DOUBLE AS late_ratio,
    sum(whales)::BIGINT AS whale_trades, sum(megas)::BIGINT AS mega_trades, sum(score) / sum(n) AS category_score, sum(off) / sum(n) AS off_hours_ratio,
    round(coalesce(sum(secs) / nullif(sum(resolved) * 3600, 0), 0)::DOUBLE, 6) AS avg_hours, count(*) FILTER (resolved > 0) AS resolved_markets,
    min(min_s) / 3600 AS min_hours, max(max_s) / 3600 AS max_hours, sum(early)::BIGINT AS pre_resolution_whales, sum(early_wins)::BIGINT AS winning_pre_resolution_whales,
    count(*) / 5.0::DOUBLE AS diversification,
    """ + ", ".join(f"coalesce(sum(n) FILTER (topic = '{k}'), 0)::BIGINT AS topic_{k}" for k in (*TOPICS, "other")) + """
    FROM prof1 GROUP BY 1) JOIN recent USING (wallet)
    JOIN (SELECT wallet, round(coalesce(stddev_samp(greatest(secs, 0) / 3600) FILTER (winner_idx IS NOT NULL), 0), 6) AS std_hours FROM maybe GROUP BY 1) USING (wallet))""",
    "pairs": """sec AS (SELECT wallet, t, count(*) AS n FROM trades GROUP BY 1, 2),
pairs AS (SELECT a.wallet AS w1, b.wallet AS w2, sum(a.n * b.n)::BIGINT AS pairs FROM sec a JOIN sec b
  ON b.t BETWEEN a.t - 60 AND a.t + 60 AND a.wallet < b.wallet GROUP BY 1, 2)""",
    "related": """ends AS (SELECT w1 AS wallet, pairs FROM pairs WHERE pairs >= 3 UNION ALL SELECT w2, pairs FROM pairs WHERE pairs >= 3),
related AS (SELECT wallet, count(*) AS related, sum(pairs)::BIGINT AS coordinated FROM ends GROUP BY 1)""",
    "extremes": f"""daily AS (SELECT condition_id, t // 86400 AS day, sum(value_c) AS day_c FROM trades GROUP BY 1, t // 86400),
extremes AS (SELECT wallet,
  max(CASE WHEN (t - created_t) / 3600 <= 1 THEN 2 WHEN (t - created_t) / 3600 <= 6 THEN 1.5 WHEN (t - created_t) / 3600 <= 12 THEN 1
    WHEN (t - created_t) / 3600 <= 24 THEN 0.5 ELSE 0 END)::DOUBLE AS early_entry,
  max(CASE WHEN value_c <= 0 THEN 0 WHEN value_c / day_c >= 0.05 THEN 2 WHEN value_c / day_c >= 0.02 THEN 1.5 WHEN value_c / day_c >= 0.01 THEN 1 ELSE 0 END)::DOUBLE AS volume_impact
  FROM trades JOIN daily ON daily.condition_id = trades.condition_id AND day = t // 86400
  LEFT JOIN (SELECT condition_id AS cid, created_t FROM markets) ON cid = trades.condition_id GROUP BY 1)""",
    "parts": f"""parts AS (SELECT p.*, coalesce(related, 0) AS related, coalesce(coordinated, 0) AS coordinated, early_entry AS s_early_entry, volume_impact AS s_volume_impact,
  CASE WHEN trades < 5 THEN 0 WHEN winrate < 0.5 THEN -2 WHEN winrate < 0.55 THEN 0 WHEN winrate < 0.65 THEN 1 WHEN winrate < 0.75 THEN 2 WHEN winrate < 0.85 THEN 3 ELSE 4 END::DOUBLE AS s_winrate,
  CASE WHEN pnl_c <= 0 THEN -1.5 ELSE least(4.0, {_LN.format(x="greatest(pnl_c, 0) / 100")}) END::DOUBLE AS s_pnl,
  least(2.5, CASE WHEN late_ratio >= 0.5 THEN 2 WHEN late_ratio >= 0.3 THEN 1.5 WHEN late_ratio >= 0.15 THEN 1 ELSE 0 END
    + CASE WHEN pre_ratio >= 0.3 THEN 1 WHEN pre_ratio >= 0.15 THEN 0.5 ELSE 0 END)::DOUBLE AS s_timing,
  least(3.0, CASE WHEN unique_markets >= 8 THEN 2.5 WHEN unique_markets >= 6 THEN 2 WHEN unique_markets >= 4 THEN 1.5 WHEN unique_markets >= 2 THEN 1 ELSE 0 END
    + CASE WHEN max_market_share >= 0.3 THEN 1 WHEN max_market_share >= 0.15 THEN 0.5 ELSE 0 END)::DOUBLE AS s_cross_market,
  least(3.0, CASE WHEN pnl_c > 5000000 AND winrate < 0.55 THEN 2 WHEN pnl_c > 2500000 AND winrate < 0.5 THEN 1.5 WHEN pnl_c > 1000000 AND winrate < 0.48 THEN 1 ELSE 0 END
    + CASE WHEN trades < 50 AND pnl_c > 1000000 THEN 1 ELSE 0 END)::DOUBLE AS s_camouflage,
  category_score * 0.3::DOUBLE AS s_category,
  CASE WHEN (now - first_t) / 86400 < 30 THEN 1.5 WHEN (now - first_t) / 86400 < 90 THEN 1 WHEN (now - first_t) / 86400 < 180 THEN 0.5 ELSE 0 END::DOUBLE AS s_freshness,
  CASE WHEN trades > 1000 THEN -2 WHEN trades > 500 THEN -1.5 WHEN trades > 200 THEN -1 ELSE 0 END::DOUBLE AS s_activity,
  CASE WHEN trades < 5 AND avg_value_c >= 100000 THEN 2.5 WHEN trades < 10 AND avg_value_c >= 50000 THEN 2 WHEN trades < 20 AND avg_value_c >= 25000 THEN 1.5
    WHEN trades < 50 AND avg_value_c >= 10000 THEN 1 ELSE 0 END::DOUBLE AS s_fresh_wallet,
  CASE WHEN max_value_c / volume_c >= 0.6 THEN 2 WHEN max_value_c / volume_c >= 0.4 THEN 1.5 WHEN max_value_c / volume_c >= 0.25 THEN 1 WHEN max_value_c / volume_c >= 0.15 THEN 0.5 ELSE 0 END::DOUBLE AS s_position_sizing,
  CASE WHEN off_hours_ratio >= 0.5 THEN 1.5 WHEN off_hours_ratio >= 0.3 THEN 1 WHEN off_hours_ratio >= 0.15 THEN 0.5 ELSE 0 END::DOUBLE AS s_off_hours,
  CASE WHEN coalesce(related, 0) >= 5 AND coordinated > 0 THEN 2.5 WHEN coalesce(related, 0) >= 3 THEN 2 WHEN coalesce(related, 0) >= 2 THEN 1.5 WHEN coalesce(related, 0) >= 1 THEN 1 ELSE 0 END::DOUBLE AS s_cluster
  FROM profile p CROSS JOIN as_of LEFT JOIN related USING (wallet) LEFT JOIN extremes USING (wallet))""",
    "scored": """total AS (SELECT *, s_winrate + s_pnl + s_timing + s_cross_market + s_camouflage + s_category + s_freshness + s_activity + s_fresh_wallet + s_position_sizing + s_cluster AS part,
  s_winrate + s_pnl + s_timing + s_cross_market + s_camouflage + s_category + s_freshness + s_activity + s_fresh_wallet + s_position_sizing
    + s_early_entry + s_off_hours + s_volume_impact + s_cluster AS more FROM parts),
scored AS (SELECT *, floor(least(part, 10.0) * 100 + (0.5 + 1e-9)) / 100 AS risk_score, floor(least(more, 10.0) * 100 + (0.5 + 1e-9)) / 100 AS risk_full,
  CASE WHEN winrate < 0.5 THEN 'LOSER' WHEN s_camouflage >= 2 THEN 'CAMOUFLAGED_INSIDER' WHEN s_cross_market >= 2 AND s_timing >= 1.5 THEN 'INSIDER'
    WHEN trades >= 200 AND winrate >= 0.55 THEN 'PRO' ELSE 'CASUAL' END AS profile_type FROM total)""",
    "critical": "critical AS (SELECT wallet FROM scored WHERE risk_score >= 8)",
    "board": f"""board0 AS (SELECT wallet, gain, value_c, t > (SELECT max(t) - 15 * 86400 FROM trades) - 1 AS new, upper(topic) AS topic
  FROM resolved JOIN (SELECT condition_id, {_TOPIC} AS topic FROM markets) USING (condition_id)),
board1 AS (SELECT wallet, gain, value_c, new, unnest([topic, 'OVERALL']) AS category FROM board0),
board2 AS (SELECT wallet, gain, value_c, category, unnest(CASE WHEN new THEN ['ALL', 'MONTH'] ELSE ['ALL'] END) AS period FROM board1),
board AS (SELECT *, rank() OVER (PARTITION BY category, period ORDER BY pnl_c DESC)::INT AS rank FROM (
  SELECT wallet, category, period, sum(gain)::BIGINT AS pnl_c, sum(value_c)::BIGINT AS vol_c FROM board2 GROUP BY ALL))""",
    "elite": "elite AS (SELECT DISTINCT wallet FROM board WHERE category IN ('OVERALL', 'POLITICS', 'CRYPTO') AND rank <= 20)",
    "positions": """positions AS (SELECT wallet, condition_id, outcome_index, size, paid_c / bought AS avg_price_c, cur_price_c, size * cur_price_c AS current_value_c,
  round(size * (cur_price_c - paid_c / bought), 2) AS total_pnl_c FROM (
  SELECT wallet, condition_id, outcome_index, sum(CASE side WHEN 'BUY' THEN size ELSE -size END)::BIGINT AS size,
    sum(CASE side WHEN 'BUY' THEN size ELSE 0 END)::BIGINT AS bought, sum(CASE side WHEN 'BUY' THEN value_c ELSE 0 END)::BIGINT AS paid_c FROM trades GROUP BY 1, 2, 3)
  JOIN (SELECT condition_id, arg_max(p, t) AS cur_price_c FROM price_history GROUP BY 1) USING (condition_id) WHERE size > 0)""",
    "fast": """fast AS (SELECT wallet, coalesce(pnl_c, 0) AS pnl_c, coalesce(vol_c, 0) AS vol_c, rank, markets_traded, coalesce(positions, 0) AS positions, coalesce(value_c, 0) AS value_c
  FROM (SELECT wallet, count(DISTINCT condition_id) AS markets_traded FROM trades GROUP BY 1)
  LEFT JOIN (SELECT * FROM board WHERE category = 'OVERALL' AND period = 'ALL') USING (wallet)
  LEFT JOIN (SELECT wallet, count(*) AS positions, sum(current_value_c)::BIGINT AS value_c FROM positions GROUP BY 1) USING (wallet))""",
    "unified": f"""fasts AS (SELECT *, least(2.0 / sqrt(greatest(positions, 1)), 2.0) + least(coalesce(value_c / nullif(vol_c, 0), 0) * 3, 2.0) AS position_score,
  least(3.0, CASE WHEN markets_traded >= 20 THEN 2 WHEN markets_traded >= 10 THEN 1.5 WHEN markets_traded >= 5 THEN 1 WHEN markets_traded >= 2 THEN 0.5 ELSE 0 END
    + CASE WHEN rank <= 10 THEN 2 WHEN rank <= 50 THEN 1.5 WHEN rank <= 200 THEN 1 WHEN rank <= 1000 THEN 0.5 ELSE 0 END)::DOUBLE AS activity_score,
  round(least(10.0, CASE WHEN pnl_c > 0 THEN {_LN.format(x="greatest(pnl_c, 0) / 100")} ELSE 0 END
    + CASE WHEN rank <= 10 THEN 2 WHEN rank <= 50 THEN 1.5 WHEN rank <= 200 THEN 1 ELSE 0 END + CASE WHEN markets_traded >= 20 THEN 2 WHEN markets_traded >= 10 THEN 1 ELSE 0 END
    + CASE WHEN positions > 0 AND vol_c > 0 THEN least(2.0 / sqrt(greatest(positions, 1)), 2.0) ELSE 0 END), 4)::DOUBLE AS fast_score FROM fast),
unified AS (SELECT fasts.*, least(4 * pre_ratio, 4.0) AS timing, least(10 * whale_ratio, 4.0) AS whale, least(4 * market_success_rate, 4.0) AS multi_market,
  round(least(10.0, fast_score + least(4 * pre_ratio, 4.0) + least(10 * whale_ratio, 4.0) + least(4 * market_success_rate, 4.0)
    + CASE WHEN winrate > 0.7 THEN 2 WHEN winrate > 0.6 THEN 1 ELSE 0 END), 4)::DOUBLE AS detailed_score FROM fasts JOIN profile USING (wallet))""",
    "cost": """numbered AS (SELECT wallet, condition_id, side, size, price_c, value_c, row_number() OVER (PARTITION BY wallet, condition_id ORDER BY t, trade_id) AS k FROM trades),
walk AS (SELECT wallet, condition_id, 0::BIGINT AS k, 0::DOUBLE AS qty, 0::DOUBLE AS inv, 0::DOUBLE AS av, 0::DOUBLE AS profit, 0::BIGINT AS wins FROM numbered WHERE k = 1
  UNION ALL SELECT w.wallet, w.condition_id, n.k,
    CASE n.side WHEN 'BUY' THEN w.qty + n.size ELSE w.qty - least(n.size::DOUBLE, w.qty) END,
    CASE n.side WHEN 'BUY' THEN w.inv + n.size * (n.price_c / 100) ELSE w.inv - least(n.size::DOUBLE, w.qty) * w.av END,
    CASE n.side WHEN 'BUY' THEN coalesce((w.inv + n.size * (n.price_c / 100)) / nullif(w.qty + n.size, 0), 0) WHEN 'SELL' THEN CASE WHEN w.qty - least(n.size::DOUBLE, w.qty) > 0 THEN w.av ELSE 0 END END,
    CASE WHEN n.side = 'SELL' AND w.qty > 0 THEN w.profit + (n.price_c / 100 - w.av) * n.size ELSE w.profit END,
    CASE WHEN n.side = 'SELL' AND w.qty > 0 AND (n.price_c / 100 - w.av) * n.size > 0 THEN w.wins + 1 ELSE w.wins END
  FROM walk w JOIN numbered n ON n.wallet = w.wallet AND n.condition_id = w.condition_id AND n.k = w.k + 1),
cost AS (SELECT walk.wallet, walk.condition_id, s.n, s.volume_c, profit, wins FROM walk JOIN (
  SELECT wallet, condition_id, count(*) AS n, sum(value_c)::BIGINT AS volume_c FROM trades GROUP BY 1, 2) s ON s.wallet = walk.wallet AND s.condition_id = walk.condition_id AND s.n = walk.k)""",
    "edges": """edges AS (SELECT trade_id, r.wallet, win::INT - price_c / 100 AS edge, value_c / bank AS conviction, -ln(price_c / 100) AS obscurity,
  1 + abs(price_c - (bid + ask) / 2) / ((bid + ask) / 2) AS urgency FROM resolved r JOIN (SELECT wallet, sum(value_c) AS bank FROM trades GROUP BY 1) b ON b.wallet = r.wallet
  JOIN quotes q ON q.condition_id = r.condition_id AND q.t = r.t // 3600 * 3600)""",
    "iax": """iax AS (SELECT wallet, round(sum(edge * conviction * obscurity * urgency) / sqrt(count(*)), 6) AS iax_score, round(sum(edge), 6) AS total_edge,
  round(avg(conviction), 6) AS avg_conviction, round(avg(obscurity), 6) AS avg_obscurity, round(avg(urgency), 6) AS avg_urgency FROM edges GROUP BY 1)""",
    "stats": """ww AS (SELECT condition_id, t // 1800 * 1800 AS w, wallet, sum(value_c)::BIGINT AS v, sum(CASE side WHEN 'BUY' THEN value_c ELSE 0 END)::BIGINT AS buy, count(*) AS n, max(value_c) AS max_v
  FROM trades GROUP BY 1, t // 1800 * 1800, 3),
wr AS (SELECT *, row_number() OVER (PARTITION BY condition_id, w ORDER BY v, wallet) AS up, row_number() OVER (PARTITION BY condition_id, w ORDER BY v DESC, wallet) AS down FROM ww),
stats AS (SELECT condition_id, w, sum(v)::BIGINT AS volume_c, sum(buy)::BIGINT AS buy_c, (sum(v) - sum(buy))::BIGINT AS sell_c, count(*) AS traders, sum(n)::BIGINT AS trades,
  round(sum(v::DOUBLE * v) / (sum(v)::DOUBLE * sum(v)), 6) AS hhi, round(2.0 * sum(up * v)::DOUBLE / (count(*) * sum(v)) - (count(*) + 1) / count(*), 6) AS gini,
  (sum(v) FILTER (down <= 3))::DOUBLE / sum(v)::DOUBLE AS whale_dominance, sum(n)::DOUBLE / 30 AS trades_per_minute FROM wr GROUP BY 1, 2)""",
    # one row for every hour of a market; an hour's point is its last half hour, zero without trades
    "zs": """span AS (SELECT condition_id, unnest(range(min(w) // 3600 * 3600, max(w) // 3600 * 3600 + 1, 3600)) AS h FROM stats GROUP BY 1),
dense AS (SELECT span.condition_id, h, coalesce(volume_c, 0)::HUGEINT AS v, coalesce(traders, 0)::HUGEINT AS u, coalesce(trades, 0)::HUGEINT AS n
  FROM span LEFT JOIN stats ON stats.condition_id = span.condition_id AND stats.w = h + 1800),
base AS (SELECT condition_id, h, count(*) OVER f AS k, sum(v) OVER f AS v1, sum(v * v) OVER f AS v2, sum(u) OVER f AS u1, sum(u * u) OVER f AS u2, sum(n) OVER f AS n1, sum(n * n) OVER f AS n2
  FROM dense WINDOW f AS (PARTITION BY condition_id ORDER BY h ROWS BETWEEN 168 PRECEDING AND 1 PRECEDING)),
zs AS (SELECT stats.*, k AS points,
  round(CASE WHEN k >= 24 AND k * v2 - v1 * v1 > 0 THEN (k * volume_c - v1)::DOUBLE / sqrt((k * v2 - v1 * v1)::DOUBLE) ELSE 0 END, 6) AS volume_z,
  round(CASE WHEN k >= 24 AND k * u2 - u1 * u1 > 0 THEN (k * traders - u1)::DOUBLE / sqrt((k * u2 - u1 * u1)::DOUBLE) ELSE 0 END, 6) AS trader_z,
  round(CASE WHEN k >= 24 AND k * n2 - n1 * n1 > 0 THEN (k * trades - n1)::DOUBLE / sqrt((k * n2 - n1 * n1)::DOUBLE) ELSE 0 END, 6) AS velocity_z
  FROM stats JOIN base ON base.condition_id = stats.condition_id AND base.h = stats.w // 3600 * 3600)""",
    "anom": """anom AS (SELECT *, floor(10000 * (least(abs(volume_z) / 3.0, 1.0) * 3.0 + hhi / 0.25 * 2.5 + least(abs(velocity_z) / 3.0, 1.0) * 2.0 + whale_dominance / 0.5 * 1.5
  + (greatest(buy_c, sell_c) / volume_c - 0.5) / 0.5) + (0.5 + 1e-6)) / 10000 AS anomaly_score FROM zs)""",
    "v1m": """five AS (SELECT condition_id, t // 3600 * 3600 AS w, t // 300 AS five, count(DISTINCT wallet) AS together FROM trades GROUP BY 1, t // 3600 * 3600, t // 300),
v1m AS (SELECT a.condition_id, a.w, volume_c, greatest(buy_c, volume_c - buy_c) / volume_c AS same_side, traders, max_concurrent, greatest(500000, least(3000000, day_c // 50))::BIGINT AS threshold_c
  FROM (SELECT *, sum(volume_c) OVER (PARTITION BY condition_id ORDER BY w RANGE BETWEEN 82800 PRECEDING AND CURRENT ROW) AS day_c FROM (SELECT condition_id, t // 3600 * 3600 AS w, sum(value_c)::BIGINT AS volume_c, sum(CASE side WHEN 'BUY' THEN value_c ELSE 0 END)::BIGINT AS buy_c, count(DISTINCT wallet) AS traders FROM trades GROUP BY 1, t // 3600 * 3600)) a
  JOIN (SELECT condition_id, w, max(together) AS max_concurrent FROM five GROUP BY 1, 2) b ON a.condition_id = b.condition_id AND a.w = b.w)""",
    "cand": """look AS (SELECT condition_id, t, p, max(p) OVER f AS hi, min(p) OVER f AS lo, arg_max(t, p::BIGINT * 10000000000 - t) OVER f AS hi_t, arg_min(t, p::BIGINT * 10000000000 + t) OVER f AS lo_t
  FROM price_history WHERE p > 0 WINDOW f AS (PARTITION BY condition_id ORDER BY t RANGE BETWEEN 1 FOLLOWING AND 86400 FOLLOWING)),
cand AS (SELECT condition_id, t AS start_t, CASE WHEN (hi - p) / p >= 0.5 THEN hi_t ELSE lo_t END AS end_t, CASE WHEN (hi - p) / p >= 0.5 THEN 'up' ELSE 'down' END AS direction,
  CASE WHEN (hi - p) / p >= 0.5 THEN (hi - p) / p ELSE (p - lo) / p END AS magnitude FROM look WHERE (hi - p) / p >= 0.5 OR (p - lo) / p >= 0.5)""",
    "jumps": """ordered AS (SELECT *, row_number() OVER (PARTITION BY condition_id ORDER BY magnitude DESC, start_t, end_t) AS k FROM cand),
greedy AS (SELECT condition_id, 0::BIGINT AS k, []::BIGINT[] AS kept, false AS took FROM (SELECT DISTINCT condition_id FROM cand)
  UNION ALL SELECT g.condition_id, o.k, CASE WHEN len(list_filter(g.kept, lambda s: abs(s - o.start_t) < 86400)) = 0 THEN list_append(g.kept, o.start_t) ELSE g.kept END,
    len(list_filter(g.kept, lambda s: abs(s - o.start_t) < 86400)) = 0 FROM greedy g JOIN ordered o ON o.condition_id = g.condition_id AND o.k = g.k + 1),
jumps AS (SELECT o.* EXCLUDE (k) FROM ordered o JOIN greedy g ON g.condition_id = o.condition_id AND g.k = o.k AND g.took)""",
    "prejump": """prejump AS (SELECT trades.*, start_t, direction, magnitude FROM trades JOIN jumps ON jumps.condition_id = trades.condition_id AND t BETWEEN start_t - 172800 AND start_t)""",
    "labels": """labels AS (SELECT *, CASE WHEN side = 'BUY' AND outcome_index = CASE direction WHEN 'up' THEN 0 ELSE 1 END THEN 1 ELSE 0 END AS is_pre_jump FROM prejump)""",
    "comp": """links AS (SELECT w1 AS a, w2 AS b FROM pairs WHERE pairs >= 3 UNION SELECT w2, w1 FROM pairs WHERE pairs >= 3),
reach AS (SELECT DISTINCT a, a AS b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
comp AS (SELECT wallet, cluster_id, count(*) OVER (PARTITION BY cluster_id) AS size FROM (SELECT a AS wallet, min(b) AS cluster_id FROM reach GROUP BY 1))""",
    "first_f": """first_f AS (SELECT wallet, from_wallet AS source, block, value_c, t AS funded_t FROM (SELECT *, to_wallet AS wallet,
  row_number() OVER (PARTITION BY to_wallet ORDER BY block, transfer_id) AS r FROM transfers) WHERE r = 1)""",
    "chain": """hops AS (SELECT wallet, [wallet] AS seen, 1 AS hop, source, source IN (SELECT wallet FROM contracts) OR source = wallet AS ended FROM first_f
  UNION ALL SELECT h.wallet, list_append(h.seen, h.source), h.hop + 1, f.source, f.source IN (SELECT wallet FROM contracts) OR list_contains(list_append(h.seen, h.source), f.source)
  FROM hops h JOIN first_f f ON f.wallet = h.source WHERE NOT h.ended AND h.hop < 3),
chain AS (SELECT wallet, hop, source FROM hops)""",
    "alerts": """alerts AS (SELECT condition_id, w AS t, CASE WHEN w // 1800 % 7 = 0 THEN 'CRITICAL_TRADER' ELSE 'STATISTICAL_ANOMALY' END AS alert_level FROM stats WHERE volume_c >= 1000000)""",
    "cool": """alertn AS (SELECT *, row_number() OVER (PARTITION BY condition_id ORDER BY t, alert_level) AS k FROM alerts),
coolw AS (SELECT condition_id, 0::BIGINT AS k, NULL::BIGINT AS last, NULL::BIGINT AS t, NULL::VARCHAR AS alert_level, false AS took FROM (SELECT DISTINCT condition_id FROM alerts)
  UNION ALL SELECT c.condition_id, a.k, CASE WHEN a.alert_level = 'CRITICAL_TRADER' OR c.last IS NULL OR a.t - c.last >= 5400 THEN a.t ELSE c.last END, a.t, a.alert_level,
    a.alert_level = 'CRITICAL_TRADER' OR c.last IS NULL OR a.t - c.last >= 5400 FROM coolw c JOIN alertn a ON a.condition_id = c.condition_id AND a.k = c.k + 1),
cool AS (SELECT condition_id, t, alert_level FROM coolw WHERE took)""",
    "snaps": """snaps AS (SELECT wallet, day, (sum(d) OVER (PARTITION BY wallet ORDER BY day))::BIGINT AS pnl_c FROM (
  SELECT wallet, t // 86400 AS day, sum(CASE side WHEN 'SELL' THEN value_c ELSE -value_c END) AS d FROM trades GROUP BY 1, t // 86400))""",
}

_T = "trade_id, wallet, condition_id, t, side, price_c, outcome_index, size"
_LEVEL = "CASE WHEN {x} >= 8 THEN 'CRITICAL' WHEN {x} >= 5 THEN 'HIGH' WHEN {x} >= 2 THEN 'MEDIUM' ELSE 'LOW' END"
_BY_PNL = "PARTITION BY wallet ORDER BY total_pnl_c DESC, condition_id, outcome_index"
_STORED = f"(SELECT wallet, max(t) AS mark FROM trades WHERE t < {DAY0 + 15 * 86400} GROUP BY 1)"

SQL: dict[str, str] = {
    "wallet_risk": f"SELECT wallet, risk_score, {_LEVEL.format(x='risk_score')} AS level FROM scored",
    "src_trades": f"SELECT {_T} FROM trades WHERE wallet = 3 AND t >= {DAY0 + 86400} AND t <= {DAY0 + 20 * 86400} AND size >= 1000 ORDER BY t DESC, trade_id DESC LIMIT 100 OFFSET 5",
    "src_full_history": f"SELECT {_T} FROM trades QUALIFY row_number() OVER (PARTITION BY wallet ORDER BY t DESC, trade_id DESC) <= 10000",
    "src_histories_batch": f"SELECT {_T} FROM trades WHERE wallet IN (SELECT wallet FROM elite) QUALIFY row_number() OVER (PARTITION BY wallet ORDER BY t DESC, trade_id DESC) <= 500",
    "src_incremental_trades": f"SELECT {_T} FROM trades LEFT JOIN {_STORED} USING (wallet) WHERE mark IS NULL OR t > mark",
    "src_large_trades": f"SELECT {_T} FROM trades WHERE size >= 10000",
    "src_market_window_trades": f"SELECT {_T} FROM trades WHERE condition_id = 7 AND t BETWEEN {DAY0} AND {DAY0 + 9 * 86400}",
    "src_markets": "SELECT condition_id, question, category, closed FROM markets WHERE closed",
    "src_market_info": "SELECT condition_id, question, group_item_title, category, CASE WHEN condition_id % 2 = 0 THEN 'Resolves on ' || question ELSE '' END AS description, slug, volume::DOUBLE AS volume, liquidity::DOUBLE AS liquidity, active, closed FROM markets",
    "src_resolutions": "SELECT * FROM resolutions",
    "src_events_by_status": "SELECT category, count(*) AS markets FROM markets WHERE active GROUP BY 1",
    "src_fills_for_trader": f"SELECT * FROM (SELECT * FROM fills WHERE maker = 5 UNION ALL SELECT * FROM fills WHERE taker = 5) WHERE t BETWEEN {DAY0} AND {DAY0 + 25 * 86400} ORDER BY t DESC, event_id DESC LIMIT 200",
    "src_recent_fills": "SELECT (event_id % 100)::VARCHAR AS condition_key, maker AS wallet, t, '0.5' AS price, 'BUY' AS side, event_id FROM fills ORDER BY t DESC, event_id DESC LIMIT 50",
    "src_user_positions_batch": "SELECT wallet, condition_id, outcome_index, current_value_c FROM positions WHERE wallet IN (SELECT wallet FROM elite) QUALIFY row_number() OVER (PARTITION BY wallet ORDER BY current_value_c DESC, condition_id, outcome_index) <= 1000",
    "src_payouts_batch": "SELECT condition_id, CASE winner_idx WHEN 0 THEN '1,0' WHEN 1 THEN '0,1' END AS payouts FROM markets LEFT JOIN resolutions USING (condition_id)",
    "src_redemptions": "SELECT wallet, condition_id, r.closed_at AS t, size FROM positions JOIN resolutions r USING (condition_id) WHERE outcome_index = winner_idx AND wallet = 5 ORDER BY t DESC, condition_id LIMIT 20",
    "src_price_history": "SELECT * FROM price_history",
    "src_transfers": "SELECT transfer_id, block, from_wallet, to_wallet, value_c, 'in' AS direction FROM transfers WHERE to_wallet = 4 UNION ALL SELECT transfer_id, block, from_wallet, to_wallet, value_c, 'out' FROM transfers WHERE from_wallet = 4",
    "src_market_tokens": "SELECT condition_id, unnest([0, 1]) AS outcome_index, (p_partkey * 2 + unnest([0, 1]))::VARCHAR AS token_id FROM markets",
    "collect_markets": "SELECT condition_id, unnest(['all', category]) AS _tag FROM markets WHERE active",
    "distinct_traders": "SELECT DISTINCT wallet FROM trades",
    "count_trades": "SELECT count(*) AS trades FROM trades",
    "collect_histories_antijoin": "SELECT trade_id, wallet AS trader_address, t FROM trades WHERE wallet NOT IN (SELECT wallet FROM elite) QUALIFY row_number() OVER (PARTITION BY wallet ORDER BY t DESC, trade_id DESC) <= 500",
    "trade_value": "SELECT trade_id, value_c FROM trades",
    "epoch_normalise": "SELECT trade_id, t FROM trades",
    "address_normalise": "SELECT DISTINCT wallet, '0xab' || lpad(wallet::VARCHAR, 8, 'c') AS address FROM trades",
    "market_risk_category": f"SELECT condition_id, {_RISK} AS score FROM markets",
    "market_insider_probability": f"SELECT condition_id, {_INSIDER} AS probability FROM markets",
    "market_topic": f"SELECT condition_id, {_TOPIC} AS topic FROM markets",
    "filter_by_liquidity": "SELECT condition_id, liquidity FROM markets WHERE liquidity >= 50000 AND condition_id IN (SELECT condition_id FROM trades)",
    "liquid_events": "SELECT condition_id, volume FROM markets WHERE active AND NOT closed AND volume >= 10000 ORDER BY volume DESC, condition_id LIMIT 10",
    "active_markets": "SELECT condition_id, liquidity FROM markets WHERE active AND NOT closed AND liquidity >= 20000 ORDER BY liquidity DESC, condition_id LIMIT 10",
    "risk_level": f"SELECT wallet, {_LEVEL.format(x='risk_score')} AS level FROM scored",
    "profile_type": "SELECT wallet, profile_type FROM scored",
    "profile_type_fast": "SELECT wallet, CASE WHEN pnl_c > 5000000 AND rank <= 100 THEN 'INSIDER' WHEN pnl_c > 2500000 THEN 'PRO' WHEN pnl_c < 0 THEN 'LOSER' ELSE 'CASUAL' END AS profile_type FROM board WHERE category = 'OVERALL' AND period = 'ALL'",
    "filter_high_risk": "SELECT wallet, risk_score FROM scored WHERE risk_score >= 2",
    "off_hours_flag": "SELECT trade_id, dayofweek(to_timestamp(t)) IN (0, 6) OR hour(to_timestamp(t)) >= 22 OR hour(to_timestamp(t)) < 6 AS off_hours FROM trades",
    "short_address": "SELECT DISTINCT wallet, '0xAb' || left(lpad(wallet::VARCHAR, 8, 'C'), 2) || '...' || right(lpad(wallet::VARCHAR, 8, 'C'), 4) AS short FROM trades",
    "trades_join_resolutions": "SELECT trade_id, winner_idx, win, secs FROM resolved",
    "pre_jump_trades": "SELECT trade_id, condition_id, start_t, direction, round(magnitude, 6) AS magnitude FROM prejump",
    "price_lookahead": "SELECT condition_id, t, p, max(p) OVER f AS next_max, min(p) OVER f AS next_min, count(*) OVER f AS points FROM price_history WINDOW f AS (PARTITION BY condition_id ORDER BY t RANGE BETWEEN 1 FOLLOWING AND 86400 FOLLOWING)",
    "coordinated_pairs": "SELECT * FROM pairs WHERE pairs >= 2",
    "profile_leaderboard_join": "SELECT wallet, coalesce(b.pnl_c, p.pnl_c) AS pnl_c, rank FROM (SELECT wallet, sum(gain)::BIGINT AS pnl_c FROM resolved GROUP BY 1) p LEFT JOIN (SELECT * FROM board WHERE category = 'OVERALL' AND period = 'MONTH') b USING (wallet)",
    "critical_wallet_semi": "SELECT trade_id, wallet FROM trades WHERE wallet IN (SELECT wallet FROM critical)",
    "new_wallets_anti": f"SELECT DISTINCT taker AS wallet FROM fills WHERE taker NOT IN (SELECT wallet FROM trades WHERE t < {DAY0 + 86400})",
    "hybrid_override_merge": "SELECT wallet, CASE WHEN pnl_c > 0 THEN pnl_c ELSE volume_c END AS amount FROM (SELECT wallet, sum(value_c)::BIGINT AS volume_c FROM trades GROUP BY 1) LEFT JOIN (SELECT wallet, sum(gain)::BIGINT AS pnl_c FROM resolved GROUP BY 1) USING (wallet)",
    "funding_join": "SELECT wallet, trades, source, block FROM (SELECT wallet, count(*) AS trades FROM trades GROUP BY 1) LEFT JOIN first_f USING (wallet)",
    "missing_ids_anti": "SELECT DISTINCT condition_id FROM trades WHERE condition_id NOT IN (SELECT condition_id FROM resolutions)",
    "value_weighted_accuracy": "SELECT wallet, (sum(CASE WHEN win THEN value_c ELSE 0 END) / sum(value_c))::DOUBLE AS accuracy FROM resolved WHERE value_c > 0 GROUP BY 1",
    "trader_timing": """SELECT wallet, round(sum(s) / (count(*) * 3600), 6) AS avg_hours, min(s) / 3600 AS min_hours, max(s) / 3600 AS max_hours, round(coalesce(stddev_samp(s / 3600), 0), 6) AS std_hours,
      count(*) FILTER (s < 3600) AS pre_resolution_trades, count(*) FILTER (s < 3600) / count(*) AS pre_resolution_ratio, count(*) FILTER (s < 600) / count(*) AS last_minute_ratio, count(*) AS resolved_trades
      FROM (SELECT *, greatest(secs, 0) AS s FROM resolved) GROUP BY 1""",
    "trader_whales": """SELECT wallet, max_value_c, volume_c / n AS avg_value_c, volume_c, whale_trades, mega_trades, whale_trades / n AS whale_ratio, pre_resolution_whales, winning_pre_resolution_whales,
      coalesce(pre_resolution_whales / nullif(whale_trades, 0), 0)::DOUBLE AS pre_resolution_whale_ratio, coalesce(winning_pre_resolution_whales / nullif(whale_trades, 0), 0)::DOUBLE AS winning_whale_ratio FROM (
      SELECT wallet, max(value_c) AS max_value_c, sum(value_c)::BIGINT AS volume_c, count(*) AS n, count(*) FILTER (value_c >= 500000) AS whale_trades, count(*) FILTER (value_c >= 2500000) AS mega_trades,
      count(*) FILTER (value_c >= 500000 AND secs > 0 AND secs < 3600) AS pre_resolution_whales, count(*) FILTER (value_c >= 500000 AND secs > 0 AND secs < 3600 AND win) AS winning_pre_resolution_whales FROM maybe GROUP BY 1)""",
    "trader_multi_market": """SELECT wallet, count(*) AS unique_markets, count(*) FILTER (resolved) AS resolved_markets, count(*) FILTER (any_win) AS winning_markets,
      coalesce(count(*) FILTER (any_win) / nullif(count(*) FILTER (resolved), 0), 0)::DOUBLE AS market_success_rate FROM (SELECT wallet, condition_id, bool_or(win) AS any_win, count(winner_idx) > 0 AS resolved FROM maybe GROUP BY 1, 2) GROUP BY 1""",
    "trader_cross_market": "SELECT wallet, count(DISTINCT condition_id) AS categories_traded, count(DISTINCT condition_id) / 5.0::DOUBLE AS diversification FROM trades GROUP BY 1",
    "trader_category_mix": f"SELECT wallet, topic, count(*) AS trades FROM trades JOIN (SELECT condition_id, {_TOPIC} AS topic FROM markets) USING (condition_id) GROUP BY 1, 2",
    "trader_recent_winrate": "SELECT * FROM recent",
    "trader_market_share": "SELECT wallet, (max(v) / sum(v))::DOUBLE AS max_market_share FROM (SELECT wallet, condition_id, sum(value_c) AS v FROM trades GROUP BY 1, 2) GROUP BY 1",
    "trader_category_score": f"SELECT wallet, round(coalesce(avg(score), 1.0), 6) AS category_score FROM trades LEFT JOIN (SELECT condition_id, {_RISK} AS score FROM markets) USING (condition_id) GROUP BY 1",
    "trader_activity_span": "SELECT wallet, min(t) AS first_t, max(t) AS last_t FROM trades GROUP BY 1",
    "trader_profile": "SELECT * REPLACE (round(category_score, 6) AS category_score) FROM profile",
    "trader_profile_big": """SELECT wallet, sum(value_c)::BIGINT AS volume_c, count(*) FILTER (value_c >= 500000) AS whale_trades, count(*) FILTER (value_c >= 2500000) AS mega_trades FROM (
      SELECT o_custkey AS wallet, CAST(l_quantity * 100 AS BIGINT) * (trunc(l_extendedprice)::BIGINT % 97 + 1) AS value_c FROM lineitem JOIN orders ON o_orderkey = l_orderkey) GROUP BY 1""",
    "trader_winrate_resolved": "SELECT wallet, count(*) FILTER (win) AS wins, count(*) AS resolved, count(*) FILTER (win) / count(*) AS winrate FROM resolved GROUP BY 1",
    "trader_resolved_pnl": "SELECT wallet, sum(gain)::BIGINT AS pnl_c FROM resolved GROUP BY 1",
    "trader_volume": "SELECT wallet, sum(value_c)::BIGINT AS volume_c, count(*) AS trades FROM trades GROUP BY 1",
    "trader_avg_cost_pnl": """SELECT wallet, sum(n)::BIGINT AS trades, count(*) AS markets, sum(wins)::BIGINT AS profitable_trades, sum(wins) / sum(n) AS winrate, sum(volume_c)::BIGINT / 100 AS volume,
      round(sum(profit), 4) AS profit, round(sum(profit) / (sum(volume_c)::BIGINT / 100), 6) AS roi FROM cost GROUP BY 1""",
    "qualified_traders": "SELECT wallet, sum(n)::BIGINT AS trades, sum(wins) / sum(n) AS winrate FROM cost GROUP BY 1 HAVING sum(n) >= 60 AND sum(wins) / sum(n) >= 0.05",
    "top_roi_traders_per_market": "SELECT * FROM (SELECT condition_id, wallet, roi, row_number() OVER (PARTITION BY condition_id ORDER BY roi DESC, wallet)::INT AS place FROM (SELECT *, round(profit / (volume_c / 100), 6) AS roi FROM cost)) WHERE place <= 5",
    "scout_performance": """SELECT wallet, count(*) FILTER (win) / count(*) AS winrate, count(*) AS resolved, round(avg(secs), 6) AS avg_secs, count(*) FILTER (secs > 0 AND secs < 600) / count(*) AS last_minute_ratio, max(size) AS max_size
      FROM (SELECT *, row_number() OVER (PARTITION BY wallet ORDER BY t DESC, trade_id DESC) AS r FROM maybe) WHERE r <= 200 AND winner_idx IS NOT NULL GROUP BY 1 HAVING count(*) >= 5""",
    "trader_positions_value": "SELECT wallet, count(*) AS positions, sum(current_value_c)::BIGINT AS value_c FROM positions GROUP BY 1",
    "markets_traded": "SELECT wallet, count(DISTINCT condition_id) AS markets_traded FROM trades GROUP BY 1",
    "trader_fill_count": "SELECT maker AS wallet, count(*) AS fills FROM fills GROUP BY 1",
    "leaderboard": "SELECT * FROM board",
    "elite_wallets": "SELECT * FROM elite",
    "market_holders": "SELECT * FROM (SELECT condition_id, wallet, net, row_number() OVER (PARTITION BY condition_id ORDER BY net DESC, wallet)::INT AS place FROM (SELECT condition_id, wallet, sum(CASE side WHEN 'BUY' THEN size ELSE -size END)::BIGINT AS net FROM trades GROUP BY 1, 2) WHERE net > 0) WHERE place <= 10",
    "iax_trade_edge": "SELECT trade_id, round(edge, 6) AS edge, round(conviction, 6) AS conviction, round(obscurity, 6) AS obscurity, round(urgency, 6) AS urgency, round(edge * conviction * obscurity * urgency, 6) AS te FROM edges",
    "iax_wallet": "SELECT *, CASE WHEN iax_score > 15 THEN 'CRITICAL' WHEN iax_score >= 10 THEN 'HIGH' WHEN iax_score >= 5 THEN 'MEDIUM' ELSE 'LOW' END AS iax_level FROM iax",
    **{f"score_{n}": f"SELECT wallet, round(s_{n}, 6) AS score FROM parts" for n in ("winrate", "pnl", "timing", "cross_market", "camouflage", "category", "freshness", "fresh_wallet", "position_sizing", "cluster", "early_entry", "off_hours", "volume_impact")},
    "score_activity_penalty": "SELECT wallet, s_activity AS score FROM parts",
    "score_cluster_detector": """SELECT wallet, least(2.5, CASE WHEN size >= 5 THEN 1.5 WHEN size >= 3 THEN 1 WHEN size >= 2 THEN 0.5 ELSE 0 END + CASE WHEN coordinated >= 10 THEN 1 WHEN coordinated >= 5 THEN 0.5 ELSE 0 END)::DOUBLE AS score
      FROM comp JOIN related USING (wallet)""",
    "risk_score": f"SELECT wallet, risk_score, {_LEVEL.format(x='risk_score')} AS level, profile_type FROM scored",
    "risk_score_full": f"SELECT wallet, risk_full AS risk_score, {_LEVEL.format(x='risk_full')} AS level FROM scored",
    "fast_position_score": "SELECT wallet, round(position_score, 6) AS score FROM fasts",
    "fast_activity_score": "SELECT wallet, activity_score AS score FROM fasts",
    "fast_risk_score": f"""SELECT wallet, risk_score, {_LEVEL.format(x='risk_score')} AS level, CASE WHEN rank IS NULL THEN 'UNKNOWN' WHEN pnl_c > 5000000 AND rank <= 100 THEN 'INSIDER' WHEN pnl_c > 2500000 THEN 'PRO' WHEN pnl_c < 0 THEN 'LOSER' ELSE 'CASUAL' END AS profile_type
      FROM (SELECT *, CASE WHEN rank IS NULL THEN 0 ELSE round(least(10.0, CASE WHEN pnl_c <= 0 THEN -1.5 ELSE least(4.0, {_LN.format(x="greatest(pnl_c, 0) / 100")}) END + position_score + activity_score), 4) END::DOUBLE AS risk_score FROM fasts)""",
    "unified_fast_risk": "SELECT wallet, fast_score FROM fasts",
    "unified_timing_whale_multi": "SELECT wallet, timing::DOUBLE AS timing, whale::DOUBLE AS whale, multi_market::DOUBLE AS multi_market FROM unified",
    "unified_detailed_risk": "SELECT wallet, detailed_score FROM unified",
    "hybrid_scores": f"""SELECT wallet, risk_score, {_LEVEL.format(x='risk_score')} AS level, detailed FROM (SELECT wallet, CASE WHEN fast_score >= 4 AND k <= 30 THEN detailed_score ELSE fast_score END AS risk_score, fast_score >= 4 AND k <= 30 AS detailed
      FROM (SELECT *, row_number() OVER (ORDER BY fast_score DESC, wallet) AS k FROM unified))""",
    "trader_profile_fast": "SELECT * FROM fast",
    "market_priority": f"""SELECT condition_id, priority, place FROM (SELECT condition_id, priority, row_number() OVER (ORDER BY priority DESC, condition_id)::INT AS place, count(*) OVER () AS n FROM (
      SELECT condition_id, round(liquidity * 0.5::DOUBLE + volume * 0.3::DOUBLE + {_INSIDER} * 1e5 * 0.2::DOUBLE, 4) AS priority FROM markets WHERE condition_id IN (SELECT condition_id FROM trades))) WHERE place <= greatest(floor(n * 0.7), 1)""",
    "summary_table": f"SELECT wallet, level, pnl_c, place::INT AS place, (place - 1) // 25 AS page FROM (SELECT wallet, level, pnl_c, row_number() OVER (ORDER BY (level <> 'CRITICAL'), pnl_c DESC, wallet) AS place FROM (SELECT *, {_LEVEL.format(x='risk_score')} AS level FROM scored) WHERE level IN ('HIGH', 'CRITICAL'))",
    "profile_summary": f"SELECT level, count(*) AS wallets, round(avg(risk_score), 6) AS avg_risk, max(risk_score) AS max_risk, round(avg(pnl_c / 100), 4) AS avg_pnl FROM (SELECT *, {_LEVEL.format(x='risk_score')} AS level FROM scored) GROUP BY 1",
    "wallet_correlations": """SELECT * FROM related JOIN (SELECT wallet, string_agg(other::VARCHAR, ',' ORDER BY other) AS addresses FROM
  (SELECT w1 AS wallet, w2 AS other FROM pairs WHERE pairs >= 3 UNION ALL SELECT w2, w1 FROM pairs WHERE pairs >= 3) GROUP BY 1) USING (wallet)""",
    "wallet_clusters": "SELECT *, size - 1 AS related FROM comp",
    "funding_clusters": "SELECT wallet, 'funding_' || left(source::VARCHAR, 12) AS cluster_id, CASE WHEN source IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY source) END AS size FROM (SELECT DISTINCT wallet FROM trades) LEFT JOIN first_f USING (wallet)",
    "first_funding_any": """SELECT to_wallet AS wallet, from_wallet AS source, block, value_c, t AS funded_t FROM transfers
      WHERE value_c < 45000000 OR block >= (SELECT max(block) - 2000000 FROM transfers WHERE value_c >= 45000000)
      QUALIFY row_number() OVER (PARTITION BY to_wallet ORDER BY value_c < 45000000, block, transfer_id) = 1""",
    "first_funding": "SELECT to_wallet AS wallet, from_wallet AS source, block, value_c, t AS funded_t FROM transfers WHERE block >= (SELECT max(block) - 2000000 FROM transfers) QUALIFY row_number() OVER (PARTITION BY to_wallet ORDER BY block, transfer_id) = 1",
    "funding_chain": "SELECT * FROM chain",
    "common_funding_sources": "SELECT source, count(DISTINCT wallet) AS wallets FROM chain GROUP BY 1 HAVING count(DISTINCT wallet) > 1",
    "address_flow_summary": """SELECT wallet, sum(i)::BIGINT AS in_count, sum(1 - i)::BIGINT AS out_count, sum(i * v)::BIGINT AS in_c, sum((1 - i) * v)::BIGINT AS out_c, (sum(i * v) - sum((1 - i) * v))::BIGINT AS net_c FROM (
      SELECT to_wallet AS wallet, 1 AS i, value_c AS v, block FROM transfers UNION ALL SELECT from_wallet, 0, value_c, block FROM transfers) WHERE block >= (SELECT max(block) - 500000 FROM transfers) GROUP BY 1""",
    "just_in_time_funding": """SELECT wallet, condition_id, max(f.t) AS last_funding_t, min(f.t) AS first_t, max(value_c) AS largest_c, (closed_at - max(f.t)) / 60 AS minutes, closed_at - max(f.t) < 3600 AS just_in_time
      FROM (SELECT DISTINCT wallet, condition_id, closed_at FROM resolved) h JOIN transfers f ON f.to_wallet = h.wallet AND f.t < closed_at GROUP BY wallet, condition_id, closed_at""",
    "market_window_stats": "SELECT condition_id, w, volume_c, buy_c, sell_c, traders FROM stats",
    "market_hhi": "SELECT condition_id, w, hhi FROM stats",
    "market_gini": "SELECT condition_id, w, gini FROM stats",
    "whale_dominance": "SELECT condition_id, w, whale_dominance FROM stats",
    "trades_per_minute": "SELECT condition_id, w, trades_per_minute FROM stats",
    "market_baseline_z": "SELECT condition_id, w, points, volume_z, trader_z, velocity_z FROM zs",
    "anomaly_score": "SELECT condition_id, w, anomaly_score FROM anom",
    "anomaly_alerts": "SELECT condition_id, w FROM anom WHERE volume_c >= 1000000 AND points >= 24 AND anomaly_score >= 7 AND volume_z >= 2.5 AND (hhi >= 0.2 OR whale_dominance >= 0.4)",
    "anomaly_level": "SELECT condition_id, w, CASE WHEN anomaly_score >= 9 THEN 'CRITICAL_ANOMALY' WHEN anomaly_score >= 8 AND (hhi >= 0.3 OR whale_dominance >= 0.6) THEN 'HIGH_CONCENTRATION' WHEN anomaly_score >= 7.5 THEN 'MODERATE_ANOMALY' ELSE 'STATISTICAL_ANOMALY' END AS alert_level FROM anom WHERE anomaly_score >= 6",
    "critical_trader_alerts": """SELECT condition_id, w, count(*) AS critical_wallets, max(max_v) AS largest_c FROM ww JOIN (SELECT condition_id, w, sum(v) AS total FROM ww GROUP BY 1, 2) USING (condition_id, w)
      WHERE wallet IN (SELECT wallet FROM critical) AND (max_v > 1000000 OR v / total > 0.3) GROUP BY 1, 2""",
    "alert_cooldown": "SELECT * FROM cool",
    "top_markets_by_volume": "SELECT condition_id, sum(value_c)::BIGINT AS volume_24h_c FROM trades WHERE t > (SELECT max(t) - 86400 FROM trades) AND condition_id IN (SELECT condition_id FROM markets WHERE active) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "v1_window_metrics": "SELECT * FROM v1m",
    "v1_alert_level": """SELECT condition_id, w, volume_c, CASE WHEN hit THEN 'CRITICAL_TRADER' WHEN same_side > 0.7 AND max_concurrent >= 5 THEN 'COORDINATED_DIRECTIONAL' WHEN same_side > 0.7 THEN 'DIRECTIONAL_SPIKE' WHEN max_concurrent >= 5 THEN 'COORDINATED_ACTIVITY'
      WHEN volume_c >= 2500000 THEN 'CRITICAL_VOLUME' WHEN volume_c >= 1500000 THEN 'HIGH_VOLUME' ELSE 'VOLUME_SPIKE' END AS alert_level FROM v1m LEFT JOIN (
      SELECT DISTINCT condition_id, t // 3600 * 3600 AS w, true AS hit FROM trades WHERE wallet IN (SELECT wallet FROM critical)) USING (condition_id, w) WHERE volume_c >= 500000 AND volume_c >= threshold_c""",
    "hourly_market_baseline": """SELECT condition_id, w AS hour_t, sum(v)::BIGINT AS volume_c, count(*) AS traders, round(sum(v::DOUBLE * v) / (sum(v)::DOUBLE * sum(v)), 6) AS hhi, sum(n)::DOUBLE / 60 AS trades_per_minute,
      hour(to_timestamp(w))::INT AS hour, dayofweek(to_timestamp(w))::INT AS day FROM (SELECT condition_id, t // 3600 * 3600 AS w, wallet, sum(value_c)::BIGINT AS v, count(*) AS n FROM trades GROUP BY 1, t // 3600 * 3600, 3) GROUP BY 1, 2""",
    "hourly_volume_dense": """SELECT condition_id, w, coalesce(volume_c, 0)::BIGINT AS volume_c FROM (SELECT condition_id, unnest(range(min(t) // 3600 * 3600, max(t) // 3600 * 3600 + 1, 3600)) AS w FROM trades GROUP BY 1)
      LEFT JOIN (SELECT condition_id, t // 3600 * 3600 AS w, sum(value_c) AS volume_c FROM trades GROUP BY 1, t // 3600 * 3600) USING (condition_id, w)""",
    "pump_dump_pattern": """SELECT * FROM (SELECT condition_id, t // 3600 * 3600 AS w, side, count(DISTINCT wallet) AS wallets, arg_min(price_c, t * 1000000000 + trade_id) AS first_c, arg_max(price_c, t * 1000000000 + trade_id) AS last_c
      FROM trades GROUP BY 1, t // 3600 * 3600, 3) WHERE wallets >= 2 AND abs(last_c - first_c) / first_c > 0.01""",
    "wash_trading": """SELECT condition_id, wallet, w, bought + sold AS gross, abs(bought - sold) AS net FROM (SELECT condition_id, wallet, t // 86400 * 86400 AS w, sum(CASE side WHEN 'BUY' THEN size ELSE 0 END)::BIGINT AS bought,
      sum(CASE side WHEN 'SELL' THEN size ELSE 0 END)::BIGINT AS sold, min(price_c) AS low, max(price_c) AS high FROM trades GROUP BY 1, 2, t // 86400 * 86400)
      WHERE bought > 0 AND sold > 0 AND bought + sold >= 10000 AND abs(bought - sold) / (bought + sold) <= 0.1 AND (high - low) / low <= 0.2""",
    "sybil_sync": """SELECT * FROM (SELECT cluster_id, condition_id, side, t // 86400 * 86400 AS w, count(DISTINCT wallet) AS wallets, round(stddev_pop(trades.size) / avg(trades.size), 6) AS size_cv FROM trades JOIN comp USING (wallet) GROUP BY 1, 2, 3, t // 86400 * 86400)
      WHERE wallets >= 2 AND size_cv <= 0.5""",
    "price_jump_candidates": "SELECT * REPLACE (round(magnitude, 6) AS magnitude) FROM cand",
    "price_jumps": "SELECT * REPLACE (round(magnitude, 6) AS magnitude) FROM jumps",
    "pre_jump_labels": "SELECT trade_id, start_t, direction, is_pre_jump FROM labels",
    "token_quotes": "SELECT condition_id, t, bid, ask, (bid + ask) / 2 AS mid, ask - bid AS spread FROM quotes QUALIFY row_number() OVER (PARTITION BY condition_id ORDER BY t DESC) = 1",
    "portfolio_summary": f"SELECT wallet, count(*) AS positions, round(sum(total_pnl_c), 2) AS pnl_c, sum(current_value_c)::BIGINT AS value_c FROM (SELECT *, row_number() OVER ({_BY_PNL}) AS r FROM positions) WHERE r <= 50 AND current_value_c >= 100000 GROUP BY 1",
    "portfolio_change_alerts": "SELECT * FROM (SELECT *, lag(pnl_c, 1, 0) OVER (PARTITION BY wallet ORDER BY day) AS before_c FROM snaps) WHERE before_c = 0 OR abs(pnl_c - before_c) >= 500000",
    "top_positions": f"SELECT wallet, condition_id, outcome_index, total_pnl_c, place FROM (SELECT *, row_number() OVER ({_BY_PNL})::INT AS place FROM positions) WHERE place <= 5",
    "top_holdings": f"SELECT wallet, condition_id, outcome_index, current_value_c, row_number() OVER (PARTITION BY wallet ORDER BY current_value_c DESC, condition_id, outcome_index)::INT AS place FROM (SELECT *, row_number() OVER ({_BY_PNL}) AS r FROM positions) WHERE r <= 10",
    "stale_profiles": "SELECT wallet, max(t) AS last_t, now - max(t) > 90000 AS stale FROM trades, as_of GROUP BY wallet, now",
    "stale_profile_stats": "SELECT count(*) AS profiles, count(*) FILTER (s) AS stale, count(*) FILTER (NOT s) AS fresh FROM (SELECT wallet, now - max(t) > 90000 AS s FROM trades, as_of GROUP BY wallet, now)",
    "incremental_profile_store": """SELECT wallet, count(*) AS trades, sum(value_c)::BIGINT AS volume_c, max(value_c) AS max_value_c, min(t) AS first_t, max(t) AS last_t, count(winner_idx) AS resolved,
      count(*) FILTER (outcome_index = winner_idx) AS wins, coalesce((count(*) FILTER (outcome_index = winner_idx))::DOUBLE / nullif(count(winner_idx), 0), 0) AS winrate,
      sum(value_c)::DOUBLE / count(*) AS avg_value_c, count(DISTINCT condition_id) AS markets FROM trades LEFT JOIN resolutions USING (condition_id) GROUP BY 1""",
    "incremental_profile_merge": "SELECT wallet, count(*) AS trades, sum(value_c)::BIGINT AS volume_c, max(value_c) AS max_value_c, min(t) AS first_t, max(t) AS last_t FROM trades GROUP BY 1",
    "ml_features": """SELECT l.trade_id, l.wallet, l.side, l.label, m.category AS market_type, p.trades AS total_trades, p.winrate, iax_score, total_edge, avg_conviction, avg_obscurity, avg_urgency
      FROM (SELECT trade_id, wallet, side, condition_id, max(is_pre_jump) AS label FROM labels GROUP BY ALL) l LEFT JOIN markets m ON m.condition_id = l.condition_id JOIN profile p ON p.wallet = l.wallet JOIN iax ON iax.wallet = l.wallet""",
    "categorical_cardinality": """SELECT name, n AS distinct, text AND n <= 50 AS categorical FROM (SELECT 'side' AS name, count(DISTINCT side) AS n, true AS text FROM trades UNION ALL SELECT 'condition_id', count(DISTINCT condition_id), false FROM trades
      UNION ALL SELECT 'outcome_index', count(DISTINCT outcome_index), false FROM trades UNION ALL SELECT 'market', count(DISTINCT condition_id), true FROM trades)""",
}

# closed windows only: the last watermark is ten minutes before the last trade
_WINDOWS = """SELECT condition_id, w, sum(v)::BIGINT AS volume_c, sum(b)::BIGINT AS buy_c, (sum(v) - sum(b))::BIGINT AS sell_c, count(*) AS traders, sum(n)::BIGINT AS trades,
      round(sum(v::DOUBLE * v) / (sum(v)::DOUBLE * sum(v)), 6) AS hhi, round(2.0 * sum(up * v)::DOUBLE / (count(*) * sum(v)) - (count(*) + 1) / count(*), 6) AS gini,
      (sum(v) FILTER (down <= 3))::DOUBLE / sum(v)::DOUBLE AS whale_dominance FROM (SELECT *, row_number() OVER (PARTITION BY condition_id, w ORDER BY v, wallet) AS up,
      row_number() OVER (PARTITION BY condition_id, w ORDER BY v DESC, wallet) AS down FROM (
      SELECT condition_id, w, wallet, sum(value_c)::BIGINT AS v, sum(CASE side WHEN 'BUY' THEN value_c ELSE 0 END)::BIGINT AS b, count(*) AS n
      FROM (SELECT *, {starts} AS w FROM trades) GROUP BY 1, 2, 3)) WHERE w + 1800 <= (SELECT max(epoch(ts)) - 600 FROM events) GROUP BY 1, 2"""
_BATCHES = """SELECT wallet, condition_id, t // 60 * 60 AS w, sum(size)::BIGINT AS size, arg_max(side, t * 1000000000 + trade_id) AS side, arg_max(price_c, t * 1000000000 + trade_id) AS price_c, count(*) AS trades, max(t) AS last_t
      FROM trades GROUP BY 1, 2, t // 60 * 60"""
_MILESTONES = "SELECT wallet, t, seen, seen // 10 AS milestone FROM (SELECT wallet, t, row_number() OVER (ORDER BY t, wallet) AS seen FROM (SELECT wallet, min(t) AS t FROM trades WHERE value_c >= 500000 GROUP BY 1)) WHERE seen % 10 = 0"
_CLOSED = f"SELECT * FROM ({_BATCHES}) WHERE w + 60 <= (SELECT max(epoch(ts)) - 600 FROM events)"

SQL |= {
    "src_stream_trades": "SELECT trade_id, wallet, condition_id, t FROM trades",
    "st_new_wallets": f"SELECT wallet FROM (SELECT maker AS wallet FROM fills UNION SELECT taker FROM fills) WHERE wallet NOT IN (SELECT wallet FROM trades WHERE t < {DAY0 + 86400})",
    "st_market_windows": _WINDOWS.format(starts="t // 1800 * 1800"),
    "st_market_windows_sliding": _WINDOWS.format(starts="t // 300 * 300 - unnest(range(6)) * 300"),
    "st_volume_anomalies": """SELECT condition_id, w, anomaly_score, CASE WHEN anomaly_score >= 9 THEN 'CRITICAL_ANOMALY' WHEN anomaly_score >= 8 AND (hhi >= 0.3 OR whale_dominance >= 0.6) THEN 'HIGH_CONCENTRATION'
        WHEN anomaly_score >= 7.5 THEN 'MODERATE_ANOMALY' ELSE 'STATISTICAL_ANOMALY' END AS alert_level FROM anom
      WHERE points >= 24 AND volume_c >= 1000000 AND anomaly_score >= 7 AND volume_z >= 2.5 AND (hhi >= 0.2 OR whale_dominance >= 0.4) AND w + 1800 <= (SELECT max(epoch(ts)) - 600 FROM events)""",
    "st_large_trade_alerts": """SELECT trade_id, wallet, condition_id, value_c FROM trades WHERE value_c >= 500000 AND wallet IN (SELECT wallet FROM resolved GROUP BY 1 HAVING count(*) FILTER (win) / count(*) >= 0.5)""",
    "trade_batches_batch": _BATCHES,
    "st_trade_batches": _CLOSED,
    "st_trade_notifications": f""", bn AS (SELECT *, row_number() OVER (PARTITION BY wallet, condition_id ORDER BY w) AS k FROM ({_CLOSED})),
      nw2 AS (SELECT wallet, condition_id, 1::BIGINT AS k, last_t AS last, true AS sent FROM bn WHERE k = 1
        UNION ALL SELECT x.wallet, x.condition_id, b.k, CASE WHEN b.last_t - x.last >= 864000 THEN b.last_t ELSE x.last END, b.last_t - x.last >= 864000
          FROM nw2 x JOIN bn b ON b.wallet = x.wallet AND b.condition_id = x.condition_id AND b.k = x.k + 1)
      SELECT bn.* EXCLUDE (k) FROM bn JOIN nw2 USING (wallet, condition_id, k) WHERE sent""",
    "st_position_changes": "SELECT * FROM (SELECT *, lag(pnl_c, 1, 0) OVER (PARTITION BY wallet ORDER BY day) AS before_c FROM snaps) WHERE before_c = 0 OR abs(pnl_c - before_c) >= 500000",
    "critical_count_milestones_batch": _MILESTONES,
    "st_critical_count_milestones": _MILESTONES,
    "st_late_data": "SELECT t // 3600 * 3600 AS w, count(*) AS trades FROM trades GROUP BY t // 3600 * 3600 HAVING w + 3600 <= (SELECT max(epoch(ts)) - 7200 FROM events)",
    "collected_trades": "SELECT wallet, count(*) AS trades, sum(value_c)::BIGINT AS value_c FROM trades WHERE wallet IN (SELECT DISTINCT wallet FROM board WHERE category IN ('OVERALL', 'POLITICS', 'CRYPTO') AND rank <= 20) GROUP BY 1",
    "st_unreadable_messages": "SELECT 'malformed' AS reason, count(*) AS lines FROM trades WHERE value_c >= 500000 UNION ALL SELECT 'incomplete', count(*) FROM trades WHERE side = 'SELL'",
    "sink_trade_batches": "SELECT condition_id % 16 AS bucket, count(*) AS trades, sum(value_c)::BIGINT AS value_c FROM trades GROUP BY 1",
    "st_alert_cooldown": """, al AS (SELECT condition_id, t, CASE WHEN trade_id % 7 = 0 THEN 'CRITICAL_TRADER' ELSE 'STATISTICAL_ANOMALY' END AS alert_level FROM trades WHERE value_c >= 500000),
      aln AS (SELECT *, row_number() OVER (PARTITION BY condition_id ORDER BY t, alert_level) AS k FROM al),
      cw AS (SELECT condition_id, 0::BIGINT AS k, NULL::BIGINT AS last, NULL::BIGINT AS t, NULL::VARCHAR AS alert_level, false AS took FROM (SELECT DISTINCT condition_id FROM al)
        UNION ALL SELECT c.condition_id, a.k, CASE WHEN a.alert_level = 'CRITICAL_TRADER' OR c.last IS NULL OR a.t - c.last >= 3600 THEN a.t ELSE c.last END, a.t, a.alert_level,
          a.alert_level = 'CRITICAL_TRADER' OR c.last IS NULL OR a.t - c.last >= 3600 FROM cw c JOIN aln a ON a.condition_id = c.condition_id AND a.k = c.k + 1)
      SELECT condition_id, t, alert_level FROM cw WHERE took""",
    "sink_export": """SELECT '{"wallet":' || wallet || ',"volume_c":' || sum(value_c)::BIGINT || ',"trades":' || count(*) || '}' AS json FROM trades GROUP BY wallet""",
}

#: For each derived table the tables it needs.
_NAMES = {"fasts": "unified", "ww": "stats"}


def _query(body: str) -> str:
    """The query with the derived tables that it names, in order of need."""
    import re

    named = lambda text: {_NAMES.get(n, n) for n in re.findall(r"\w+", text) if _NAMES.get(n, n) in PARTS}
    needed: list[str] = []

    def need(part: str) -> None:
        for other in sorted(named(PARTS[part]) - {part}):
            if other not in needed and other not in ("stats",) or (other == "stats" and part in ("zs", "alerts") and other not in needed):
                need(other)
        if part not in needed:
            needed.append(part)

    for part in sorted(named(body)):
        need(part)
    parts = [PARTS[p] for p in needed]
    return "WITH RECURSIVE " + ",\n".join([BASE.strip(), *parts]) + "\n" + body


def batch_oracle() -> dict[str, str]:
    return {name: _query(body) for name, body in SQL.items()}
