"""Sequential operators on handmade frames, properties, plans and the public entry points."""

import math
import os
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tradelens.operators import graph, incremental, joins, market, ml, pairs, positions, profiles, ranks
from tradelens.plans import detector
from tradelens.sources import reads
from tradelens.sources.tables import Tables
from tradelens.streaming import streams

DATA = "/root/testdata/sf0.001"
TRADE = "trade_id long, wallet long, condition_id int, t long, side string, price_c long, outcome_index int, size long"


def trades(spark, rows):
    return spark.createDataFrame(rows, TRADE).withColumn("value_c", F.col("size") * F.col("price_c")).withColumn("ts", F.timestamp_seconds("t"))


def some(seed=1, n=300):
    r = random.Random(seed)
    return [(k, r.randint(1, 12), r.randint(1, 4), 1_704_067_200 + r.randint(0, 86400 * 3), r.choice(["BUY", "SELL"]), r.randint(5, 95), r.randint(0, 1), r.randint(1, 500)) for k in range(n)]


def test_average_cost(spark):
    rows = some()
    got = {r.wallet: r for r in profiles.avg_cost_pnl(trades(spark, rows)).collect()}
    state, profit, wins = defaultdict(lambda: [0.0, 0.0, 0.0]), defaultdict(float), defaultdict(int)
    for _, wallet, market_, _, side, price, _, size in sorted(rows, key=lambda x: (x[3], x[0])):
        s = state[wallet, market_]
        if side == "BUY":
            s[0] += size
            s[1] += size * price / 100
            s[2] = s[1] / s[0]
        else:
            if s[0] > 0:
                gain = (price / 100 - s[2]) * size
                profit[wallet] += gain
                wins[wallet] += gain > 0
            sold = min(size, s[0])
            s[0] -= sold
            s[1] -= sold * s[2]
            s[2] = s[2] if s[0] > 0 else 0
    for w, r in got.items():
        assert abs(r.profit - profit[w]) < 1e-3 and r.profitable_trades == wins[w]
    by = lambda folded: sorted(map(tuple, profiles.avg_cost_by_market(trades(spark, rows), folded).collect()))
    for a, b, mixed in zip(by(0), by(10**6), by(6)):
        assert a == pytest.approx(b, rel=1e-9, abs=1e-9) and mixed == pytest.approx(b, rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("sell", [0.45, 0.6])
def test_average_cost_of_one_very_large_group(spark, sell):
    """One wallet in one market; costs fade through many blocks of the recurrence, and the holding is flat at times."""
    r = random.Random(5)
    rows = [(k, 1, 1, k // 3, "SELL" if r.random() < sell else "BUY", r.randint(5, 95), 0, r.randint(1, 60)) for k in range(60_000)]
    qty, cost, profit, wins = 0.0, 0.0, 0.0, 0
    for *_, side, price, _, size in rows:
        if side == "BUY":
            qty, cost = qty + size, cost + size * price / 100
        elif qty > 0:
            gain = price / 100 - cost / qty
            left = max(qty - size, 0.0)
            profit, wins = profit + gain * size, wins + (gain > 1e-9)
            qty, cost = left, cost * left / qty
    got = profiles.avg_cost_by_market(trades(spark, rows), 1000).first()
    assert got.n == len(rows) and got.open_qty == pytest.approx(qty) and got.profit == pytest.approx(profit, rel=1e-7) and got.profitable == wins
    assert got.avg_price == pytest.approx(cost / qty if qty > 0.5 else 0, rel=1e-7)


def test_cooldown(spark):
    r = random.Random(2)
    rows = [(r.randint(1, 3), r.randint(0, 6000), r.choice(["A", "CRITICAL_TRADER"])) for _ in range(120)]
    want, last = [], {}
    for m, t, level in sorted(rows):
        if level == "CRITICAL_TRADER" or m not in last or t - last[m] >= 600:
            last[m] = t
            want.append((m, t, level))
    got = market.cooldown(spark.createDataFrame(rows, "condition_id int, t long, alert_level string"))
    assert sorted(map(tuple, got.collect())) == want


@pytest.mark.parametrize("seconds", [1, 60, 600])
def test_cooldown_of_one_dense_market(spark, seconds):
    """Long runs without a gap, equal times and equal alerts."""
    r = random.Random(seconds)
    rows = [(1, r.randint(0, 9000), "CRITICAL_TRADER" if r.random() < 0.01 else "A") for _ in range(4000)] + [(2, 5, "A"), (2, 5, "A"), (3, 7, "CRITICAL_TRADER")]
    want, last = [], {}
    for m, t, level in sorted(rows):
        if level == "CRITICAL_TRADER" or m not in last or t - last[m] >= seconds:
            last[m] = t
            want.append((m, t, level))
    df = spark.createDataFrame(rows, "condition_id int, t long, alert_level string")
    assert sorted(map(tuple, market.cooldown(df, seconds).collect())) == want
    assert market.cooldown(df.limit(0), seconds).count() == 0


def test_price_jumps_thin_a_long_slope(spark):
    """Magnitudes that rise from hour to hour keep the rounds going; ties go to the earlier start."""
    p = [(1, h * 3600, 5 + (h % 150) // 10 * 5 if h % 150 < 100 else 60) for h in range(900)]
    df = spark.createDataFrame(p, "condition_id int, t long, p long")
    found = [(x.magnitude, x.start_t) for x in market.jump_candidates(df, 0.05).collect()]
    kept = []
    for _, s in sorted(found, key=lambda x: (-x[0], x[1])):
        if all(abs(s - k) >= 86400 for k in kept):
            kept.append(s)
    assert sorted(x.start_t for x in market.price_jumps(df, 0.05).collect()) == sorted(kept) and len(kept) > 10
    assert market.price_jumps(df.limit(0), 0.05).count() == 0


def test_price_jumps(spark):
    r = random.Random(3)
    prices = [(m, h * 3600, r.randint(5, 95)) for m in (1, 2) for h in range(120) if r.random() < 0.7]
    got = sorted((x.condition_id, x.start_t, x.end_t, x.direction) for x in market.price_jumps(spark.createDataFrame(prices, "condition_id int, t long, p long"), 0.3).collect())
    want = []
    for m in (1, 2):
        own = [(t, p) for k, t, p in prices if k == m]
        found = []
        for t, p in own:
            ahead = [(q, u) for u, q in own if t < u <= t + 86400]
            if not ahead:
                continue
            hi, lo = max(q for q, _ in ahead), min(q for q, _ in ahead)
            up, down = (hi - p) / p, (p - lo) / p
            if up >= 0.3:
                found.append((-up, t, min(u for q, u in ahead if q == hi), "up"))
            elif down >= 0.3:
                found.append((-down, t, min(u for q, u in ahead if q == lo), "down"))
        kept = []
        for f in sorted(found):
            if all(abs(f[1] - k[1]) >= 86400 for k in kept):
                kept.append(f)
        want += [(m, s, e, d) for _, s, e, d in kept]
    assert got == sorted(want)


def test_pairs_and_clusters(spark):
    rows = some(4, 400)
    want = defaultdict(int)
    for a in rows:
        for b in rows:
            if a[1] < b[1] and abs(a[3] - b[3]) <= 600:
                want[a[1], b[1]] += 1
    pairs = graph.coordinated_pairs(trades(spark, rows), 600)
    assert {(r.w1, r.w2): r.pairs for r in pairs.collect()} == want
    chain = spark.createDataFrame([(k, k + 1, 3) for k in range(1, 30)] + [(50, 51, 3), (52, 50, 3)], "w1 long, w2 long, pairs long")
    got = {r.wallet: (r.cluster_id, r["size"], r.related) for r in graph.clusters(chain).collect()}
    assert got == {**{k: (1, 30, 29) for k in range(1, 31)}, 50: (50, 3, 2), 51: (50, 3, 2), 52: (50, 3, 2)}


def test_range_join_is_an_equi_join(spark):
    plan = graph.coordinated_pairs(trades(spark, some()))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_funding_chain(spark):
    first = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (4, 5), (10, 11), (11, 10), (20, 17), (17, 1), (30, 30)], "wallet long, source long")
    contracts = spark.createDataFrame([(17,)], "wallet long")
    got = sorted(map(tuple, graph.funding_chain(first, contracts, 3).collect()))
    assert [x for x in got if x[0] == 1] == [(1, 1, 2), (1, 2, 3), (1, 3, 4)]
    assert [x for x in got if x[0] == 10] == [(10, 1, 11), (10, 2, 10)]  # the closing hop stays
    assert [x for x in got if x[0] == 20] == [(20, 1, 17)]  # a contract ends the chain
    assert [x for x in got if x[0] == 30] == [(30, 1, 30)]


@pytest.mark.parametrize(("edge", "conviction", "price", "urgency", "want"), [(0.5, 0.05, 0.5, 1.0, 0.017), (0.95, 1.0, 0.05, 1.2, 3.42), (-0.05, 1.0, 0.05, 1.0, -0.15)])
def test_iax_golden(spark, edge, conviction, price, urgency, want):
    got = spark.range(1).select((F.lit(edge) * F.lit(conviction) * -F.log(F.lit(price)) * F.lit(urgency)).alias("x")).first().x
    assert abs(got - want) < 0.01 and abs(got - edge * conviction * -math.log(price) * urgency) < 1e-12


def test_window_properties(spark):
    for r in market.window_stats(trades(spark, some(5, 600)), 7200).collect():
        assert 0 < r.hhi <= 1 and 0 <= r.gini < 1 and 0 < r.whale_dominance <= 1 and r.buy_c + r.sell_c == r.volume_c


def test_dense_hours(spark):
    df = trades(spark, [(1, 1, 1, 0, "BUY", 10, 0, 1), (2, 1, 1, 4 * 3600, "BUY", 10, 0, 1)])
    got = [(r.w, r.volume_c) for r in market.densified_hours(df).orderBy("w").collect()]
    assert got == [(0, 10), (3600, 0), (7200, 0), (10800, 0), (14400, 10)]


def test_incremental_equals_recomputation(spark):
    df = trades(spark, some(6))
    cut = 1_704_067_200 + 86400
    merged = incremental.incremental_merge(incremental.partials(df.where(F.col("t") <= cut)), df)
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, incremental.partials(df).collect()))


def test_merge_override_and_reads(spark, tmp_path):
    base = spark.createDataFrame([(1, 10), (2, 20)], "wallet long, v long")
    better = spark.createDataFrame([(2, None)], "wallet long, v long")
    assert sorted(map(tuple, joins.merge_override(base, better).collect())) == [(1, 10), (2, None)]
    df = trades(spark, some(7)).drop("ts")
    reads.append_batch(df, str(tmp_path / "t"))
    reads.append_batch(df, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 600
    for kind in ("parquet", "json", "csv"):
        reads.export_profiles(base.withColumn("s", F.struct("v")), str(tmp_path / kind), kind)
        assert spark.read.format(kind).load(str(tmp_path / kind)).count() == 2


def test_empty_tables(spark):
    none = trades(spark, [])
    res = spark.createDataFrame([], "condition_id int, winner_idx int, closed_at long")
    for df in (profiles.timing(none, res), profiles.avg_cost_pnl(none), market.window_stats(none), graph.coordinated_pairs(none), positions.daily_snapshots(none)):
        assert df.count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_filters_and_columns_reach_the_scan(spark):
    x = Tables(spark, DATA)
    plan = x.read("events").where("event_id >= 7").select("event_id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(event_id), GreaterThanOrEqual(event_id,7)]" in plan
    plan = profiles.volume(x.trades)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<" in plan and "event_type" not in plan.split("ReadSchema")[1]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_modes_and_anomalies(spark):
    x = Tables(spark, DATA)
    wallets = x.trades.select("wallet").distinct().count()
    for mode in ("fast", "detailed", "hybrid", "auto"):
        assert detector.analyze_traders(x.trades, x.resolutions, x.markets, x.positions, mode, 1.0, 5).count() == wallets
    with pytest.raises(ValueError):
        detector.analyze_traders(x.trades, x.resolutions, x.markets, x.positions, "other")
    assert detector.find_insiders(x.trades, x.resolutions, x.markets, x.positions, 0.0, "fast").count() == wallets
    assert set(detector.market_anomalies(x.trades, x.trades.select("wallet").distinct()).columns) == {"condition_id", "t", "alert_level"}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_stream_windows_equal_batch(spark):
    got = streams.collected(streams.market_windows(streams.trade_stream(spark, DATA)))
    batch = market.window_stats(Tables(spark, DATA).trades).select(*got.columns)
    extra = got.exceptAll(batch).count()
    assert extra == 0 and batch.count() - got.count() <= 3  # windows still open at the last watermark


def test_busy_buckets_are_dealt_in_parts(spark, monkeypatch):
    df = trades(spark, some(8, 400))
    plain = sorted(map(tuple, graph.coordinated_pairs(df, 600).collect()))
    monkeypatch.setattr(pairs, "PART_ROWS", 3)
    assert sorted(map(tuple, graph.coordinated_pairs(df, 600).collect())) == plain


def test_ranks_by_blocks(spark):
    from pyspark.sql import Window

    r = random.Random(9)
    rows = [(k, r.choice("ab"), r.choice([0, 1, -1, 10**12, -(10**12), r.randint(-5000, 5000)])) for k in range(500)]
    df = spark.createDataFrame(rows, "k long, g string, v long")
    want = df.withColumn("place", F.rank().over(Window.partitionBy("g").orderBy(F.desc("v"))))
    got = ranks.ranked(df, ["g"], ranks.value_block(F.col("v")), [F.desc("v")], ties=True)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(map(tuple, want.collect()))
    counted = ranks.ranked_values(df, ["g"], "v", "place")
    assert counted.columns == want.columns and sorted(map(tuple, counted.collect())) == sorted(map(tuple, want.collect()))
    every = ranks.ranked(df, [], ranks.value_block(F.col("v")), [F.desc("v"), F.col("k")]).orderBy("place").collect()
    assert [x.place for x in every] == list(range(1, 501)) and [x.k for x in every] == [k for k, _, _ in sorted(rows, key=lambda x: (-x[2], x[0]))]


def test_quotes_as_of(spark):
    r = random.Random(10)
    rows = some(10, 300)
    first = 1_704_067_200
    quotes = [(r.randint(1, 4), first + r.randint(0, 86400 * 3), 2 * k) for k in range(40)]
    quotes = list({(m, t): (m, t, b) for m, t, b in quotes}.values())
    q = spark.createDataFrame([(m, t, b, b + 2) for m, t, b in quotes], "condition_id int, t long, bid long, ask long")
    got = {x.trade_id: x.mid for x in profiles._asof_mid(trades(spark, rows), q).collect()}
    for k, _, m, t, *_ in rows:
        before = [(u, b) for n, u, b in quotes if n == m and u <= t]
        assert got[k] == (max(before)[1] + 1 if before else None)


def test_baseline_counts_hours_without_trades(spark):
    """Points are the last half hours of all hours since the market's first, zero without trades."""
    r = random.Random(11)
    rows = [(m, 1_704_067_200 + 1800 * h, r.randint(1, 10**6), r.randint(1, 9), r.randint(1, 30)) for m in (1, 2) for h in range(700) if r.random() < 0.3]
    df = spark.createDataFrame(rows, "condition_id int, w long, volume_c long, traders long, trades long")
    for x in market.baseline_z(df, 168, 24).collect():
        own = {w: v for m, w, v, _, _ in rows if m == x.condition_id}
        hour, start = x.w // 3600 * 3600, min(own) // 3600 * 3600
        points = [own.get(h + 1800, 0) for h in range(max(start, hour - 168 * 3600), hour, 3600)]
        mean = sum(points) / max(len(points), 1)
        sd = math.sqrt(sum((p - mean) ** 2 for p in points) / max(len(points), 1))
        assert x.points == len(points)
        assert abs(x.volume_z - ((x.volume_c - mean) / sd if len(points) >= 24 and sd > 0 else 0)) < 2e-6


def files(spark, folder, parts, schema):
    """A folder with one file a part, in this order of time."""
    import time

    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(1.1)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_late_rows_are_counted(spark, tmp_path):
    hour = lambda h: 3600 * h
    stream = files(spark, tmp_path / "in", [[(hour(1),), (hour(30),)], [(hour(31),)], [(hour(2),), (hour(32),)], [(hour(60),)]], "t long")
    stream = stream.withColumn("ts", F.timestamp_seconds("t")).withWatermark("ts", "2 hours")
    out, late = streams.drained(stream.groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n")).select(F.unix_timestamp("w.start").alias("w"), "n"))
    assert late == 1 and {(x.w, x.n) for x in out.collect()} == {(hour(h), 1) for h in (1, 30, 31, 32)}


def test_milestones_over_batches(spark, tmp_path):
    r = random.Random(12)
    parts = [[(r.randint(1, 60), 1000 * k + j) for j in range(40)] for k in range(3)]
    stream = files(spark, tmp_path / "in", parts, "wallet long, t long")
    first = {}
    for w, t in sorted((x for p in parts for x in p), key=lambda x: x[1]):
        first.setdefault(w, t)
    order = sorted(first.items(), key=lambda x: (x[1], x[0]))
    want = [(w, t, k, k // 10) for k, (w, t) in enumerate(order, 1) if k % 10 == 0]
    got = streams.milestone_stream(stream, 10)
    assert sorted(map(tuple, got.collect()), key=lambda x: x[2]) == want
    assert sorted(map(tuple, streams.milestones(spark.createDataFrame(order, "wallet long, t long"), 10).collect()), key=lambda x: x[2]) == want


def test_nested_profile(spark):
    x = profiles.nested_profile(profiles.trader_profile(
        trades(spark, some()), spark.createDataFrame([(1, 0, 1_704_067_200 + 86400)], "condition_id int, winner_idx int, closed_at long"),
        spark.createDataFrame([(1, "q", "", "crypto", "btc-up")], "condition_id int, question string, group_item_title string, category string, slug string"),
    ))
    row = x.first()
    assert {"timing", "whales", "multi_market", "cross_market"} <= set(x.columns) and set(row.cross_market.topics) <= {"crypto", "other"}
    assert sum(row.cross_market.topics.values()) <= row.trades


def test_model_learns_and_gives_probabilities(spark):
    r = random.Random(13)
    rows = []
    for k in range(400):
        rate, side = r.random(), r.choice(["BUY", "SELL"])
        rows.append((k, k % 20, side, r.choice(["tech", "crypto"]), int(rate > 0.5 and side == "BUY"), r.randint(1, 90), rate, *[r.random() for _ in range(5)]))
    names = "trade_id long, wallet long, side string, market_type string, label int, total_trades long, winrate double, iax_score double, total_edge double, avg_conviction double, avg_obscurity double, avg_urgency double"
    data = spark.createDataFrame(rows, names)
    got = ml.predict(ml.train(data.where("trade_id < 300")), data.where("trade_id >= 300")).collect()
    assert len(got) == 100 and all(0 <= x.probability <= 1 and x.prediction == (x.probability > 0.5) for x in got)
    assert sum(x.prediction == x.label for x in got) >= 90


def test_no_row_is_predicted_by_a_model_that_saw_its_wallet(spark):
    """Out of fold: every row once, wallets in one fold each, and better than chance where features tell."""
    r = random.Random(14)
    rows = []
    for k in range(600):
        rate, side = r.random(), r.choice(["BUY", "SELL"])
        rows.append((k, k % 40, side, r.choice(["tech", "crypto"]), int(rate > 0.6 and side == "BUY"), r.randint(1, 90), rate, *[r.random() for _ in range(5)]))
    names = "trade_id long, wallet long, side string, market_type string, label int, total_trades long, winrate double, iax_score double, total_edge double, avg_conviction double, avg_obscurity double, avg_urgency double"
    data = spark.createDataFrame(rows, names)
    starts = spark.createDataFrame([(w, 1000 + 7 * w) for w in range(40)], "wallet long, first_t long")
    cut_ = ml.time_folds(data, starts, 3).cache()
    folds = {(x.wallet, x.fold) for x in cut_.select("wallet", "fold").distinct().collect()}
    assert len(folds) == 40 and {f for _, f in folds} == {0, 1, 2}
    assert [f for _, f in sorted(folds)] == sorted(f for _, f in folds)  # later wallets, later folds
    got = ml.out_of_fold(cut_, 3)
    rows_ = got.collect()
    assert sorted(x.trade_id for x in rows_) == list(range(600)) and all(0 <= x.probability <= 1 for x in rows_)
    base = sum(x.label for x in rows_) / len(rows_)
    assert 0.1 < base < 0.3 and ml.area_under_curve(got) > 0.9
    fold_of = {x.trade_id: x.fold for x in cut_.collect()}
    assert all(x.fold == fold_of[x.trade_id] for x in rows_)
    # the model of a fold is the one that its other folds give
    own = ml.predict(ml.train(cut_.where("fold <> 1")), cut_.where("fold = 1"))
    assert {(x.trade_id, x.probability) for x in own.collect()} == {(x.trade_id, x.probability) for x in rows_ if x.fold == 1}


def test_profile_store_folds_and_leaves_other_buckets(spark, tmp_path):
    rows = some(21, 900)
    wallets = {w for _, w, *_ in rows}
    res = spark.createDataFrame([(1, 0, 1_704_067_200 + 86400), (2, 1, 1_704_067_200 + 90000)], "condition_id int, winner_idx int, closed_at long")
    cut_ = 1_704_067_200 + 86400
    df = trades(spark, rows)
    store = incremental.ProfileStore(spark, str(tmp_path / "profiles"), 8)
    assert store.read().count() == 0
    store.fold(df.where(f"t < {cut_}"), res)
    store.fold(df, res)
    drop = lambda x: incremental.with_rates(x)
    columns = sorted(drop(store.read().drop("bucket")).columns)
    once = sorted(map(tuple, drop(incremental.profile_partials(df, res)).select(*columns).collect()))
    assert sorted(map(tuple, drop(store.read().drop("bucket")).select(*columns).collect())) == once and len(once) == len(wallets)
    files_ = lambda: {str(f): f.stat().st_mtime_ns for f in (tmp_path / "profiles").rglob("*.parquet")}
    before = files_()
    assert store.fold(df, res) == [] and files_() == before  # nothing new, nothing written
    one = trades(spark, [(10**6, 3, 1, cut_ + 10**6, "BUY", 50, 0, 10)])
    touched = store.fold(one, res)
    changed = {f for f in set(before) ^ set(files_())}
    assert len(touched) == 1 and changed and all(f"bucket={touched[0]}/" in f for f in changed)
    got = {r.wallet: r for r in drop(store.read()).collect()}
    want = {r.wallet: r for r in drop(incremental.profile_partials(df.unionByName(one), res)).collect()}
    assert {w: (r.trades, r.volume_c, r.wins, r.last_t, r.winrate) for w, r in got.items()} == {w: (r.trades, r.volume_c, r.wins, r.last_t, r.winrate) for w, r in want.items()}


def test_market_sketch_is_within_its_error(spark):
    big = spark.range(60_000).select(
        F.col("id").alias("trade_id"), F.lit(1).cast("long").alias("wallet"), (F.col("id") % 20_000).cast("int").alias("condition_id"), F.col("id").alias("t"),
        F.lit("BUY").alias("side"), F.lit(50).cast("long").alias("price_c"), F.lit(0).alias("outcome_index"), F.lit(1).cast("long").alias("size"), F.lit(50).cast("long").alias("value_c"),
    )
    res = spark.createDataFrame([], "condition_id int, winner_idx int, closed_at long")
    halves = incremental.merge_profiles(incremental.profile_partials(big.where("t < 25000"), res), incremental.profile_partials(big.where("t >= 25000"), res))
    got = incremental.with_rates(halves).first()
    assert got.trades == 60_000 and abs(got.markets - 20_000) < 3 * 0.0163 * 20_000


def test_funding_before_a_close_is_found_across_days(spark):
    r = random.Random(22)
    day = 86400
    rows = [(k, r.randint(1, 4), r.randint(1, 9), 0, "BUY", 50, 0, 1) for k in range(60)]
    closes = [(m, 0, r.randint(1, 12) * day + r.choice([0, 1, r.randint(2, day - 1)])) for m in range(1, 8)]
    moves = [(k, 9, w, r.randint(1, 900), t) for k, (w, t) in enumerate((r.randint(1, 3), r.choice([r.randint(0, 12) * day, r.randint(0, 13 * day)])) for _ in range(40))]
    moves += [(100 + k, 9, 1, 5, t) for k, (_, _, t) in enumerate(closes[:3])]  # a funding at the close is not before it
    got = graph.just_in_time_funding(
        trades(spark, rows), spark.createDataFrame(closes, "condition_id int, winner_idx int, closed_at long"),
        spark.createDataFrame(moves, "transfer_id long, from_wallet long, to_wallet long, value_c long, t long"),
    ).collect()
    want = set()
    for w, m in {(x[1], x[2]) for x in rows}:
        for close in (t for k, _, t in closes if k == m):
            own = [(t, v) for _, _, to, v, t in moves if to == w and t < close]
            if own:
                last = max(t for t, _ in own)
                want.add((w, m, last, min(t for t, _ in own), max(v for _, v in own), (close - last) / 60, close - last < 3600))
    assert {tuple(x) for x in got} == want and len(got) == len(want) > 10


def test_first_funding_falls_back_to_native_transfers(spark):
    kind = "transfer_id long, from_wallet long, to_wallet long, value_c long, block long, t long"
    tokens = spark.createDataFrame([(1, 7, 1, 10, 50, 50), (2, 8, 1, 10, 40, 40), (3, 9, 2, 10, 5, 5)], kind)
    native = spark.createDataFrame([(4, 5, 1, 1, 1, 1), (5, 6, 2, 1, 3, 3), (6, 4, 2, 1, 2, 2), (7, 3, 3, 1, 60, 60)], kind)
    of = lambda *a: {x.wallet: x.source for x in graph.first_funding(*a).collect()}
    assert of(tokens) == {1: 8, 2: 9}
    assert of(tokens, 20, native) == {1: 8, 2: 4, 3: 3}  # wallet 2 has no token transfer in the last 20 blocks
    assert of(tokens.limit(0), None, native) == {1: 5, 2: 4, 3: 3}


def test_trader_files_are_preferred_to_batches(spark, tmp_path):
    df, at = trades(spark, some(23, 40)), str(tmp_path / "collected")
    with pytest.raises(FileNotFoundError):
        reads.collected_trades(spark, at)
    reads.write_batch_files(df.where("trade_id < 30"), at, "1")
    reads.write_batch_files(df.where("trade_id >= 30").drop("side"), at, "2")
    batches = reads.collected_trades(spark, at)
    assert batches.count() == 40 and batches.where("side is null").count() == 10
    reads.write_trader_files(df.where("wallet = 3"), at, "3")
    assert {x.wallet for x in reads.collected_trades(spark, at).collect()} == {3}


def test_messages_that_cannot_be_used_are_kept_apart(spark):
    lines = ['{"type":"trade","trade_id":1,"wallet":2,"condition_id":3,"t":4,"side":"BUY"}', '{"type":"trade","trade_id":1,"wal', "", "null", "[]", '{"trade_id":1}',
             '{"type":"trade","trade_id":1,"wallet":2,"t":4}', '{"type":"book","condition_id":3,"t":4}', '{"type":"book"}', '{"type":"ping"}', '{"type":"trade","trade_id":"x","wallet":2,"condition_id":3,"t":4}', None]
    x = streams.parse_messages(spark.createDataFrame([(v,) for v in lines], "value string"))
    assert [r.trade_id for r in streams.route(x).collect()] == [1] and streams.route(x, "book").count() == 1 and streams.route(x, "ping").count() == 1
    bad = [r.reason for r in streams.unreadable(x).collect()]
    assert sorted(bad) == ["incomplete"] * 3 + ["malformed"] * 6
    assert {r.value for r in streams.unreadable(x).collect()} < set(lines)


def test_older_monitor_has_all_seven_levels_in_order(spark):
    """One market a level, in its own hour; each also meets the conditions of the levels after it."""
    hour, rows = 1_704_067_200, []

    def add(market_, wallets, buys, size, minutes):
        for k, w in enumerate(wallets):
            side = "BUY" if k < buys else "SELL"
            rows.append((len(rows), w, market_, hour + minutes * k, side, 50, 0, size))

    add(1, [100, 1, 2, 3, 4, 5], 6, 400, 10)  # a critical wallet, one way, six within five minutes
    add(2, [1, 2, 3, 4, 5, 6], 6, 400, 10)  # one way and together
    add(3, [1, 2, 3, 4], 4, 700, 600)  # one way, far apart
    add(4, [1, 2, 3, 4, 5, 6], 3, 400, 10)  # both ways, together
    add(5, [1, 2, 3, 4], 2, 1500, 600)  # both ways, far apart, and large
    add(6, [1, 2, 3, 4], 2, 900, 600)
    add(7, [1, 2, 3, 4], 2, 600, 600)
    add(8, [1, 2, 3, 4], 4, 100, 600)  # below the floor
    add(9, [1, 2, 3, 4], 2, 600, 600)
    rows.append((len(rows), 9, 9, hour - 3600, "BUY", 50, 0, 400_000))  # two per cent of the day before is more than this hour's volume
    got = market.v1_alerts(trades(spark, rows), spark.createDataFrame([(100,)], "wallet long"), 100_000, 150_000, 250_000, 500_000)
    levels = {(r.condition_id, r.alert_level) for r in got.where(f"w = {hour}").collect()}
    assert levels == {
        (1, "CRITICAL_TRADER"), (2, "COORDINATED_DIRECTIONAL"), (3, "DIRECTIONAL_SPIKE"), (4, "COORDINATED_ACTIVITY"), (5, "CRITICAL_VOLUME"), (6, "HIGH_VOLUME"), (7, "VOLUME_SPIKE")
    }
    metrics = {r.condition_id: r for r in market.v1_metrics(trades(spark, rows), 100_000, 500_000).where(f"w = {hour}").collect()}
    assert metrics[2].max_concurrent == 6 and metrics[3].max_concurrent == 1 and metrics[4].same_side == 0.5 and metrics[9].threshold_c > metrics[9].volume_c


def test_critical_traders_alert_by_size_or_share(spark):
    t = 1_704_067_200
    rows = [(0, 1, 1, t, "BUY", 50, 0, 100), (1, 2, 1, t + 5, "BUY", 50, 0, 900), (2, 1, 2, t, "BUY", 50, 0, 400), (3, 2, 2, t, "BUY", 50, 0, 600), (4, 1, 3, t, "BUY", 50, 0, 90_000), (5, 2, 3, t, "BUY", 50, 0, 900_000)]
    got = market.critical_trader_alerts(trades(spark, rows), spark.createDataFrame([(1,)], "wallet long"), 4_000_000, 0.3)
    assert {(r.condition_id, r.critical_wallets, r.largest_c) for r in got.collect()} == {(2, 1, 20_000), (3, 1, 4_500_000)}


def test_baseline_frames_only_grow(spark):
    """No frame moves at both ends, so the work is the same for any number of points."""
    df = spark.createDataFrame([(1, 0, 1, 1, 1)], "condition_id int, w long, volume_c long, traders long, trades long")
    plan = lambda points: market.baseline_z(df, points)._jdf.queryExecution().optimizedPlan().toString()
    frames = [x for x in plan(672).split("RangeFrame, ")[1:]]
    assert len(frames) >= 2 and all(x.startswith("unboundedpreceding") for x in frames) and plan(168).count("RangeFrame") == len(frames)
