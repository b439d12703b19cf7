"""Wallet graphs: coordinated trading, connected components, funding trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradelens.operators import pairs
from tradelens.sources.shared import checkpointed


def coordinated_pairs(trades: DataFrame, window_s: int = 60, min_pairs: int = 1) -> DataFrame:
    """Pairs of wallets with the number of their trade pairs at most ``window_s`` apart, from ``min_pairs`` on.

    Trades are first counted by wallet and second. Busy minutes are searched by prefixes, see ``pairs``.
    """
    return pairs.near_pairs(trades, window_s, min_pairs)


def wallet_correlations(found: DataFrame) -> DataFrame:
    """(wallet, related, coordinated, addresses): for each wallet of the pairs the others, their number and the sum of pairs.

    ``addresses`` are the others in order, joined by commas.
    """
    both = found.select(F.col("w1").alias("wallet"), F.col("w2").alias("other"), "pairs").unionByName(
        found.select(F.col("w2").alias("wallet"), F.col("w1").alias("other"), "pairs")
    )
    x = both.groupBy("wallet").agg(F.count("*").alias("related"), F.sum("pairs").alias("coordinated"), F.collect_list("other").alias("others"))
    return x.select("wallet", "related", "coordinated", _joined("others").alias("addresses"))


def _joined(others: str) -> Column:
    return F.array_join(F.sort_array(others).cast("array<string>"), ",")


def correlations(trades: DataFrame, window_s: int = 60, min_pairs: int = 3) -> DataFrame:
    """``wallet_correlations`` of the coordinated pairs: sums and lists are made for classes of wallets, and no pairs are written out."""
    sums, who = pairs.class_lists(trades, window_s, min_pairs)
    x = who.select("wallet", "class").join(sums, "class").withColumn("others", F.array_except("others", F.array("wallet")))
    return x.select("wallet", "related", "coordinated", _joined("others").alias("addresses"))


def cluster_sums(trades: DataFrame, window_s: int = 60, min_pairs: int = 3) -> DataFrame:
    """``wallet_clusters`` with the sum ``coordinated`` of each wallet's coordinated pairs, of one search for pairs."""
    links, who = pairs.class_links(trades, window_s, min_pairs)
    links = checkpointed(links)
    sums = links.groupBy("class").agg(F.sum("coordinated").alias("coordinated"))
    own = who.select("wallet", "class").join(sums, "class").select("wallet", "coordinated")
    return clusters(links.select(F.col("near").alias("w1"), F.col("class").alias("w2")), who).join(own, "wallet")


def related_wallets(trades: DataFrame, window_s: int = 60, min_pairs: int = 3, most: int = 5) -> DataFrame:
    """(wallet, related) as in ``correlations``, for who does not tell ``most`` from more: the sums of all pairs are not made."""
    return pairs.related_up_to(trades, window_s, min_pairs, most)


def wallet_clusters(trades: DataFrame, window_s: int = 60, min_pairs: int = 3) -> DataFrame:
    """``clusters`` of the coordinated pairs: a class of wallets is one node, and all its wallets are where it is."""
    links, who = pairs.class_links(trades, window_s, min_pairs)
    return clusters(links.select(F.col("near").alias("w1"), F.col("class").alias("w2")), who)


def clusters(found: DataFrame, who: DataFrame | None = None) -> DataFrame:
    """(wallet, cluster_id, size): connected components labelled by their least wallet.

    ``who(wallet, class)`` tells the wallets of each node, if nodes are classes named by their least wallet. Labels spread along the edges and then jump to the label of their label, so rounds grow with the
    logarithm of the longest path; every round is checkpointed.
    """
    edges = found.select(F.col("w1").alias("a"), F.col("w2").alias("b"))
    edges = checkpointed(edges.union(edges.select("b", "a")).distinct())
    labels, last = edges.groupBy("a").agg(F.least("a", F.min("b")).alias("l")), None
    while True:
        labels = checkpointed(labels)
        mark = labels.agg(F.sum(F.col("l").cast("decimal(38,0)"))).first()[0]
        if mark == last:
            break
        last = mark
        near = edges.join(labels.select(F.col("a").alias("b"), F.col("l").alias("m")), "b").groupBy("a").agg(F.min("m").alias("m"))
        step = labels.join(near, "a").select("a", F.least("l", "m").alias("l"))
        jump = step.select(F.col("a").alias("l"), F.col("l").alias("up"))
        labels = step.join(jump, "l", "left").select("a", F.coalesce("up", "l").alias("l"))
    if who is not None:
        labels = who.join(labels.select(F.col("a").alias("class"), "l"), "class").select(F.col("wallet").alias("a"), "l")
    sizes = labels.groupBy("l").agg(F.count("*").alias("size"))
    return labels.join(sizes, "l").select(F.col("a").alias("wallet"), F.col("l").alias("cluster_id"), "size", (F.col("size") - 1).alias("related"))


def first_funding(transfers: DataFrame, max_blocks: int | None = None, native: DataFrame | None = None) -> DataFrame:
    """Earliest incoming transfer of each wallet, within the last blocks if given.

    A wallet without a token transfer there takes its earliest of ``native``, of the same columns, at whatever block. Both are one
    aggregate: token transfers come first in its order.
    """
    if max_blocks is not None:
        transfers = transfers.where(F.col("block") >= transfers.select(F.max("block") - max_blocks).scalar())
    names = ["to_wallet", "block", "transfer_id", "from_wallet", "value_c", "t"]
    every = transfers.select(*names, F.lit(0).alias("kind"))
    if native is not None:
        every = every.unionByName(native.select(*names, F.lit(1).alias("kind")))
    out = every.groupBy(F.col("to_wallet").alias("wallet")).agg(F.min(F.struct("kind", "block", "transfer_id", "from_wallet", "value_c", "t")).alias("x"))
    return out.select("wallet", F.col("x.from_wallet").alias("source"), F.col("x.block").alias("block"), F.col("x.value_c").alias("value_c"), F.col("x.t").alias("funded_t"))


def funding_clusters(wallets: DataFrame, first: DataFrame) -> DataFrame:
    """Wallets grouped by first source; an unknown source is a cluster of one without id."""
    out = wallets.select("wallet").join(first.select("wallet", "source"), "wallet", "left")
    sizes = first.join(wallets.select("wallet"), "wallet", "left_semi").groupBy("source").agg(F.count("*").alias("n"))
    out = out.join(sizes, "source", "left")
    known = F.col("source").isNotNull()
    return out.select(
        "wallet", F.when(known, F.concat(F.lit("funding_"), F.substring(F.col("source").cast("string"), 1, 12))).alias("cluster_id"),
        F.when(known, F.col("n")).otherwise(1).alias("size"),
    )


def funding_chain(first: DataFrame, contracts: DataFrame, depth: int = 3) -> DataFrame:
    """(wallet, hop, source): first sources followed up to ``depth`` hops.

    A chain ends at a contract, at a wallet without a source, and at a cycle, whose closing hop is kept.
    """
    step = first.select(F.col("wallet").alias("at"), F.col("source").alias("next"))
    stop = contracts.select(F.col("wallet").alias("next"), F.lit(True).alias("contract"))
    step = step.join(stop, "next", "left").select("at", "next", F.coalesce("contract", F.lit(False)).alias("contract"))
    now = step.select(F.col("at").alias("wallet"), F.array("at").alias("seen"), F.lit(1).alias("hop"), F.col("next").alias("source"), (F.col("contract") | (F.col("next") == F.col("at"))).alias("ended"))
    hops = [now]
    for k in range(2, depth + 1):
        open_ = now.where("not ended").withColumn("seen", F.concat("seen", F.array("source")))
        now = open_.join(step, open_["source"] == step["at"]).select(
            "wallet", "seen", F.lit(k).alias("hop"), F.col("next").alias("source"), (F.col("contract") | F.array_contains("seen", F.col("next"))).alias("ended")
        )
        hops.append(now)
    out = hops[0]
    for h in hops[1:]:
        out = out.unionByName(h)
    return out.select("wallet", "hop", "source")


def common_sources(chain: DataFrame) -> DataFrame:
    return chain.groupBy("source").agg(F.count_distinct("wallet").alias("wallets")).where("wallets > 1")


def flow_summary(transfers: DataFrame, max_blocks: int = 10_000) -> DataFrame:
    """Counts and sums in and out of each wallet within the last blocks."""
    recent = transfers.where(F.col("block") >= transfers.select(F.max("block") - max_blocks).scalar())
    legs = recent.select(F.explode(F.array(
        F.struct(F.col("to_wallet").alias("wallet"), F.lit(1).alias("i"), F.col("value_c").alias("v")),
        F.struct(F.col("from_wallet").alias("wallet"), F.lit(0).alias("i"), F.col("value_c").alias("v")),
    )).alias("x")).select("x.*")
    n = F.sum("i").cast("long")
    in_, out = F.sum(F.when(F.col("i") == 1, F.col("v")).otherwise(0)), F.sum(F.when(F.col("i") == 0, F.col("v")).otherwise(0))
    return legs.groupBy("wallet").agg(n.alias("in_count"), (F.count("*") - n).alias("out_count"), in_.alias("in_c"), out.alias("out_c"), (in_ - out).alias("net_c"))


def just_in_time_funding(trades: DataFrame, res: DataFrame, transfers: DataFrame, within_s: int = 3600) -> DataFrame:
    """For each (wallet, closed market) the last funding strictly before the close: an as-of join.

    Fundings and closes of a wallet and day lie in one sorted window, so a wallet's fundings are read once and not
    paired with each of its markets; from earlier days three numbers a wallet and day are carried. A busy wallet is
    so many tasks as it has days.
    """
    held = trades.select("wallet", "condition_id").distinct().join(res.select("condition_id", "closed_at"), "condition_id")
    f = transfers.select(F.col("to_wallet").alias("wallet"), "t", F.lit(None).cast("int").alias("condition_id"), F.col("t").alias("last_t"), F.col("value_c"))
    q = held.select("wallet", F.col("closed_at").alias("t"), "condition_id", F.lit(None).cast("long").alias("last_t"), F.lit(None).cast("long").alias("value_c"))
    both = f.unionByName(q).withColumn("day", F.expr("t div 86400"))
    inside = Window.partitionBy("wallet", "day").orderBy("t").rangeBetween(Window.unboundedPreceding, -1)
    earlier = Window.partitionBy("wallet").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    days = both.groupBy("wallet", "day").agg(F.max("last_t").alias("last"), F.max("value_c").alias("most"), F.min("last_t").alias("first"))
    carried = days.select(
        "wallet", "day", F.max("last").over(earlier).alias("_last"), F.max("most").over(earlier).alias("_most"), F.min("first").over(earlier).alias("_first")
    )
    both = both.withColumns({"own": F.max("last_t").over(inside), "most": F.max("value_c").over(inside), "first": F.min("last_t").over(inside)})
    out = both.where("condition_id is not null").join(carried, ["wallet", "day"])
    before, largest = F.coalesce("own", "_last"), F.greatest("most", "_most")  # nulls do not count
    out = out.withColumns({"before": before, "largest_c": largest, "first_t": F.coalesce("_first", "first")}).where("before is not null")
    gap = F.col("t") - F.col("before")
    return out.select("wallet", "condition_id", F.col("before").alias("last_funding_t"), "first_t", "largest_c", (gap / 60).alias("minutes"), (gap < within_s).alias("just_in_time"))
