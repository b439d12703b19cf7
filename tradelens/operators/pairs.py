"""Pairs of wallets that trade near each other in time at least so often: a range join with a threshold.

Time falls into buckets as wide as the window; a trade on the left meets the right side's trades of its own and both
neighbouring buckets. A bucket in which few wallets meet is joined outright. In a *busy* one every wallet would meet
every other, so there pairs are searched first, as in a set join with a threshold ``m``:

* a pair that can reach ``m`` in a single bucket has counts whose product is ``m`` or more, and is found by a join on the bucket
  and a level of the count, in which no other pair is a row;
* any other pair has to share several busy buckets. Each wallet orders its buckets by how busy they are and leaves out
  the busiest as long as they cannot bring ``m`` together; a pair that reaches ``m`` without a product as above shares
  one of the buckets that are left on both sides, so only those are joined.

Candidates, and the pairs seen in quiet buckets, are then counted in the busy buckets of both wallets alone.

Wallets that trade at exactly the same seconds, as often in each, are one class: their pairs with any other wallet are the same. Only
one wallet of a class is joined, and a class of many is no more work than one wallet. Who needs sums or components reads them off
the classes; only who asks for all pairs of wallets gets the classes' pairs written out, without a shuffle of the result.

Who only needs to know whether a wallet has so many others (``related_up_to``) meets them in rounds, the most active ones first; a wallet
that has enough leaves. In a dense table that is a bounded number of others for each trade, however many there are. Others of few rows, as those of
the first rounds are, go to all tasks; then a wallet's pairs are added up where they meet, and pairs are not shuffled.

Where more than ``DENSE`` others trade around a trade, and not in a few outstanding buckets alone, nearly every bucket would be busy and leave nothing
out; there all pairs are added up in cells of wallets, see ``cells``, and only the trades are shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tradelens.operators import cells
from tradelens.sources.shared import checkpointed

c = F.col
#: Pairs of (left, right) rows from which on a bucket is busy.
BUSY_PAIRS = 250_000
#: Rows of one part of a busy key.
PART_ROWS = 5_000
#: Wallets of a class that are written out together, and parts over which a class's blocks are dealt for it.
BLOCK, DEALT = 1_000, 16
#: A bucket is outstanding with so many times the meetings of a usual one, and they decide if they have so many times those of all others.
OUTSTANDING, DECIDE = 16, 8
#: Others whom a trade meets in the first round, by how much each round grows, and others up to which one round does.
FIRST, GROWTH, DENSE = 16, 4, 64
#: Rows that go to all tasks at most, and rows that meet in one task then.
SENT_ROWS, TASK_ROWS = 1_000_000, 1_000_000
#: Pairs are told once, by the lesser wallet.
ONCE = "w1 < w2"


def _by_second(trades: DataFrame) -> DataFrame:
    """(wallet, t, n): trades counted by wallet and second, or such counts as they are."""
    return trades if "n" in trades.columns else trades.groupBy("wallet", "t").agg(F.count("*").alias("n"))


def _sides(trades: DataFrame, window_s: int) -> tuple[DataFrame, DataFrame]:
    """Trades counted by wallet and second: (w1, t1, n1, b) and, in three buckets each, (w2, t2, n2, b)."""
    x = _by_second(trades).withColumn("b", F.expr(f"t div {window_s}"))
    left = x.select(c("wallet").alias("w1"), c("t").alias("t1"), c("n").alias("n1"), "b")
    right = x.select(c("wallet").alias("w2"), c("t").alias("t2"), c("n").alias("n2"), F.explode(F.expr("array(b - 1, b, b + 1)")).alias("b"))
    return left, right


def _met(left: DataFrame, right: DataFrame, window_s: int, on: list[str], told: str = ONCE) -> DataFrame:
    """(w1, w2, pairs) of rows that meet in a bucket and lie within the window."""
    near = left.join(right, on).where(F.expr(told) & (F.abs(c("t1") - c("t2")) <= window_s))
    return near.select("w1", "w2", (c("n1") * c("n2")).alias("pairs"))


def dealt(left: DataFrame, right: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides with a ``part``: the left rows of a key of many rows are dealt over parts, the right ones go to each."""
    many = left.groupBy(*keys).agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("parts")).where("parts > 1")
    parts = F.coalesce("parts", F.lit(1))
    spread = left.join(many, keys, "left").withColumn("part", F.pmod(F.xxhash64(*left.columns), parts).cast("int")).drop("parts")
    every = right.join(many, keys, "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return spread, every


def busy_buckets(left: DataFrame, right: DataFrame, busy_pairs: int = BUSY_PAIRS) -> DataFrame:
    """(b, work): buckets in which many rows meet, with their number."""
    rows = left.groupBy("b").agg(F.count("*").alias("l")).join(right.groupBy("b").agg(F.count("*").alias("r")), "b")
    return rows.select("b", (c("l") * c("r")).alias("work")).where(c("work") > busy_pairs)


def _kept(side: DataFrame, wallet: str, n: str, most: DataFrame, least: int) -> DataFrame:
    """The buckets of each wallet without the busiest ones that cannot bring ``least`` together.

    What a bucket can bring: the wallet's count times the other side's greatest, as long as the product is below ``least``.
    """
    other = F.least(c("most"), F.expr(f"{least - 1} div {n}"))
    upto = Window.partitionBy(wallet).orderBy(F.desc("work"), "b").rowsBetween(Window.unboundedPreceding, 0)
    x = side.join(most, "b").withColumn("_sum", F.sum(c(n) * other).over(upto))
    return x.where(c("_sum") >= least).select(wallet, "b")


def candidate_rows(left: DataFrame, right: DataFrame, least: int, told: str = ONCE) -> DataFrame:
    """(w1, w2), with repetitions, of pairs that may reach ``least`` in busy buckets; sides (w1, b, n1, work), (w2, b, n2, work)."""
    one, two = left.withColumn("level", F.least("n1", F.lit(least))), right.withColumn("cap", F.least("n2", F.lit(least)))
    levels = F.sequence(F.expr(f"({least} + cap - 1) div cap"), F.lit(least).cast("long"))
    strong = dealt(one.select("w1", "b", "level"), two.select("w2", "b", F.explode(levels).alias("level")), ["b", "level"])
    alone = strong[0].join(strong[1], ["b", "level", "part"]).where(told).select("w1", "w2")
    greatest = lambda side, n: side.groupBy("b").agg(F.max(n).alias("most"))
    few = dealt(_kept(left, "w1", "n1", greatest(right, "n2"), least), _kept(right, "w2", "n2", greatest(left, "n1"), least), ["b"])
    together = few[0].join(few[1], ["b", "part"]).where(told).select("w1", "w2")
    return alone.unionByName(together)


def _counted(side: DataFrame, wallet: str, n: str, busy: DataFrame) -> DataFrame:
    return side.groupBy(wallet, "b").agg(F.sum(n).alias(n)).join(busy, "b")


def joined_rows(trades: DataFrame, window_s: int, least: int, busy_pairs: int = BUSY_PAIRS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows of the three joins: trades that meet in quiet buckets, candidates, and the candidates' trades that meet in busy ones."""
    return _rows_of_sides(*_sides(trades, window_s), window_s, least, busy_pairs)


def _sent(left: DataFrame, right: DataFrame, window_s: int, tasks: int) -> tuple[DataFrame, DataFrame]:
    """Both sides for a join in which the right one goes to all tasks and a wallet's left rows are in one; three buckets are on the left then."""
    around = left.repartition(tasks, "w1").withColumn("b", F.explode(F.expr("array(b - 1, b, b + 1)")))
    return around, F.broadcast(right.where(f"b = t2 div {window_s}"))


def _rows_of_sides(left: DataFrame, right: DataFrame, window_s: int, least: int, busy_pairs: int, told: str = ONCE, tasks: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As ``joined_rows``; with ``tasks`` the right side goes to so many."""
    busy = checkpointed(busy_buckets(left, right, busy_pairs))  # few narrow rows that four joins read
    if busy.isEmpty():
        none = left.select("w1", c("w1").alias("w2"), c("n1").alias("pairs")).limit(0)
        return _met(*(_sent(left, right, window_s, tasks) if tasks else (left, right)), window_s, ["b"], told), none.drop("pairs"), none
    marks = busy.select("b")
    calm = left.join(marks, "b", "left_anti")
    quiet = _met(*(_sent(calm, right, window_s, tasks) if tasks else (calm, right.join(marks, "b", "left_anti"))), window_s, ["b"], told)
    hot_left, hot_right = left.join(marks, "b", "left_semi"), right.join(marks, "b", "left_semi")
    found = candidate_rows(_counted(hot_left, "w1", "n1", busy), _counted(hot_right, "w2", "n2", busy), least, told)
    seen = quiet.select("w1", "w2").distinct()
    both = seen.join(hot_left.select("w1").distinct(), "w1", "left_semi").join(hot_right.select("w2").distinct(), "w2", "left_semi")
    search = found.unionByName(both.select("w1", "w2")).distinct()
    near = search.join(hot_left, "w1").join(hot_right, ["w2", "b"]).where(F.abs(c("t1") - c("t2")) <= window_s)
    return quiet, found, near.select("w1", "w2", (c("n1") * c("n2")).alias("pairs"))


def members(seconds: DataFrame) -> DataFrame:
    """(wallet, class, size): wallets with the same counts at the same seconds share the class of their least wallet.

    ``seconds(wallet, t, n)``. Sets of seconds are compared by two hashes of 64 bits, their number, sum and ends.
    """
    mark = lambda k: F.bit_xor(F.xxhash64(F.lit(k), "t", "n")).alias(f"h{k}")
    same = ["h0", "h1", "seconds", "trades", "first", "last"]
    x = seconds.groupBy("wallet").agg(mark(0), mark(1), F.count("*").alias("seconds"), F.sum("n").alias("trades"), F.min("t").alias("first"), F.max("t").alias("last"))
    classes = x.groupBy(*same).agg(F.min("wallet").alias("class"), F.count("*").alias("size"))
    return x.join(classes, same).select("wallet", "class", "size")


def _inside(seconds: DataFrame, window_s: int) -> DataFrame:
    """(w1, w2, pairs) of a wallet with another one of the same seconds."""
    near = Window.partitionBy("wallet").orderBy("t").rangeBetween(-window_s, window_s)
    x = seconds.withColumn("pairs", c("n") * F.sum("n").over(near)).groupBy("wallet").agg(F.sum("pairs").alias("pairs"))
    return x.select(c("wallet").alias("w1"), c("wallet").alias("w2"), "pairs")


def _classes(trades: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(wallet, t, n, size) of one wallet of each class, and ``members``."""
    seconds = _by_second(trades.where("wallet is not null"))
    who = checkpointed(members(seconds))
    return checkpointed(seconds.join(who.where("wallet = class").select("wallet", "size"), "wallet")), who


def _own(x: DataFrame, window_s: int, least: int) -> DataFrame:
    """Pairs of the classes of several wallets with themselves."""
    return _inside(x.where("size > 1").select("wallet", "t", "n"), window_s).where(c("pairs") >= least)


def class_pairs(trades: DataFrame, window_s: int, least: int, busy_pairs: int = BUSY_PAIRS) -> tuple[DataFrame, DataFrame]:
    """Pairs (w1, w2, pairs) of classes with ``least`` or more, a class with itself where it has several wallets, and ``members``."""
    x, who = _classes(trades)
    if _evenly_dense(x, window_s, busy_pairs):
        return cells.class_pairs(x, who, window_s, least), who
    return _pairs(x.drop("size"), window_s, least, busy_pairs).unionByName(_own(x, window_s, least)), who


def _evenly_dense(x: DataFrame, window_s: int, busy_pairs: int) -> bool:
    """Whether cells are the way: many others around a trade, and few outstanding buckets, or none, in which these are."""
    if not all(isinstance(x.schema[n].dataType, IntegralType) for n in ("wallet", "t")):
        return False
    buckets = x.groupBy(F.expr(f"t div {window_s}").alias("b")).agg(F.count("*").alias("l"))
    around = buckets.select(c("l").alias("r"), F.explode(F.expr("array(b - 1, b, b + 1)")).alias("b")).groupBy("b").agg(F.sum("r").alias("r"))
    work = checkpointed(buckets.join(around, "b").select("l", (c("l") * c("r").cast("double")).alias("work")))
    rows, total, usual = work.agg(F.sum("l"), F.sum("work"), F.percentile_approx("work", 0.5)).first()
    if not rows or total <= DENSE * rows:
        return False
    most = work.where(c("work") > max(busy_pairs, OUTSTANDING * usual)).agg(F.coalesce(F.sum("work"), F.lit(0.0))).first()[0]
    return most <= DECIDE * (total - most)


def class_links(trades: DataFrame, window_s: int, least: int, busy_pairs: int = BUSY_PAIRS) -> tuple[DataFrame, DataFrame]:
    """(class, near, related, coordinated), some rows a class of wallets with ``least`` pairs or more, and ``members``.

    Sums of the rows of a class tell each of its wallets' related ones and their pairs; ``near`` are classes of its component, all
    of which hang together by them.
    """
    x, who = _classes(trades)
    if _evenly_dense(x, window_s, busy_pairs):
        return cells.class_links(x, who, window_s, least), who
    both = _both_ways(_pairs(x.drop("size"), window_s, least, busy_pairs).unionByName(_own(x, window_s, least)))
    sizes = who.where("wallet = class").select(c("class").alias("near"), "size")
    others = c("size") - (c("class") == c("near")).cast("int")
    return both.join(sizes, "near").select("class", "near", others.alias("related"), (others * c("pairs")).alias("coordinated")), who


def class_lists(trades: DataFrame, window_s: int, least: int, busy_pairs: int = BUSY_PAIRS) -> tuple[DataFrame, DataFrame]:
    """(class, related, coordinated, others) as the sums of ``class_links``, with all related wallets, a class's own too, and ``members``."""
    x, who = _classes(trades)
    if _evenly_dense(x, window_s, busy_pairs):
        rows = cells.class_lists(x, who, window_s, least)
    else:
        both = _both_ways(_pairs(x.drop("size"), window_s, least, busy_pairs).unionByName(_own(x, window_s, least)))
        met = both.join(who.select("wallet", c("class").alias("near"), "size"), "near")
        own = (c("class") == c("near")) & (c("wallet") == c("near"))  # of a class's own wallets all but one are related
        told = F.when(own, 0).otherwise(1)
        rows = met.groupBy("class").agg(F.sum(told).alias("related"), F.sum(told * c("pairs")).alias("coordinated"), F.collect_list("wallet").alias("others"))
    sums = rows.groupBy("class").agg(F.sum("related").alias("related"), F.sum("coordinated").alias("coordinated"), F.flatten(F.collect_list("others")).alias("others"))
    return sums, who


def _both_ways(found: DataFrame) -> DataFrame:
    """(class, near, pairs): each pair of classes from both sides, a class with itself once."""
    there = found.select(c("w1").alias("class"), c("w2").alias("near"), "pairs")
    return there.unionByName(found.where("w1 < w2").select(c("w2").alias("class"), c("w1").alias("near"), "pairs"))


def _shares(x: DataFrame, window_s: int, first: int, dense: int) -> tuple[DataFrame, list[float], float]:
    """``x`` with a ``place``, the most active wallets first, the places at which the rounds are cut, none if one round does, and the others around a trade."""
    buckets = x.groupBy(F.expr(f"t div {window_s}").alias("b")).agg(F.count("*").alias("l"))
    around = buckets.select("l", F.explode(F.expr("array(b - 1, b, b + 1)")).alias("b")).groupBy("b").agg(F.sum("l").alias("r"))
    work, rows = buckets.join(around, "b").agg(F.sum(c("l") * c("r").cast("double")), F.sum("l")).first()
    if not rows or work <= dense * rows:
        return x, [], dense
    active = x.groupBy("wallet").agg(F.floor(8 * F.log2(F.count("*"))).alias("active"))
    x = checkpointed(x.join(active, "wallet").withColumn("place", F.pmod(F.xxhash64("wallet"), F.lit(2**20)) / 2**20 - c("active")).drop("active"))
    share, shares = first * rows / work, []
    while share < 1:
        shares.append(share)
        share += GROWTH ** len(shares) * first * rows / work
    cuts = x.agg(F.percentile_approx("place", shares, 100_000)).first()[0] if shares else []
    return x, sorted(set(cuts)), work / rows


def related_up_to(trades: DataFrame, window_s: int, least: int, most: int, busy_pairs: int = BUSY_PAIRS, first: int = FIRST, dense: int = DENSE) -> DataFrame:
    """(wallet, related): the number of other wallets with ``least`` pairs or more, ``most`` standing for ``most`` and more.

    Every wallet goes on until it has met all others or has ``most`` of them, so the number is exact below ``most``. If more than ``dense``
    others trade around a trade, a wallet meets the others in rounds, of which each has ``GROWTH`` times as many trades as the one before.
    """
    x, who = _classes(trades)
    sizes = who.where("wallet = class").select("wallet", "size")
    x, cuts, around = _shares(x, window_s, first, dense)
    own = _own(x, window_s, least).select(c("w1").alias("wallet"), F.lit(1).alias("_own"))
    state = sizes.join(own, "wallet", "left").select("wallet", F.when(c("_own") == 1, c("size") - 1).otherwise(0).alias("related"))
    weight = sizes.select(c("wallet").alias("w2"), "size")
    if not cuts:
        once = _pairs(x.select("wallet", "t", "n"), window_s, least, busy_pairs).select("w1", "w2")
        new = once.unionByName(once.select(c("w2").alias("w1"), c("w1").alias("w2")))
        state = _added(state, new.join(weight, "w2"))
    rows = x.count() if cuts else 0
    for low, high in zip([None, *cuts], [*cuts, None]) if cuts else []:
        state = checkpointed(state.repartition("wallet"))  # few rows, however many tasks they come from
        still = state.where(c("related") < most).select("wallet")
        wallets = still.count()
        if not wallets:
            break
        share = x.where((F.lit(True) if low is None else c("place") > low) & (F.lit(True) if high is None else c("place") <= high))
        mine = x.join(F.broadcast(still) if wallets <= SENT_ROWS else still, "wallet", "left_semi").select("wallet", "t", "n")
        left, right, others = _sides(mine, window_s)[0], _sides(share.select("wallet", "t", "n"), window_s)[1], share.count()
        tasks = math.ceil(mine.count() * around * others / rows / TASK_ROWS) if others <= SENT_ROWS else 0
        quiet, _, hot = _rows_of_sides(left, right, window_s, least, busy_pairs, "w1 <> w2", tasks)
        new = quiet.unionByName(hot).groupBy("w1", "w2").agg(F.sum("pairs").alias("pairs")).where(c("pairs") >= least)
        state = _added(state, new.join(weight, "w2"))
    found = state.where("related > 0").select(c("wallet").alias("class"), F.least("related", F.lit(most)).cast("long").alias("related"))
    return who.join(found, "class").select("wallet", "related")


def _added(state: DataFrame, new: DataFrame) -> DataFrame:
    more = new.groupBy(c("w1").alias("wallet")).agg(F.sum("size").alias("_more"))
    return state.join(more, "wallet", "left").select("wallet", (c("related") + F.coalesce("_more", F.lit(0))).alias("related"))


def written_out(found: DataFrame, who: DataFrame) -> DataFrame:
    """(w1, w2, pairs) of wallets for pairs of classes: blocks of members meet, and only blocks are shuffled.

    Where all classes are at most a block and their wallets few, members go to all tasks, and the pairs of classes are not shuffled either.
    """
    most, wallets = who.where("size > 1").agg(F.max("size"), F.count("*")).first()
    if not wallets:
        return found
    if most <= BLOCK and wallets <= SENT_ROWS:
        lists = who.where("size > 1").groupBy("class").agg(F.collect_list("wallet").alias("ws"))
        one, two = lists.select(c("class").alias("w1"), c("ws").alias("left")), lists.select(c("class").alias("w2"), c("ws").alias("right"))
        return _expanded(found.join(F.broadcast(one), "w1", "left").join(F.broadcast(two), "w2", "left"))
    part = F.expr(f"pmod(xxhash64(wallet), ceil(size / {BLOCK}))").cast("int")
    many = who.where("size > 1").withColumn("p", part).groupBy("class", "p").agg(F.collect_list("wallet").alias("ws"))
    one = many.select(c("class").alias("w1"), c("p").alias("p1"), c("ws").alias("left"))
    two = many.select(c("class").alias("w2"), c("ws").alias("right"), F.explode(F.sequence(F.lit(0), F.lit(DEALT - 1))).alias("deal"))
    x = found.join(one, "w1", "left").withColumn("deal", F.pmod(F.xxhash64("w1", "p1"), F.lit(DEALT)).cast("int")).join(two, ["w2", "deal"], "left")
    return _expanded(x)


def _expanded(x: DataFrame) -> DataFrame:
    """(w1, w2, pairs) of the wallets ``left`` and ``right``, or of w1 and w2 where they are null."""
    x = x.select("w1", "w2", "pairs", F.explode(F.coalesce("left", F.array("w1"))).alias("a"), F.coalesce("right", F.array("w2")).alias("right"))
    x = x.select("w1", "w2", "pairs", "a", F.explode("right").alias("b")).where((c("w1") < c("w2")) | (c("a") < c("b")))
    return x.select(F.least("a", "b").alias("w1"), F.greatest("a", "b").alias("w2"), "pairs")


def _pairs(trades: DataFrame, window_s: int, least: int, busy_pairs: int) -> DataFrame:
    total: Column = F.sum("pairs").alias("pairs")
    if least <= 1:  # every pair that meets is a result
        left, right = _sides(trades, window_s)
        return _met(*dealt(left, right, ["b"]), window_s, ["b", "part"]).groupBy("w1", "w2").agg(total)
    quiet, _, hot = joined_rows(trades, window_s, least, busy_pairs)
    return quiet.unionByName(hot).groupBy("w1", "w2").agg(total).where(c("pairs") >= least)


def near_pairs(trades: DataFrame, window_s: int, least: int, busy_pairs: int = BUSY_PAIRS) -> DataFrame:
    """(w1, w2, pairs) with ``least`` pairs or more of trades at most ``window_s`` seconds apart."""
    return written_out(*class_pairs(trades, window_s, least, busy_pairs))
