"""Filter interaction audit: what every filter removes at every place of every order of the filters.

A document matters only through the set of filters it fails, so documents are reduced to cells (part, mask of
failed filters) with three weights: documents, good ones and toxic ones. Each cell then folds over a constant
array of all orders; the fold gives one weighted struct an order and step, and the structs of all cells of a part
are added up element by element. Work on texts is one projection; after it only narrow rows are shuffled.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tradelens.llm.common import text_or_empty, words_of

#: The filters in the order of their bits; the last one compares documents, the others judge one text.
FILTERS = "ABCDE"
#: What a step of an order counts.
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def text_mask(text: Column, words: Column) -> Column:
    """Bits of the failed filters A to D: few words, repetitive words, many capitals, markup symbols."""
    capitals = F.octet_length(F.regexp_replace(text, "[^A-Z]+", ""))
    failed = [
        F.size(words) < 100,
        100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        100 * capitals > 10 * F.char_length(text),
        text.rlike(r"[#$%&*|]"),
    ]
    return sum((F.when(x, 1 << k).otherwise(0) for k, x in enumerate(failed)), F.lit(0))


def audit_cells(docs: DataFrame, labels: DataFrame, text: str = "text", part: str = "lang") -> DataFrame:
    """(part, mask, n, good, toxic): documents by part and set of failed filters.

    Texts are compared by SHA-256. Equal documents are counted before anything of a text's group comes together,
    so a group of copies of any size is a few rows.
    """
    one = docs.select("doc_id", F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text_or_empty(text).alias("_t"))
    two = one.select("doc_id", "part", "_t", words_of(F.col("_t")).alias("_w"))
    judged = two.select("doc_id", "part", F.unhex(F.sha2("_t", 256)).alias("digest"), text_mask(F.col("_t"), F.col("_w")).alias("mask"))
    is_one = lambda name: F.coalesce(F.max((F.col(name) == 1).cast("int")), F.lit(0)).alias(name)
    marks = labels.where("doc_id is not null").groupBy("doc_id").agg(is_one("quality"), is_one("toxic"))
    x = judged.join(marks, "doc_id", "left").fillna(0, ["quality", "toxic"])
    alike = ["digest", "mask", "part", "quality", "toxic"]
    once = x.groupBy("doc_id", *alike).agg(F.count("*").alias("n"))
    groups = once.groupBy(*alike).agg(
        F.sum("n").alias("n"), F.min("doc_id").alias("first"), F.min_by("n", "doc_id").alias("n_first"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("n_null"),
    )
    least = F.min("first").over(Window.partitionBy("digest"))
    firsts = groups.withColumn("least", least).withColumn("kept_first", F.when(F.col("first") == F.col("least"), F.col("n_first")).otherwise(0))
    copies = F.col("n") - F.col("n_null") - F.col("kept_first")
    both = firsts.select("part", "quality", "toxic", F.explode(F.array(
        F.struct(F.col("mask"), (F.col("n") - copies).alias("n")), F.struct((F.col("mask") + 16).alias("mask"), copies.alias("n")),
    )).alias("x"))
    return both.groupBy("part", "x.mask").agg(
        F.sum("x.n").alias("n"), F.sum(F.col("x.n") * F.col("quality")).alias("good"), F.sum(F.col("x.n") * F.col("toxic")).alias("toxic")
    )


def fold_orders(cells: DataFrame, filters: str = FILTERS) -> DataFrame:
    """(part, filter_order, step, filter, *MEASURES, shapley) from cells of failed filters, for all orders."""
    names = ["".join(p) for p in permutations(filters)]
    size = len(filters)
    orders = F.lit([[filters.index(f) for f in name] for name in names])
    weight = lambda when, name: F.when(when, F.col(name)).otherwise(F.lit(0)).cast("long")
    mask = F.col("mask")
    kind = ", ".join(f"{m}: bigint" for m in MEASURES)
    nothing = F.struct(F.lit(False).alias("gone"), F.array().cast(f"array<struct<{kind}>>").alias("out"))

    def step(state: Column, bit: Column) -> Column:
        fails = F.get(F.lit([1 << k for k in range(size)]), bit).bitwiseAND(mask) != 0
        removed = ~state["gone"] & fails
        row = F.struct(
            weight(~state["gone"] & ~fails, "n").alias("kept"), weight(removed, "n").alias("removed"),
            weight(state["gone"] & fails, "n").alias("redundant"),
            weight(mask == F.get(F.lit([1 << k for k in range(size)]), bit), "n").alias("unique_fails"),
            weight(removed, "good").alias("good_lost"), weight(removed, "toxic").alias("toxic_lost"),
        )
        return F.struct((state["gone"] | fails).alias("gone"), F.concat(state["out"], F.array(row)).alias("out"))

    folded = F.flatten(F.transform(orders, lambda order: F.aggregate(order, nothing, step, lambda s: s["out"])))
    every = cells.select("part", F.posexplode(folded).alias("at", "x"))
    sums = every.groupBy("part", "at").agg(*[F.sum(f"x.{m}").alias(m) for m in MEASURES])
    placed = sums.select(
        "part", F.get(F.lit(names), F.expr(f"cast(at div {size} as int)")).alias("filter_order"),
        (F.col("at") % size + 1).cast("int").alias("step"), *MEASURES,
    ).withColumn("filter", F.substring(F.col("filter_order"), F.col("step"), F.lit(1)))
    return placed.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "filter")))


def filter_audit(docs: DataFrame, labels: DataFrame, text: str = "text", part: str = "lang") -> DataFrame:
    """What each of five filters does at each step of each of their 120 orders, for every part of ``docs``.

    A null text is the empty text and fails A; it has no words, so it passes B. A null part is the part of the
    empty name. A document fails E if a smaller doc_id has its text; one without doc_id, or one whose doc_id is the
    least of its text, passes. Repeated rows count as often as they occur. A document is good (toxic) if any row
    of ``labels`` with its doc_id says so; without a label it is neither. Other columns are not read, so their
    names do not matter. An empty table gives no parts and no rows.
    """
    return fold_orders(audit_cells(docs, labels, text, part))
