"""Global removal of repeated passages by overlapping three-line windows.

Three consecutive non-blank lines are hashed to one key. The first occurrence of a key in
``(doc_id, text, line)`` order stays; every later one marks its three lines, overlapping marks are merged
and the marked lines are cut out. Rows are told apart by their doc_id and a hash of their text, so that texts that
share a doc_id do not get each other's marks. The first aggregate combines on the map side and only keys of
repeated windows leave it, so a passage shared by a third of the corpus adds one row a task there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradelens.llm.common import WORD_SPACE, restored, sheltered, text_or_empty

WINDOW = 3


def _full_lines(text: Column) -> Column:
    """Array of (i, s): number and bare text of each non-blank line."""
    bare = F.transform(
        F.split(text, "\n"), lambda s, i: F.struct(i.alias("i"), F.btrim(s, F.lit(WORD_SPACE)).alias("s"))
    )
    return F.filter(bare, lambda x: x["s"] != "")


def line_windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, of, at, key): each window of three consecutive non-blank lines; ``of`` is the hash of its text and
    ``at`` counts those lines."""
    lines = docs.where(F.col(f"`{doc_id}`").isNotNull()).select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.xxhash64(f"`{text}`").alias("of"), _full_lines(text_or_empty(f"`{text}`")).alias("l")
    )
    window = lambda x, k: F.struct(
        k.alias("at"),
        F.unhex(F.sha2(F.concat_ws("\n", x["s"], F.get("l", k + 1)["s"], F.get("l", k + 2)["s"]), 256)).alias("key"),
    )
    some = lines.where(F.size("l") >= WINDOW)
    windows = F.transform(F.slice("l", F.lit(1), F.size("l") - (WINDOW - 1)), window)
    return some.select("doc_id", "of", F.explode(windows).alias("w")).select("doc_id", "of", "w.at", "w.key")


def repeated_windows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, of, at) of every window that occurred before."""
    windows = line_windows(docs, doc_id, text)
    first = (
        windows.groupBy("key")
        .agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "of", "at")).alias("first"))
        .where("n > 1")
        .select("key", "first")
    )
    # a shuffled join, so that AQE can split the side of a hot key
    return windows.join(first.hint("merge"), "key").where(F.struct("doc_id", "of", "at") > F.col("first")).select("doc_id", "of", "at")


def line_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with repeated passages cut out of ``text`` and a column ``n_cut_lines``.

    Lines are compared without surrounding white space and blank lines neither count nor go. Texts of
    fewer than three non-blank lines, empty and null texts stay as they are. A repetition inside one
    document counts as well. Rows without a doc_id stay untouched; repeated rows (one doc_id and text) are cut
    alike and do not count as occurrences of each other, different texts under one doc_id do, in the order of their hashes. An input column
    ``n_cut_lines`` is replaced; an empty table gives an empty result.
    """
    found = (
        repeated_windows(docs, doc_id, text)
        .groupBy(F.col("doc_id").alias("_cut_id"), F.col("of").alias("_cut_of"))
        .agg(F.collect_set("at").alias("_at"))
    )
    rows, inner = sheltered(docs, "n_cut_lines")
    body = F.col(inner[text])
    joined = rows.join(found, (F.col(inner[doc_id]) == F.col("_cut_id")) & (F.xxhash64(inner[text]) == F.col("_cut_of")), "left")
    # the lines of a cut text are needed twice, so they are columns of their own
    marked = joined.withColumns(
        {"_lines": F.when(F.col("_at").isNotNull(), F.split(body, "\n")), "_full": F.when(F.col("_at").isNotNull(), _full_lines(body))}
    )
    ordinals = F.array_distinct(F.flatten(F.transform("_at", lambda a: F.array(a, a + 1, a + 2))))
    gone = F.transform(ordinals, lambda o: F.get("_full", o)["i"])
    marked = marked.withColumn("_gone", F.array_compact(gone))
    rest = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), F.col("_gone"))
    new = F.when(F.col("_at").isNull(), body).otherwise(F.array_join(F.transform(rest, lambda i: F.get("_lines", i)), "\n"))
    return marked.select(
        *[new.alias(text) if c == text else column for c, column in zip(inner, restored(inner), strict=True)],
        F.when(F.col("_at").isNull(), F.lit(0)).otherwise(F.size("_gone")).cast("long").alias("n_cut_lines"),
    )
