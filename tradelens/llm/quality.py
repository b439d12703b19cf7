"""Rule-based quality filter: a threshold table compiled into one projection.

Every metric is a built-in Spark expression over the whole text, so the filter is a narrow,
shuffle-free map. Rules are rows of ``(name, metric, least, most)``; ``compile_rules`` turns the
table into a single boolean column, so changing a threshold never changes the plan's shape.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradelens.llm.common import WORD_SPACE, restored, sheltered, text_or_empty, words_of

#: Frequent function words of the four corpus languages.
STOP_WORDS = (
    # English
    "the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "was", "with", "be", "by",
    "on", "not", "he", "this", "are", "or", "his", "from", "at", "which", "but", "have", "an",
    # German
    "der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im",
    "dem", "nicht", "ein", "eine", "als", "auch", "es",
    # French
    "le", "la", "les", "de", "du", "et", "à", "un", "une", "en", "que", "qui", "dans", "est", "pour",
    "au", "ce", "il", "ne", "se", "pas", "par", "sur", "avec",
    # Spanish
    "el", "los", "las", "y", "por", "con", "no", "para", "su", "lo", "del", "al", "como", "una",
)

SYMBOLS = "#*$%&|<>"


class Rule(NamedTuple):
    """``least <= metric <= most``; an open side is None."""

    name: str
    metric: str
    least: float | None
    most: float | None


#: Thresholds of the method, beside the base condition on length and repetition.
RULES: tuple[Rule, ...] = (
    Rule("length", "n_words", 50, None),
    Rule("word_length", "mean_word_chars", 2.5, 12.0),
    Rule("symbols", "symbol_ratio", None, 0.1),
    Rule("stop_words", "n_stop_words", 2, None),
    Rule("dup_lines", "dup_line_ratio", None, 0.35),
    Rule("bullets", "bullet_line_ratio", None, 0.9),
    Rule("ellipses", "ellipsis_line_ratio", None, 0.3),
)


def compile_rules(rules: Sequence[Rule], metrics: dict[str, Column]) -> tuple[Column, Column]:
    """(verdict, names of failed rules) as two columns of one projection."""
    failed = []
    for rule in rules:
        value, bad = metrics[rule.metric], F.lit(False)
        if rule.least is not None:
            bad = bad | (value < F.lit(rule.least))
        if rule.most is not None:
            bad = bad | (value > F.lit(rule.most))
        failed.append(F.when(bad, F.lit(rule.name)))
    names = F.array_compact(F.array(*failed))
    return F.size(names) == 0, names


def _count_of(text: Column, characters: str) -> Column:
    """How often any of the ASCII ``characters`` occurs: the bytes that go when they are replaced by nothing."""
    bare = text
    for c in characters:
        bare = F.replace(bare, F.lit(c))
    return (F.octet_length(text) - F.octet_length(bare)).cast("long")


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") / whole).otherwise(F.lit(0.0))


def quality_rules(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """``docs`` with a struct column ``quality`` of metrics, verdict and failed rules.

    A null or empty text has no words and fails the length rule. Repeated rows are judged alike, one
    row each; other columns pass through untouched, and an input column named ``quality`` is replaced.
    An empty table gives an empty result. Work per text is n log n in its words (one sort of its
    three-word windows), so long texts need no cap.
    Windows are equal if their 64-bit hashes are, within one text.
    """
    rows, inner = sheltered(docs, "quality")
    keep = list(inner.values())
    one = rows.select(*keep, text_or_empty(inner[text]).alias("_t"))
    two = one.select(
        *keep, "_t", words_of(F.col("_t")).alias("_w"),
        F.filter(F.split("_t", "\n"), lambda s: F.btrim(s, F.lit(WORD_SPACE)) != "").alias("_l"),
    )
    # hashes of the three-word windows; only texts in which one recurs have them sorted, with their places,
    # so that equal windows become neighbours
    window = lambda i: F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2))
    places = F.transform(F.sequence(F.lit(0), F.size("_w") - 3), window)
    hashed = two.withColumn("_h", F.when(F.size("_w") >= 3, places))
    recurs = F.size("_h") > F.size(F.array_distinct("_h"))
    pairs = F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    three = hashed.withColumn("_g", F.when(recurs, pairs))
    same = lambda x, j: F.coalesce(F.get("_g", j)["h"] == x["h"], F.lit(False))
    four = three.withColumn(
        "_r",
        F.sort_array(F.transform(F.filter("_g", lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"])),
    )
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("at"))
    step = lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i - a["at"])).alias("n"), i.alias("at"))
    length, lines = F.size("_w").cast("long"), F.size("_l").cast("long")
    stop = set(STOP_WORDS)
    share = lambda pattern: F.size(F.filter("_l", lambda s: s.rlike(pattern))).cast("long")
    five = four.select(
        *keep,
        length.alias("n_words"),
        (F.char_length("_t") - _count_of(F.col("_t"), WORD_SPACE)).alias("word_chars"),
        _count_of(F.col("_t"), SYMBOLS).alias("n_symbols"),
        (lines - F.size(F.array_distinct("_l"))).alias("n_dup_lines"),
        F.coalesce(F.aggregate("_r", start, step, lambda a: a["n"]), F.lit(0)).cast("long").alias("n_repeat_words"),
        lines.alias("n_lines"),
        F.size(F.filter("_w", lambda w: F.lower(w).isin(*sorted(stop)))).cast("long").alias("n_stop_words"),
        share(r"^\s*[•*-]").alias("n_bullet_lines"),
        share(r"(\.\.\.|…)\s*$").alias("n_ellipsis_lines"),
    )
    c = F.col
    metrics = {
        "n_words": c("n_words"),
        "mean_word_chars": _ratio(c("word_chars"), c("n_words")),
        "symbol_ratio": _ratio(c("n_symbols"), c("n_words")),
        "n_stop_words": c("n_stop_words"),
        "dup_line_ratio": _ratio(c("n_dup_lines"), c("n_lines")),
        "bullet_line_ratio": _ratio(c("n_bullet_lines"), c("n_lines")),
        "ellipsis_line_ratio": _ratio(c("n_ellipsis_lines"), c("n_lines")),
    }
    base = (c("n_words") < 50) | (100 * c("n_repeat_words") > 50 * c("n_words"))
    passed, names = compile_rules(rules, metrics)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stop_words"]
    verdict = F.struct(*counts, base.alias("base_failed"), (~base & passed).alias("kept"), names.alias("failed_rules"))
    # one-row generator: without it a filter on the verdict would be pushed below these projections, with all
    # metrics written out inside it once for each use
    return five.select(*keep, F.explode(F.array(verdict)).alias("_q")).select(*restored(inner), F.col("_q").alias("quality"))


def passing(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns of ``docs``."""
    return quality_rules(docs, rules, text).where("quality.kept").select(*[F.col(f"`{c}`") for c in docs.columns])
