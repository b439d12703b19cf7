"""Personal data and secrets: regular expressions propose, checksums and structure confirm, context words score.

Everything is a projection of built-in functions. Java's expressions give no positions through Spark,
but ``split`` and ``regexp_extract_all`` walk the text alike: the pieces between the matches and the
matches themselves alternate, so running sums of their lengths are the places, in code points.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tradelens.llm.common import restored, sheltered, text_or_empty


class Kind(NamedTuple):
    """A proposer: SQL for its cheap gate, its pattern, SQL for its validator and base score on ``v``."""

    name: str
    gate: str
    pattern: str
    valid: str
    score: str
    context: str
    base: bool


_DIGITS = "regexp_replace(v, '[^0-9]', '')"
_IP_PART = (
    "length(ltrim('0', p)) <= 3 and coalesce(try_cast(nullif(ltrim('0', p), '') as int), 0) <= 255"
)
_MOD97 = (
    "aggregate(split(concat(substr(replace(v, ' ', ''), 5), substr(replace(v, ' ', ''), 1, 4)), ''), 0, "
    "(a, c) -> case when c = '' then a when c between '0' and '9' then (a * 10 + ascii(c) - 48) % 97 "
    "else (a * 100 + ascii(c) - 55) % 97 end) = 1"
)
#: Lengths of account numbers by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI NL", 19: "SI", 20: "AT EE LT LU", 21: "CH HR LI LV", 22: "BG DE GB IE", 23: "AE", 24: "AD CZ ES RO SA SE SK",
    25: "PT", 26: "IS TR", 27: "FR GR IT MC SM", 28: "CY HU PL", 31: "MT",
}
_COUNTRY_FITS = "case length(replace(v, ' ', '')) " + " ".join(
    f"when {n} then substr(v, 1, 2) in ({', '.join(repr(x) for x in names.split())})" for n, names in IBAN_LENGTHS.items()
) + " else false end"
_DISTINCT = "size(array_distinct(split(v, '')))"
#: Random strings: many different characters, digits among them, and either hexadecimal or of both cases.
_RANDOM = (
    f"v rlike '[0-9]' and ((not v rlike '[^0-9a-f]' or not v rlike '[^0-9A-F]') and v rlike '[A-Fa-f]' and {_DISTINCT} >= 9 "
    f"or v rlike '[a-z]' and v rlike '[A-Z]' and {_DISTINCT} >= 14)"
)
#: ``"alg"`` in base 64, by its place among three bytes: the head of every token of this kind names an algorithm.
_JWT_HEAD = "split(v, '[.]')[0] rlike 'ImFsZyI|JhbGci|iYWxnI'"

#: Fixed patterns. Possessive quantifiers and look-behinds give the leftmost matches of the plain forms in
#: linear time and constant stack: the character after each such run can never continue it.
KINDS: tuple[Kind, ...] = (
    Kind(
        "email", "contains({t}, '@')",
        r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "true", "0.9D", "e-?mail|mail|contact|kontakt|correo|courriel", True,
    ),
    Kind(
        "ip", "contains({t}, '.') and {d}",
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        f"forall(split(v, '[.]'), p -> {_IP_PART})", "0.7D", r"ip|address|host|server|adresse|dirección", True,
    ),
    Kind(
        "card", "{d}", r"[0-9](?:[\x20-]?[0-9])++",
        f"length({_DIGITS}) between 13 and 19 and luhn_check({_DIGITS})", "0.8D",
        "card|visa|mastercard|credit|debit|karte|carte|tarjeta", True,
    ),
    Kind(
        "phone", "contains({t}, '+')", r"\+[0-9](?:[\x20().-]*+[0-9])++",
        f"length({_DIGITS}) between 9 and 15", "0.8D", "phone|tel|call|fax|mobile|telefon|teléfono|téléphone", True,
    ),
    Kind(
        "iban", "{d}", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
        f"length(replace(v, ' ', '')) between 15 and 34 and {_MOD97}", f"case when {_COUNTRY_FITS} then 0.8D else 0.4D end", "iban|bank|account|konto|compte|cuenta", False,
    ),
    Kind(
        "ssn", "contains({t}, '-') and {d}", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
        "substr(v, 1, 3) not in ('000', '666') and substr(v, 1, 1) <> '9' and substr(v, 5, 2) <> '00' and substr(v, 8) <> '0000'",
        "0.4D", "ssn|social security|sozialversicherung|sécurité sociale|seguridad social", False,
    ),
    Kind(
        "jwt", "contains({t}, 'eyJ')", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", _JWT_HEAD, "0.7D",
        "token|jwt|bearer|authorization|session|cookie", False,
    ),
    Kind(
        "api_key", "{d}",
        r"(?:AKIA|ASIA)[A-Z0-9]{16}|gh[oprsu]_[A-Za-z0-9]{36}|glpat-[A-Za-z0-9_-]{20}|xox[abprs]-[A-Za-z0-9-]{10,}|(?:sk|rk)_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}",
        f"{_DISTINCT} >= 10", "0.6D", "key|token|secret|api|access|credential|credentials", False,
    ),
    Kind(
        "private_key", "contains({t}, 'PRIVATE KEY-----')",
        r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END (?:[A-Z]+ )?PRIVATE KEY-----)?",
        "length(v) >= 100 or contains(v, '-----END')", "0.9D", "key|ssh|tls|certificate", False,
    ),
    Kind(
        "token", "{d}", r"[A-Za-z0-9_-]{20,}", _RANDOM, "0.4D",
        "token|secret|password|passwd|pwd|key|apikey|auth|bearer|credential|credentials|passwort|contraseña|mot de passe", False,
    ),
)

#: A span of the method's own kinds counts from this score on; the base kinds always count. Account numbers of an
#: unknown country or length, social security numbers and random strings count only with a context word near.
MIN_SCORE = 0.6
#: Code points before a span in which a context word counts, and what it adds.
CONTEXT_CHARS, CONTEXT_BONUS = 40, 0.3
#: Matches before a span that its context can reach: each takes five code points at least.
_REACH = CONTEXT_CHARS // 5


#: Running sums of the array ``_c``: each pass adds what stands twice as far back.
_RUNNING = (
    "aggregate(sequence(0, cast(ceil(log2(size(_c))) as int)), _c, (a, k) -> "
    "transform(a, (x, i) -> x + if(i >= shiftleft(1, k), coalesce(get(a, i - shiftleft(1, k)), 0), 0)))"
)
#: The end of the text before match ``x.i``, put together from the ends of pieces and matches.
_BEFORE = (
    f"right(array_join(transform(sequence(greatest(x.i - {_REACH}, 0), x.i), j -> concat(if(j > greatest(x.i - {_REACH}, 0), get(_me, j - 1), ''), get(_pe, j))), ''), {CONTEXT_CHARS})"
)


def find_pii(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS, text: str = "text") -> DataFrame:
    """``docs`` with ``pii``: array of (kind, start, end, text, score, base), by kind as listed, then start.

    Places count code points, the end is exclusive. A null or empty text has no spans; texts are searched
    whole, whatever their length; repeated rows are searched alike. Other columns pass through and an input
    column named ``pii`` is replaced. An empty table gives an empty result. Work grows with the text and with
    n log n of its matches.
    """
    rows, inner = sheltered(docs, "pii")
    out = rows.select(*inner.values(), text_or_empty(inner[text]).alias("_t"))
    out = out.withColumn("_d", F.col("_t").rlike("[0-9]"))
    for kind in kinds:
        # matches first, pieces and places only where there are any
        gate = F.expr(kind.gate.format(t="_t", d="_d"))
        out = out.withColumn("_m", F.when(gate, F.regexp_extract_all("_t", F.lit(kind.pattern), F.lit(0))))
        out = out.withColumn("_p", F.when(F.size("_m") > 0, F.split("_t", kind.pattern, -1)))
        # a piece and the match before it, whose running lengths are the places; the ends of both for the context
        some = F.col("_p").isNotNull()
        steps = "transform(_m, (x, i) -> char_length(_p[i]) + if(i > 0, char_length(_m[i - 1]), 0))"
        out = out.withColumn("_c", F.when(some, F.expr(steps))).withColumn("_c", F.expr(_RUNNING))
        ends = lambda name: F.when(some, F.transform(name, lambda x: F.right(x, F.lit(CONTEXT_CHARS))))
        out = out.withColumns({"_pe": ends("_p"), "_me": ends("_m")})
        placed = "transform(_m, (x, i) -> named_struct('i', i, 's', _c[i], 'e', _c[i] + char_length(x), 'v', x))"
        of_span = lambda sql: re.sub(r"\bv\b", "x.v", sql)
        out = out.withColumn("_s", F.when(some, F.expr(f"filter({placed}, x -> {of_span(kind.valid)})")))
        near = f"{_BEFORE} rlike '(?iu)(?<![\\\\p{{L}}])({kind.context})(?![\\\\p{{L}}])'"
        score = f"least(1D, {of_span(kind.score)} + case when {near} then {CONTEXT_BONUS}D else 0D end)"
        spans = (
            f"transform(_s, x -> named_struct('kind', '{kind.name}', 'start', x.s, 'end', x.e, "
            f"'text', x.v, 'score', {score}, 'base', {str(kind.base).lower()}))"
        )
        found = F.expr(spans if kind.base else f"filter({spans}, y -> y.score >= {MIN_SCORE}D)")
        out = out.withColumn(f"_{kind.name}", found).drop("_m", "_p", "_s", "_c", "_pe", "_me")
    empty = F.expr("cast(array() as array<struct<kind:string,start:int,end:int,text:string,score:double,base:boolean>>)")
    return out.select(*restored(inner), F.concat(*[F.coalesce(f"_{k.name}", empty) for k in kinds]).alias("pii"))


def pii_digest(found: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """Counts of the base kinds, digests of all spans and their scores in hundredths, per row of ``find_pii``."""
    written = lambda xs: F.array_join(
        F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ","
    )
    base = F.filter("pii", lambda x: x["base"])
    return found.select(
        "doc_id",
        *[
            F.expr(f"cast(size(filter(pii, x -> x.kind = '{k.name}')) as bigint) as n_{k.name}")
            for k in kinds
            if k.base
        ],
        F.sha2(written(base), 256).alias("base_sha256"),
        written(F.col("pii")).alias("spans"),
        F.array_join(F.transform("pii", lambda x: F.round(x["score"] * 100).cast("int").cast("string")), ",").alias("scores"),
    )
