"""DuckDB SQL for the corpus operators that SQL can express."""

from __future__ import annotations

from tradelens.llm.mixing import DIGITS
from tradelens.llm.pii import IBAN_LENGTHS, KINDS
from tradelens.llm.quality import STOP_WORDS

_WORDS = r"list_filter(string_split_regex({t}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

OP3 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, {_WORDS.format(t='t')} AS w,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g),
cov AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM r WHERE c > 1) GROUP BY 1),
m AS (SELECT w.doc_id, len(w)::BIGINT AS n_words,
        length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
        len(l) AS n_lines,
        len(list_filter(w, lambda x: list_contains([{", ".join(f"'{x}'" for x in STOP_WORDS)}], lower(x)))) AS n_stop,
        len(list_filter(l, lambda x: regexp_matches(x, '^\s*[•*-]'))) AS n_bullet,
        len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) AS n_ellipsis
      FROM w LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars / n_words BETWEEN 2.5 AND 12.0 AND n_symbols / n_words <= 0.1 AND n_stop >= 2
  AND n_dup_lines / n_lines <= 0.35 AND n_bullet / n_lines <= 0.9 AND n_ellipsis / n_lines <= 0.3 AS kept FROM b
"""

_SPANS = r"""
SELECT doc_id, {k} AS ord, '{name}' AS kind, s, s + length(v) AS e, {score} + CASE WHEN regexp_matches(
  substr(t, greatest(1, s + 1 - 40)::BIGINT, least(s, 40)::BIGINT), '(?i)(^|[^\p{L}])({context})($|[^\p{L}])') THEN 30 ELSE 0 END AS score FROM (
  SELECT doc_id, t, m[i] AS v, coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0)
    + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS s
  FROM (SELECT doc_id, t, m, p, unnest(range(1, len(m) + 1)) AS i FROM (
    SELECT doc_id, t, regexp_extract_all(t, '{pat}') AS m, regexp_split_to_array(t, '{pat}') AS p FROM d)))
WHERE {valid}
"""
_DIG = "regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN = (
    f"length({_DIG}) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length({_DIG}) + 1), lambda i: "
    f"CASE WHEN (length({_DIG}) - i) % 2 = 0 THEN ({_DIG})[i]::INT "
    f"ELSE ({_DIG})[i]::INT * 2 - CASE WHEN ({_DIG})[i]::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0"
)
_MOD97 = (
    "length(replace(v, ' ', '')) BETWEEN 15 AND 34 AND list_reduce(list_prepend(0, list_transform("
    "string_split(substr(replace(v, ' ', ''), 5) || substr(replace(v, ' ', ''), 1, 4), ''), lambda c: "
    "CASE WHEN c BETWEEN '0' AND '9' THEN c::INT ELSE ascii(c) - 55 END)), "
    "lambda a, c: (a * CASE WHEN c > 9 THEN 100 ELSE 10 END + c) % 97) = 1"
)
_SSN = "v[1:3] NOT IN ('000', '666') AND v[1] <> '9' AND v[5:6] <> '00' AND v[8:] <> '0000'"
_FITS = "CASE length(replace(v, ' ', '')) " + " ".join(
    f"WHEN {n} THEN v[1:2] IN ({', '.join(repr(x) for x in names.split())})" for n, names in IBAN_LENGTHS.items()
) + " ELSE false END"
_DISTINCT = "len(list_distinct(string_split(v, '')))"
_RANDOM = (
    f"regexp_matches(v, '[0-9]') AND ((NOT regexp_matches(v, '[^0-9a-f]') OR NOT regexp_matches(v, '[^0-9A-F]')) AND regexp_matches(v, '[A-Fa-f]') AND {_DISTINCT} >= 9 "
    f"OR regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') AND {_DISTINCT} >= 14)"
)
#: Kind, pattern, validator and score in hundredths; RE2 has no look-around, for which a word edge does in these tables.
_KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true", "90"),
    ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "list_aggregate(list_transform(string_split(v, '.'), lambda p: length(ltrim(p, '0')) <= 3 AND coalesce(try_cast(ltrim(p, '0') AS INT), 0) <= 255), 'bool_and')", "70"),
    ("card", r"[0-9](?:[\x20-]?[0-9])+", _LUHN, "80"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIG}) BETWEEN 9 AND 15", "80"),
    ("iban", r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?\b", _MOD97, f"CASE WHEN {_FITS} THEN 80 ELSE 40 END"),
    ("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", _SSN, "40"),
    ("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", "regexp_matches(split_part(v, '.', 1), 'ImFsZyI|JhbGci|iYWxnI')", "70"),
    ("api_key", r"(?:AKIA|ASIA)[A-Z0-9]{16}|gh[oprsu]_[A-Za-z0-9]{36}|glpat-[A-Za-z0-9_-]{20}|xox[abprs]-[A-Za-z0-9-]{10,}|(?:sk|rk)_live_[A-Za-z0-9]{16,}|AIza[A-Za-z0-9_-]{35}", f"{_DISTINCT} >= 10", "60"),
    ("private_key", r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END (?:[A-Z]+ )?PRIVATE KEY-----)?", "length(v) >= 100 OR contains(v, '-----END')", "90"),
    ("token", r"[A-Za-z0-9_-]{20,}", _RANDOM, "40"),
]
_CONTEXT = {k.name: k.context for k in KINDS}
OP2 = (
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),\nf AS (SELECT * FROM ("
    + "UNION ALL".join(
        _SPANS.replace("{k}", str(k)).replace("{name}", n).replace("{pat}", p).replace("{valid}", v).replace("{score}", x).replace("{context}", _CONTEXT[n])
        for k, (n, p, v, x) in enumerate(_KINDS)
    )
    + """) WHERE ord < 4 OR score >= 60), a AS (SELECT doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip,
  count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY ord, s) FILTER (ord < 4) AS base,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY ord, s) AS spans, string_agg(least(score, 100)::INT, ',' ORDER BY ord, s) AS scores FROM f GROUP BY doc_id)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card,
  coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
FROM d LEFT JOIN a USING (doc_id)
"""
)

OP8 = r"""
WITH l AS (SELECT doc_id, i, trim(s, E' \t\n\x0b\x0c\r') AS s FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS s, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM l WHERE s <> ''),
w AS (SELECT a.doc_id, a.k, a.s || chr(10) || b.s || chr(10) || c.s AS g FROM n a
  JOIN n b ON b.doc_id = a.doc_id AND b.k = a.k + 1 JOIN n c ON c.doc_id = a.doc_id AND c.k = a.k + 2),
r AS (SELECT doc_id, k, row_number() OVER (PARTITION BY g ORDER BY doc_id, k) AS o FROM w),
x AS (SELECT DISTINCT doc_id, k + unnest([0, 1, 2]) AS k FROM r WHERE o > 1),
gone AS (SELECT n.doc_id, n.i FROM n JOIN x USING (doc_id, k)),
raw AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
kept AS (SELECT raw.doc_id, string_agg(raw.s, chr(10) ORDER BY raw.i) FILTER (gone.i IS NULL) AS text, count(gone.i) AS n
  FROM raw LEFT JOIN gone ON gone.doc_id = raw.doc_id AND gone.i = raw.i GROUP BY 1)
SELECT d.doc_id, coalesce(kept.n, 0)::BIGINT AS n_cut_lines,
  CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(kept.text, '')) END AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id)
"""

# CRC-32 by its rule: a table of 256 remainders, made of eight steps each, then one step a byte
OP9 = """
WITH crc AS (SELECT list_transform(range(256), lambda k: list_reduce([k, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS steps),
d AS (SELECT doc_id, coalesce(source, '') AS source, source IS NULL AS none, encode(coalesce(text, '')) AS b FROM documents),
e AS (SELECT d.*, octet_length(b)::BIGINT + 1 AS size, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(b), '..'),
    lambda x: ('0x' || x)::BIGINT)), lambda c, x: xor(c // 256, steps[(xor(c % 256, x) + 1)::INT])), 4294967295)::BIGINT AS crc FROM d, crc),
f0 AS (SELECT *, md5(concat_ws(':', '42', doc_id, crc, size)) AS h FROM e),
f AS (SELECT *, (row_number() OVER (PARTITION BY source, none ORDER BY h, doc_id, crc, size) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY source, none) AS part FROM f0),
g AS (SELECT *, row_number() OVER (ORDER BY part, source, none, h, doc_id, crc, size) - 1 AS position, count(*) OVER () AS n FROM f)
SELECT doc_id, size, crc AS text_crc32, 'rows' AS law, (position * 8 // n)::INT AS shard, position - ((position * 8 // n) * n + 7) // 8 AS slot,
  NULL::INT AS grown_shard, CASE WHEN NOT none THEN source END AS source FROM g
"""

OP10 = rf"""
WITH d AS (SELECT doc_id, source, len({_WORDS.format(t="coalesce(text, '')")})::BIGINT AS n,
        md5('42:' || doc_id) AS h FROM documents),
s AS (SELECT source, sum(n) AS t FROM d GROUP BY 1),
a AS (SELECT round(greatest(0, 1 - ln(1.5) / ln(max(t) / min(t))), {DIGITS}) AS a, max(t) AS top, sum(t) AS every FROM s),
r AS (SELECT source, t, pow((top / every) / (t / every), 1 - a) AS r FROM s, a),
c AS (SELECT d.*, r, t, sum(n) OVER (PARTITION BY d.source ORDER BY h RANGE UNBOUNDED PRECEDING) AS cum FROM d JOIN r USING (source)),
e AS (SELECT *, floor(r)::INT + CASE WHEN r > floor(r) AND cum <= (r - floor(r)) * t THEN 1 ELSE 0 END AS k FROM c)
SELECT doc_id, source, epoch::INT AS epoch, md5('42:' || epoch || ':' || doc_id) AS order_key, n AS mix_tokens
FROM (SELECT *, unnest(range(k)) AS epoch FROM e)
"""

OP11 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS part, {_WORDS.format(t="coalesce(text, '')")} AS w FROM documents),
f AS (SELECT doc_id, part, (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT
    + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
    + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask FROM d),
l AS (SELECT doc_id, bool_or(quality = 1)::INT AS good, bool_or(toxic = 1)::INT AS toxic FROM labels GROUP BY 1),
c AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT p.x || q.x || r.x || s.x || u.x AS filter_order FROM x p JOIN x q ON q.x <> p.x JOIN x r ON r.x NOT IN (p.x, q.x)
  JOIN x s ON s.x NOT IN (p.x, q.x, r.x) JOIN x u ON u.x NOT IN (p.x, q.x, r.x, s.x)),
b AS (SELECT filter_order, step, 1 << (ascii(filter_order[step]) - 65) AS own,
    coalesce(list_sum(list_transform(range(1, step), lambda j: 1 << (ascii(filter_order[j]) - 65))), 0)::INT AS before
  FROM (SELECT filter_order, unnest(range(1, 6)) AS step FROM o)),
g AS (SELECT part, filter_order, step::INT AS step, own, coalesce(sum(n) FILTER (mask & (before | own) = 0), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (mask & before = 0 AND mask & own > 0), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (mask & before > 0 AND mask & own > 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (mask & before = 0 AND mask & own > 0), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & own > 0), 0)::BIGINT AS toxic_lost FROM c, b GROUP BY 1, 2, 3, 4)
SELECT * EXCLUDE (own), (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM g
"""

_NGRAMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP12 = rf"""
WITH crc AS (SELECT list_transform(range(256), lambda k: list_reduce([k, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS steps),
d AS (SELECT row_number() OVER () AS k, doc_id, {_NGRAMS} AS w FROM documents),
e AS (SELECT k, unnest(w) AS w FROM d), y AS (SELECT unnest({_NGRAMS}) AS w FROM benchmark),
v AS (SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(w)), '..'), lambda x: ('0x' || x)::BIGINT)),
    lambda c, x: xor(c // 256, steps[(xor(c % 256, x) + 1)::INT])), 4294967295) % 10000 AS b FROM (SELECT DISTINCT w FROM (SELECT w FROM e UNION ALL SELECT w FROM y)), crc),
s AS (SELECT b, count(*) AS n FROM e JOIN v USING (w) GROUP BY 1), t AS (SELECT b, count(*) AS n FROM y JOIN v USING (w) GROUP BY 1),
g AS (SELECT v.w, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM e) + 10000)::DOUBLE
    / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM y) + 10000)::DOUBLE)))::BIGINT AS gain FROM v LEFT JOIN s USING (b) LEFT JOIN t USING (b)),
a AS (SELECT k, sum(gain)::BIGINT AS weight FROM e JOIN g USING (w) GROUP BY 1),
f AS (SELECT k, doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0)
    + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM d LEFT JOIN a USING (k)),
r AS (SELECT k, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () * 10 // 100 AS most FROM f WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= most THEN place END AS rank FROM f LEFT JOIN r USING (k)
"""


def llm_oracle() -> dict[str, str]:
    return {"op2_pii": OP2, "op3_quality": OP3, "op8_line_dedup": OP8, "op9_sharding": OP9, "op10_mixing": OP10, "op11_filter_audit": OP11, "op12_resampling": OP12}
