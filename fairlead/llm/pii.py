"""Personal data in texts: patterns propose spans, checksums confirm them, context words adjust the score.

Every kind has a pattern, a validator and a base score; context words in the 40 characters before or after a span (as far as the
neighbouring matches of its kind at most) add to its score, and spans of at least THRESHOLD stay. E-mail, IP, card (Luhn) and phone spans that pass their validator
start above the threshold, so context only raises their score; IBANs are confirmed by mod-97; national ids
stand only beside a context word. Matching is leftmost and non-overlapping for each kind, and a match that fails
validation isn't retried.

Only built-in functions are used. A position is the sum of the code points of what lies before: `split` by the
same pattern gives the gaps between matches. The patterns are possessive and anchored where that can't
change a match, so that a long run costs linear time.

Defined results: a null or empty text has no spans; repeated rows are treated alike; an empty table gives no
rows; other columns are ignored, whatever their names. Texts are read whole, however long; null doc_ids are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairlead.functions.tables import load

THRESHOLD = 0.6
CONTEXT = 40

#: Kind, Java pattern, plain pattern, base score, context words.
KINDS = (
    ("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", 0.8, "mail|contact|write|reach|inbox|correo|courriel"),
    ("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", 0.6, "ip|server|host|address|login|network"),
    ("card", r"[0-9](?:[\x20-]?[0-9])++", r"[0-9]([\x20-]?[0-9])+", 0.7, "card|visa|credit|payment|amex|mastercard|karte|tarjeta|carte"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", 0.6, "phone|call|tel|mobile|fax|whatsapp|telefon"),
    ("iban", r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", 0.7, "iban|account|bank|konto|cuenta|compte|swift"),
    ("id", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", 0.4, "ssn|social|security|passport|tax|national id|identity"),
)
BASE = ("email", "ip", "card", "phone")
PART = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"

#: SQL over a match v; both Spark and DuckDB read these two.
IP_VALID = f"regexp_like(v, '^{PART}[.]{PART}[.]{PART}[.]{PART}$')"
DIGITS = "translate(v, ' -().+', '')"

LUHN = f"""(length({DIGITS}) BETWEEN 16 AND 19 AND CASE WHEN length({DIGITS}) BETWEEN 16 AND 19 THEN
  aggregate(transform(sequence(1, length({DIGITS})), i -> cast(substr({DIGITS}, length({DIGITS}) + 1 - i, 1) AS int) * (2 - i % 2)), 0, (a, x) -> a + x - IF(x > 9, 9, 0)) % 10 = 0 ELSE false END)"""
MOD97 = """(aggregate(transform(sequence(1, length(v)), i -> substr(concat(substr(v, 5), substr(v, 1, 4)), i, 1)), 0,
  (a, c) -> IF(c >= 'A', (a * 100 + ascii(c) - 55) % 97, (a * 10 + ascii(c) - 48) % 97)) = 1)"""
VALID = {"email": "true", "ip": IP_VALID, "card": LUHN, "phone": f"length({DIGITS}) BETWEEN 8 AND 15", "iban": MOD97, "id": "true"}


def _quote(pattern: str) -> str:
    return "r'" + pattern + "'"


def find(docs: DataFrame) -> DataFrame:
    """docs' doc_id with n_<kind>, base_sha256, spans (kind:start:end, comma-joined) and scores, one row for each row."""
    out = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    for kind, pattern, *_ in KINDS:
        out = out.withColumn(f"m_{kind}", F.expr(f"regexp_extract_all(text, {_quote(pattern)}, 0)"))
    gaps = [F.expr(f"CASE WHEN size(m_{k}) > 0 THEN split(text, {_quote(p)}, -1) END").alias(f"g_{k}") for k, p, *_ in KINDS]
    out = out.select("doc_id", *(f"m_{k}" for k, *_ in KINDS), *gaps)
    for kind, *_ in KINDS:
        total = f"transform(m_{kind}, (v, i) -> cast(char_length(v) + char_length(g_{kind}[i]) AS bigint))"
        ends = f"aggregate({total}, cast(array() AS array<bigint>), (a, n) -> concat(a, array(coalesce(try_element_at(a, -1), 0L) + n)))"
        out = out.withColumn(f"e_{kind}", F.expr(f"CASE WHEN size(m_{kind}) > 0 THEN {ends} END"))
    for kind, _, _, score, words in KINDS:
        found = f"transform(m_{kind}, (v, i) -> struct(v, e_{kind}[i] - char_length(v) AS s, e_{kind}[i] AS e, {score}D + IF(regexp_like(lower(right(g_{kind}[i], {CONTEXT})), '{words}') OR regexp_like(lower(left(g_{kind}[i + 1], {CONTEXT})), '{words}'), 0.2D, 0D) AS score))"
        kept = f"filter({found}, x -> x.score >= {THRESHOLD}D AND ({VALID[kind].replace('(v,', '(x.v,').replace('(v)', '(x.v)')}))"
        out = out.withColumn(f"s_{kind}", F.expr(f"CASE WHEN size(m_{kind}) > 0 THEN {kept} ELSE array() END"))
    def text(k):
        return f"transform(s_{k}, x -> concat('{k}:', x.s, ':', x.e))"

    base, every = (f"array_join(concat({', '.join(text(k) for k in kinds)}), ',')" for kinds in (BASE, [k for k, *_ in KINDS]))
    scores = f"array_join(concat({', '.join(f'transform(s_{k}, x -> cast(round(x.score, 1) AS string))' for k, *_ in KINDS)}), ',')"
    return out.select("doc_id", *(F.expr(f"cast(size(s_{k}) AS bigint)").alias(f"n_{k}") for k in BASE), F.expr(f"sha2({base}, 256)").alias("base_sha256"), F.expr(every).alias("spans"), F.expr(scores).alias("scores"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(load(spark, sf_dir, "documents"))


def _sql() -> str:
    """The same rows in DuckDB, from the plain patterns."""
    valid = {
        "email": "true",
        "ip": f"regexp_matches(v, '^{PART}[.]{PART}[.]{PART}[.]{PART}$')",
        "phone": f"length({DIGITS}) BETWEEN 8 AND 15",
        "card": f"length({DIGITS}) BETWEEN 16 AND 19 AND list_sum(list_transform(range(1, length({DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr({DIGITS}, length({DIGITS}) + 1 - i, 1)::int ELSE (substr({DIGITS}, length({DIGITS}) + 1 - i, 1)::int * 2) // 10 + (substr({DIGITS}, length({DIGITS}) + 1 - i, 1)::int * 2) % 10 END)) % 10 = 0",
        "iban": "list_reduce(list_transform(range(1, length(v) + 1), lambda i: strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', substr(substr(v, 5) || substr(v, 1, 4), i, 1)) - 1), lambda a, d: CASE WHEN d > 9 THEN (a * 100 + d) % 97 ELSE (a * 10 + d) % 97 END, 0) = 1",
        "id": "true",
    }
    parts, names = [], [k for k, *_ in KINDS]
    for order, (kind, _, pattern, score, words) in enumerate(KINDS):
        parts.append(f"""m{order} AS (SELECT r, regexp_extract_all(text, '{pattern}') AS m, regexp_split_to_array(text, '{pattern}') AS g FROM d),
p{order} AS (SELECT r, unnest(m) AS v, unnest(list_slice(g, 1, len(m))) AS gap, unnest(list_slice(g, 2, len(m) + 1)) AS after, unnest(range(len(m))) AS i FROM m{order} WHERE len(m) > 0),
q{order} AS (SELECT r, v, gap, after, sum(length(v) + length(gap)) OVER (PARTITION BY r ORDER BY i)::bigint AS e FROM p{order}),
s{order} AS (SELECT r, {order} AS k, e - length(v) AS s, '{kind}:' || (e - length(v)) || ':' || e AS span, {score} + CASE WHEN regexp_matches(lower(right(gap, {CONTEXT})), '{words}') OR regexp_matches(lower(left(after, {CONTEXT})), '{words}') THEN 0.2 ELSE 0 END AS score FROM q{order} WHERE {valid[kind]})""")
    every = " UNION ALL ".join(f"SELECT * FROM s{i}" for i in range(len(names)))
    counts = ", ".join(f"count(span) FILTER (k = {i}) AS n_{k}" for i, k in enumerate(BASE))
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
{", ".join(parts)},
f AS (SELECT * FROM ({every}) WHERE round(score, 1) >= {THRESHOLD}),
a AS (SELECT r, {counts}, string_agg(span, ',' ORDER BY k, s) FILTER (k < {len(BASE)}) AS base, string_agg(span, ',' ORDER BY k, s) AS spans, string_agg(round(score, 1)::decimal(3, 1)::varchar, ',' ORDER BY k, s) AS scores FROM f GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0)::bigint AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores FROM d LEFT JOIN a USING (r)"""


SQL = _sql()
