"""Personal data: patterns propose spans, checks confirm them, words nearby weigh them.

Everything is a DataFrame expression. Patterns are possessive and anchored at the start
of a run, so that a long run without a match is read once and no group recurses.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn")

# How many characters an IBAN of a country has, without blanks.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban() -> str:
    """Of a listed country exactly its length, else as long as it goes on. Nothing is consumed,
    so a candidate that fails does not hide one that starts inside it."""
    rest = "[0-9]{2}(?: ?[A-Z0-9])"
    listed = "|".join(f"(?:{c.replace(' ', '|')}){rest}{{{n - 4}}}" for n, c in IBAN_LENGTHS.items())
    known = "|".join(IBAN_LENGTHS.values()).replace(" ", "|")
    return f"(?=[A-Z]{{2}}[0-9]{{2}})(?=({listed}|(?!{known})[A-Z]{{2}}{rest}{{11,30}}))"


# What proposes a span of each kind.
MAIL = "A-Za-z0-9._%+-"
PATTERNS = {
    "email": rf"(?:\G|(?<![{MAIL}]))[{MAIL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
}
#: Kinds whose pattern looks ahead and captures the span, so that candidates may overlap.
AHEAD = {"iban": _iban()}
#: A text without this character has no span of the kind.
NEEDS = {"email": "@", "phone": "+", "ssn": "-"}
OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Score without and with one of the words in the 40 characters before the span or after it.
SCORES = {
    "email": (0.8, 0.95),
    "ip": (0.6, 0.9),
    "card": (0.9, 0.99),
    "phone": (0.6, 0.9),
    "iban": (0.9, 0.99),
    "ssn": (0.3, 0.8),
}
WORDS = {
    "email": "mail|email|contact|write",
    "ip": "ip|host|server|address",
    "card": "card|visa|credit|payment",
    "phone": "phone|telephone|call|tel|mobile|fax",
    "iban": "iban|account|bank|konto|cuenta|compte",
    "ssn": "ssn|social security",
}
#: Whole words only.
CONTEXT = {kind: f"(^|[^a-z])({words})([^a-z]|$)" for kind, words in WORDS.items()}
#: Areas, groups and serials that no number has.
NO_SSN = "^(000|666|9)|-00-|-0000$"
NEARBY = 40
THRESHOLD = 0.5
BLOCK = 256
#: Characters of a piece of text that context is taken from, more than ``NEARBY``.
CONTEXT_BLOCK = 256


def _luhn(digits: str) -> str:
    doubled = f"cast(substr({digits}, -i, 1) as int) * (2 - i % 2)"
    return (
        f"aggregate(sequence(1, length({digits})), 0L, (s, i) -> s + ({doubled}) div 10 + ({doubled}) % 10) % 10 = 0"
    )


def _mod97(value: str) -> str:
    code = "ascii(substr(t, i, 1))"
    step = f"if({code} < 58, (s * 10 + {code} - 48) % 97, (s * 100 + {code} - 55) % 97)"
    turned = f"concat(substr({value}, 5), substr({value}, 1, 4))"
    return f"element_at(transform(array({turned}), t -> aggregate(sequence(1, length(t)), 0, (s, i) -> {step})), 1) = 1"


#: What confirms a span: ``y.v`` is its value, ``y.d`` the value without blanks and hyphens.
CHECKS = {
    "email": "true",
    "ip": f"y.v rlike '^{OCTET}(?:[.]{OCTET}){{3}}$'",
    "card": f"length(y.d) between 16 and 19 and {_luhn('y.d')}",
    "phone": "length(regexp_replace(y.v, '[^0-9]', '')) between 8 and 15",
    "iban": _mod97("y.d"),
    "ssn": f"not y.v rlike '{NO_SSN}'",
}


def _proposed(kind: str) -> tuple[Column, Column]:
    text = F.col("text")
    if kind in AHEAD:
        found = F.regexp_extract_all(text, F.lit(AHEAD[kind]), F.lit(1))
        pieces = F.split(text, AHEAD[kind], -1)
    else:
        found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
        pieces = F.split(text, PATTERNS[kind], -1)
    none = F.array().cast("array<string>")
    if kind in NEEDS:
        has = F.instr(text, NEEDS[kind]) > 0
        return F.when(has, found).otherwise(none), F.when(has, pieces).otherwise(none)
    return found, F.when(F.size(found) > 0, pieces).otherwise(none)


def _placed(kind: str) -> str:
    """Start and end of each match: running lengths of the pieces between the matches and
    of the matches, first inside blocks, then over the blocks, so the work stays linear."""
    at = "array<struct<start:int,stop:int,v:string>>"
    between, taken = f"{kind}_between", "length(v)"
    if kind in AHEAD:  # the pieces hold the matches; a match at the start has no piece before it
        between = f"if(size({between}) = size({kind}_found), concat(array(''), {between}), {between})"
        taken = "0"
    parts = (
        f"zip_with(slice({between}, 1, size({kind}_found)), {kind}_found, (p, v) ->"
        f" struct(length(p) as gap, {taken} as taken, length(v) as len, v as v))"
    )
    one = "struct(a.at + p.gap as start, a.at + p.gap + p.len as stop, p.v as v)"
    inside = (
        f"aggregate(part, struct(0 as at, cast(array() as {at}) as spans), (a, p) ->"
        f" struct(a.at + p.gap + p.taken as at, concat(a.spans, array({one})) as spans))"
    )
    blocks = f"transform(sequence(0, cast((size(parts) - 1) div {BLOCK} as int)), b -> slice(parts, b * {BLOCK} + 1, {BLOCK}))"
    moved = "struct(s.start + a.at as start, s.stop + a.at as stop, s.v as v)"
    over = (
        f"aggregate(transform({blocks}, part -> {inside}), struct(0 as at, cast(array() as {at}) as spans), (a, l) ->"
        f" struct(a.at + l.at as at, concat(a.spans, transform(l.spans, s -> {moved})) as spans), a -> a.spans)"
    )
    return (
        f"if(size({kind}_found) > 0, element_at(transform(array({parts}), parts -> {over}), 1),"
        f" cast(array() as {at}))"
    )


def _context(span: str) -> str:
    """The characters before and after a span, a line each, across other matches. They come from
    pieces of the text of equal size, so that a span far into a long text costs no more."""

    def cut(at: str, size: str) -> str:
        block = f"cast({at} div {CONTEXT_BLOCK} as int)"
        both = f"concat_ws('', get(blocks, {block}), get(blocks, {block} + 1))"
        return f"substr({both}, {at} % {CONTEXT_BLOCK} + 1, {size})"

    before = cut(f"greatest({span}.start - {NEARBY}, 0)", f"least({span}.start, {NEARBY})")
    return f"concat_ws('\\n', {before}, {cut(f'{span}.stop', str(NEARBY))})"


def _confirmed(kind: str) -> str:
    plain, near = SCORES[kind]
    checked = (
        f"filter({kind}_at, x -> element_at(transform(array(struct(x.v as v, regexp_replace(x.v, '[ -]', '') as d)),"
        f" y -> {CHECKS[kind]}), 1))"
    )
    if kind in AHEAD:  # of confirmed spans that overlap, the first
        checked = (
            f"aggregate({checked}, slice({kind}_at, 1, 0), (a, x) ->"
            f" if(coalesce(try_element_at(a, -1).stop, 0) <= x.start, concat(a, array(x)), a))"
        )
    score = f"if(lower({_context('x')}) rlike '{CONTEXT[kind]}', {near}D, {plain}D)"
    return (
        f"filter(transform({checked}, x -> struct('{kind}' as kind, x.start as start, x.stop as stop, {score} as score)),"
        f" x -> x.score >= {THRESHOLD}D)"
    )


def find_spans(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``spans``: array of (kind, start, stop, score) in code points, stop exclusive,
    by kind as listed in ``KINDS``, then start.

    A null or empty text has no spans; a null id and repeated rows come back as they are, one row
    each; other columns are not read. Very long texts cost time in proportion to their length.
    """
    df = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    for kind in KINDS:
        found, between = _proposed(kind)
        df = df.withColumns({f"{kind}_found": found, f"{kind}_between": between})
    some = " or ".join(f"size({k}_found) > 0" for k in KINDS)
    blocks = f"if({some}, regexp_extract_all(text, '(?s).{{1,{CONTEXT_BLOCK}}}', 0), cast(array() as array<string>))"
    df = df.select("doc_id", F.expr(blocks).alias("blocks"), *(F.expr(_placed(k)).alias(f"{k}_at") for k in KINDS))
    return df.select("doc_id", F.concat(*(F.expr(_confirmed(k)) for k in KINDS)).alias("spans"))


def _joined(spans: str) -> Column:
    return F.expr(f"array_join(transform({spans}, x -> concat_ws(':', x.kind, x.start, x.stop)), ',')")


def digest(found: DataFrame) -> DataFrame:
    """Counts, the digest of the base spans, all spans as text, and the score of each."""
    base = "filter(spans, x -> x.kind in ('email', 'ip', 'card', 'phone'))"
    counts = [
        F.expr(f"cast(size(filter(spans, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in BASE
    ]
    return found.select(
        "doc_id",
        *counts,
        F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined("spans").alias("spans"),
        F.expr("array_join(transform(spans, x -> cast(x.score as string)), ',')").alias("scores"),
    )


def _sql_kind(kind: str, pattern: str, keep: str) -> str:
    plain, near = SCORES[kind]
    return f"""
    SELECT * FROM (SELECT doc_id, row_no, '{kind}' AS kind, {KINDS.index(kind)} AS k, start, start + length(v) AS stop,
      CASE WHEN regexp_matches(lower(substr(text, greatest(start - {NEARBY}, 0) + 1, least(start, {NEARBY})) || chr(10) ||
        substr(text, start + length(v) + 1, {NEARBY})), '{CONTEXT[kind]}') THEN {near}::DOUBLE ELSE {plain}::DOUBLE END AS score
    FROM (
      SELECT doc_id, row_no, text, v, replace(replace(v, ' ', ''), '-', '') AS d,
             (sum(length(p)) OVER w + sum(length(v)) OVER w - length(v))::BIGINT AS start
      FROM (SELECT doc_id, row_no, text, unnest(regexp_extract_all(text, '{pattern}')) AS v,
                   unnest(string_split_regex(text, '{pattern}')[1:len(regexp_extract_all(text, '{pattern}'))]) AS p,
                   unnest(range(len(regexp_extract_all(text, '{pattern}')))) AS i
            FROM d)
      WINDOW w AS (PARTITION BY doc_id, row_no ORDER BY i))
    WHERE ({keep})) WHERE score >= {THRESHOLD}"""


def _sql() -> str:
    luhn = (
        "list_sum([CASE WHEN i % 2 = 0 THEN (2 * d[-i]::INT) // 10 + (2 * d[-i]::INT) % 10 ELSE d[-i]::INT END"
        " FOR i IN range(1, length(d) + 1)]) % 10 = 0"
    )
    coded = (
        "list_aggregate([CASE WHEN ascii(x) < 58 THEN x ELSE (ascii(x) - 55)::VARCHAR END"
        " FOR x IN string_split(d[5:] || d[:4], '')], 'string_agg', '')"
    )
    mod97 = (
        f"list_reduce(list_prepend(0, [y::INT FOR y IN string_split({coded}, '')]),"
        " lambda a, b: (a * 10 + b) % 97) = 1"
    )
    plain = {
        "email": "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)+",
        "ip": "[0-9]+(?:\\.[0-9]+)(?:\\.[0-9]+)(?:\\.[0-9]+)",
        "card": "[0-9](?:[ -]?[0-9])+",
        "phone": "\\+[0-9][ ().0-9-]+[0-9]",
        "iban": PATTERNS["iban"],
        "ssn": PATTERNS["ssn"],
    }
    keep = {
        "email": "true",
        "ip": "list_max([x::HUGEINT FOR x IN string_split(v, '.')]) <= 255",
        "card": f"CASE WHEN length(d) BETWEEN 16 AND 19 THEN {luhn} ELSE false END",
        "phone": "length(regexp_replace(v, '[^0-9]', '', 'g')) BETWEEN 8 AND 15",
        "iban": mod97,
        "ssn": f"NOT regexp_matches(v, '{NO_SSN}')",
    }
    parts = " UNION ALL ".join(_sql_kind(k, plain[k], keep[k]) for k in KINDS)
    counts = ", ".join(f"count(*) FILTER (kind = '{k}')::BIGINT AS n_{k}" for k in BASE)
    one = "kind || ':' || start::BIGINT || ':' || stop::BIGINT"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS row_no FROM documents),
s AS ({parts})
SELECT d.doc_id, {counts},
       sha256(coalesce(string_agg({one}, ',' ORDER BY k, start) FILTER (k < {len(BASE)}), '')) AS base_sha256,
       coalesce(string_agg({one}, ',' ORDER BY k, start) FILTER (kind IS NOT NULL), '') AS spans,
       coalesce(string_agg(score::VARCHAR, ',' ORDER BY k, start) FILTER (kind IS NOT NULL), '') AS scores
FROM d LEFT JOIN s ON s.row_no = d.row_no
GROUP BY d.doc_id, d.row_no"""


ORACLE = _sql()
