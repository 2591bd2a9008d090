"""Chat formatting with a grammar round trip, as DataFrame expressions.

Template: a user turn stands between ``[INST]`` and ``[/INST]``, a system turn between
``<<SYS>>`` and ``<</SYS>>``, an assistant turn ends with ``</s>`` and any other role X stands
between ``<<ROLE X>>`` and ``<</ROLE>>``. A text goes in as it is if the parser gives it back
unchanged; else its control characters are escaped. The finished conversation is parsed
again; if it does not come back turn by turn, all its texts are escaped.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Control characters and their escapes; the backslash is written first and read last.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("[", "\\o"), (">", "\\g"))

#: Role, opening mark, closing mark.
MARKS = (("user", "[INST]", "[/INST]"), ("system", "<<SYS>>", "<</SYS>>"), ("assistant", "", "</s>"))
OTHER = ("<<ROLE ", ">>", "<</ROLE>>")

#: One turn; an assistant turn is what runs up to its end mark.
GRAMMAR = r"(?s)\[INST\].*?\[/INST\]|<<SYS>>.*?<</SYS>>|<<ROLE [^<>\[]*+>>.*?<</ROLE>>|.*?</s>"

CONFLICT = ("user", "assistant")


def escape(text: Column) -> Column:
    for plain, safe in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescape(text: Column) -> Column:
    for plain, safe in reversed(ESCAPES):
        text = F.replace(text, F.lit(safe), F.lit(plain))
    return text


def _turn(role: Column, text: Column) -> Column:
    out = F.concat(F.lit(OTHER[0]), escape(role), F.lit(OTHER[1]), text, F.lit(OTHER[2]))
    for name, left, right in MARKS:
        out = F.when(role == name, F.concat(F.lit(left), text, F.lit(right))).otherwise(out)
    return out


def _parse(formatted: Column) -> Column:
    """Array of (role, text) read from formatted text."""
    return F.transform(F.regexp_extract_all(formatted, F.lit(GRAMMAR), F.lit(0)), _read)


def _read(turn: Column) -> Column:
    size = F.length(turn)
    name_end = F.instr(turn, OTHER[1])
    name = unescape(F.substring(turn, F.lit(len(OTHER[0]) + 1), name_end - len(OTHER[0]) - 1))
    body = F.substring(turn, name_end + len(OTHER[1]), size - name_end - len(OTHER[1]) + 1 - len(OTHER[2]))
    body_of = {}
    for role, left, right in MARKS:
        body_of[role] = F.substring(turn, F.lit(len(left) + 1), size - len(left) - len(right))
    user, system = F.startswith(turn, F.lit("[INST]")), F.startswith(turn, F.lit("<<SYS>>"))
    other = F.startswith(turn, F.lit(OTHER[0]))
    role = F.when(user, "user").when(system, "system").when(other, name).otherwise("assistant")
    text = (
        F.when(user, body_of["user"])
        .when(system, body_of["system"])
        .when(other, body)
        .otherwise(body_of["assistant"])
    )
    return F.struct(role.alias("role"), unescape(text).alias("text"))


def format_chat(turns: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted``, ``parsed`` (array of role, text read
    back) and ``loss_spans`` (start and stop, in code points, of the assistant texts).

    Reads ``conv_id, turn, role, text``; a null role or text is an empty one; turns that share a
    number are ordered by role and text and all stay; a null number comes first and null ids form
    one conversation. Raises nothing: a text that conflicts is escaped, never dropped.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    df = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    alone = _parse(_turn(F.col("role"), F.col("text")))
    same = (F.size("back") == 1) & (F.col("back")[0]["role"] == F.col("role")) & (F.col("back")[0]["text"] == F.col("text"))
    df = df.withColumn("back", alone).select(
        "conv_id",
        F.struct(
            "turn", "role", "text", F.when(same, F.col("text")).otherwise(escape(F.col("text"))).alias("body")
        ).alias("t"),
    )
    df = df.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    source = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    df = df.withColumns({"source": source, "once": _rendered("turns")})
    # Outside the lambda: the whole conversation is parsed once, not once per turn.
    escaped = F.transform("turns", lambda t: t.withField("body", escape(t["text"])))
    df = df.withColumn("turns", F.when(_parse(F.col("once")) == F.col("source"), F.col("turns")).otherwise(escaped))
    df = df.select("conv_id", "turns", _rendered("turns").alias("formatted"))
    return df.select("conv_id", "formatted", _parse(F.col("formatted")).alias("parsed"), _loss_spans().alias("loss_spans"))


def _rendered(turns: str) -> Column:
    return F.array_join(F.transform(turns, lambda t: _turn(t["role"], t["body"])), "")


def _loss_spans() -> Column:
    """Running lengths of the turns; an assistant text starts where its turn does."""
    lengths = F.transform(
        "turns",
        lambda t: F.struct(
            (t["role"] == "assistant").alias("loss"),
            F.length(_turn(t["role"], t["body"])).alias("all"),
            F.length(t["body"]).alias("body"),
        ),
    )
    spans = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(spans).alias("spans"))
    return F.aggregate(
        lengths,
        start,
        lambda a, t: F.struct(
            (a["at"] + t["all"]).alias("at"),
            F.when(
                t["loss"],
                F.concat(a["spans"], F.array(F.struct(a["at"].alias("start"), (a["at"] + t["body"]).alias("stop")))),
            )
            .otherwise(a["spans"])
            .alias("spans"),
        ),
        lambda a: a["spans"],
    )


def with_conflict(turns: DataFrame) -> DataFrame:
    """The turns and conversation -7, whose texts hold the template's own marks."""
    text = "</s>[INST] ok [/INST]"
    rows = [(-7, k, role, text) for k, role in enumerate(CONFLICT)]
    mine = turns.select("conv_id", "turn", "role", "text")
    extra = turns.sparkSession.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return mine.unionByName(extra)


def digest(formatted: DataFrame) -> DataFrame:
    """Figures and digests of what the parser reads back, and of the formatted text under the loss mask."""
    all_turns = F.array_join(F.transform("parsed", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    under = F.transform("loss_spans", lambda s: F.substring(F.col("formatted"), s["start"] + 1, s["stop"] - s["start"]))
    loss = F.array_join(F.transform(under, unescape), "")
    df = formatted.withColumn("loss", loss)
    return df.select(
        "conv_id",
        F.size("parsed").cast("long").alias("n_turns"),
        F.sha2(all_turns, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def _sql() -> str:
    safe = "text"
    for plain, code in ESCAPES:
        safe = f"replace({safe}, '{plain}', '{code}')"
    marks = "CASE role " + " ".join(f"WHEN '{r}' THEN {len(a) + len(b)}" for r, a, b in MARKS)
    name = safe.replace("text", "role")
    marks += f" ELSE {sum(map(len, OTHER))} + length({name}) END"
    back = "text"
    for plain, code in reversed(ESCAPES):
        back = f"replace({back}, '{code}', '{plain}')"
    ends = "CASE role " + " ".join(f"WHEN '{r}' THEN '{b}'" for r, _, b in MARKS) + f" ELSE '{OTHER[2]}' END"
    opens = "starts_with(text, '[INST]') OR starts_with(text, '<<SYS>>') OR regexp_matches(text, '^<<ROLE [^<>\\[]*>>')"
    # A text that goes in as it is: no end mark of its turn inside, and for an assistant no other turn's start.
    asis = f"({back} = text AND NOT contains(text, {ends}) AND NOT (role = 'assistant' AND ({opens})))"
    return f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum({marks} + CASE WHEN {asis} THEN length(text) ELSE length({safe}) END)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id"""


ORACLE = _sql()
