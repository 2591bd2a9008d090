"""Prompt sets: reproducible samples of conversations, code tasks and articles."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from armlens import schema as S
from armlens.functions.hashing import sample_key
from armlens.functions.text import strip


def first_turn(turns: DataFrame, role: str = "user") -> DataFrame:
    """The first turn of a role per conversation, from one row per turn."""
    return (
        turns.filter(F.col("role") == role)
        .groupBy("conv_id")
        .agg(F.min_by("text", "turn").alias("text"))
    )


def first_turn_nested(dialogues: DataFrame, speaker: str = "human") -> DataFrame:
    """The same from one row per conversation with an array of turns."""
    said = F.filter("conversations", lambda t: t["from"] == speaker)
    return dialogues.select("id", F.get(said, F.lit(0))["value"].alias("text")).filter(
        F.col("text").isNotNull()
    )


def long_enough(text: str, chars: int) -> Column:
    return F.length(strip(text)) >= chars


def sample(df: DataFrame, ident: str, n: int, seed: int = S.SAMPLE_SEED) -> DataFrame:
    """A seeded sample of n rows with their place in it (``idx`` from 0).

    The order is a hash of the row's identity, so any partitioning gives the same
    sample, and the limit becomes a per-task top n. Only n rows are numbered.
    """
    picked = df.withColumn("_key", sample_key(seed, F.col(ident))).orderBy("_key", ident).limit(n)
    place = F.row_number().over(Window.orderBy("_key", ident)) - 1
    return picked.withColumn("idx", place).drop("_key")


def numbered(task: str) -> Column:
    return F.format_string("%s_%04d", F.lit(task), F.col("idx"))


def _prompt_columns(df: DataFrame) -> DataFrame:
    have = set(df.columns)
    return df.select(
        *[
            F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name)
            for f in S.PROMPT.fields
        ]
    )


def chat_prompts(
    first: DataFrame, ident: str = "conv_id", n: int = 50, seed: int = S.SAMPLE_SEED
) -> DataFrame:
    """From each conversation's first human turn (columns ident, text)."""
    usable = first.filter(long_enough("text", S.MIN_CHAT_CHARS))
    return _prompt_columns(
        sample(usable, ident, n, seed).select(
            numbered("chat").alias("id"),
            F.lit("chat").alias("task"),
            F.substring(strip("text"), 1, S.MAX_CHAT_CHARS).alias("prompt"),
        )
    )


def code_prompts(
    items: DataFrame, ident: str = "item_id", n: int = 50, seed: int = S.SAMPLE_SEED
) -> DataFrame:
    """From (ident, prompt, canonical_solution, entry_point); a short set repeats."""
    picked = sample(items, ident, n, seed)
    have = F.count(F.lit(1)).over(Window.partitionBy())
    repeated = (
        picked.withColumn("_have", have)
        .withColumn("idx", F.explode(F.sequence(F.col("idx"), F.lit(n - 1), F.col("_have").cast("int"))))
    )
    return _prompt_columns(
        repeated.select(
            numbered("code").alias("id"),
            F.lit("code").alias("task"),
            strip("prompt").alias("prompt"),
            "canonical_solution",
            "entry_point",
        )
    )


def summary_prompts(
    articles: DataFrame, ident: str = "doc_id", n: int = 50, seed: int = S.SAMPLE_SEED
) -> DataFrame:
    """From (ident, article, highlights)."""
    usable = articles.filter(long_enough("article", S.MIN_ARTICLE_CHARS))
    cut = F.substring(strip("article"), 1, S.MAX_ARTICLE_CHARS)
    return _prompt_columns(
        sample(usable, ident, n, seed).select(
            numbered("summarization").alias("id"),
            F.lit("summarization").alias("task"),
            F.concat(F.lit(S.SUMMARY_INSTRUCTION), cut).alias("prompt"),
            F.col("highlights").alias("reference_summary"),
        )
    )


def all_prompts(*sets: DataFrame) -> DataFrame:
    out = sets[0]
    for other in sets[1:]:
        out = out.unionByName(other)
    return out


def prompt_counts(prompts: DataFrame) -> DataFrame:
    return prompts.groupBy("task").agg(F.count(F.lit(1)).alias("prompts"))


def cell_prompts(prompts: DataFrame, concurrencies=S.CONCURRENCIES) -> DataFrame:
    """The prompts a cell of each concurrency sends: the first ones of its task."""
    place = F.substring_index("id", "_", -1).cast("int")
    sizes = F.filter(F.array(*[F.lit(c) for c in concurrencies]), lambda c: c > F.col("_place"))
    return (
        prompts.withColumn("_place", place)
        .withColumn("concurrency", F.explode(sizes))
        .select("task", "concurrency", F.col("id").alias("prompt_id"))
    )


def first_rows(df: DataFrame, ident: str, n: int) -> DataFrame:
    """The first n rows by id, for a quality sample."""
    return df.orderBy(ident).limit(n)
