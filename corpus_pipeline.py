"""From documents to token files, in five stages.

Every stage takes (spark, docs, sf_dir) and works on all that the one before kept; its result is
written as Parquet and read again. All but the last return the columns of ``documents``.
"""

from pyspark.sql import DataFrame, SparkSession

from armlens.llm import decontaminate, mixing, near, tokens, toxicity
from armlens.llm.frames import table, written
from armlens.session import configure, shared_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be toxic go."""
    configure(spark)
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays, the one with the smallest id."""
    configure(spark)
    return near.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of a benchmark item go."""
    configure(spark)
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; of one taken in part, its first words."""
    configure(spark)
    return mixing.mixed_documents(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, read back: one row per document in them."""
    configure(spark)
    folder = shared_dir(spark, "tokens")
    tokens.write_tokens(docs, folder, tokens.vocabulary_path())
    return tokens.read_tokens(spark, folder)


STAGES = [
    ("toxicity", drop_toxic),
    ("near-dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("token ids", token_files),
]

#: SQL expresses neither the classifier nor the sketches nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
