"""The dealt operators as queries over the test tables, with the SQL that checks them."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from armlens.llm import align, chat, decontaminate, exact, lexical, mixing, near, permutation, pii, quality, repeats, tokens, toxicity
from armlens.llm.frames import table
from armlens.session import configure, shared_dir

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[fn.__name__] = run
        if oracle is not None:
            ORACLES[fn.__name__] = oracle
        return fn

    return add


@query(pii.ORACLE)
def op2_pii(spark, sf_dir):
    """Personal data in every document."""
    return pii.digest(pii.find_spans(table(spark, sf_dir, "documents")))


@query(chat.ORACLE)
def op4_chat(spark, sf_dir):
    """Every conversation formatted, parsed again and digested."""
    return chat.digest(chat.format_chat(chat.with_conflict(table(spark, sf_dir, "conversations"))))


@query(mixing.ORACLE)
def op7_mixing(spark, sf_dir):
    """All documents mixed to the weights of their sources."""
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


@query(decontaminate.ORACLE)
def op1_decontaminate(spark, sf_dir):
    """Benchmark items in every document."""
    found = decontaminate.find_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.digest(found)


@query()
def op8_toxicity(spark, sf_dir):
    """A toxicity score for every document."""
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op10_quality(spark, sf_dir):
    """A quality score for every document."""
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op5_tokens(spark, sf_dir):
    """Every document tokenised, written as flat files and read back."""
    folder = shared_dir(spark, "tokens")
    tokens.write_tokens(table(spark, sf_dir, "documents"), folder, tokens.vocabulary_path())
    return tokens.read_tokens(spark, folder)


@query(exact.ORACLE)
def op3_exact_dedup(spark, sf_dir):
    """Equal texts among all documents."""
    return exact.dedup(table(spark, sf_dir, "documents"))


@query()
def op6_near_dedup(spark, sf_dir):
    """Classes of near-duplicates among all documents."""
    return near.near_classes(table(spark, sf_dir, "documents")).drop("raw")


@query(repeats.ORACLE)
def op9_substring_dedup(spark, sf_dir):
    """Passages of 50 words that an earlier document has, removed from all documents."""
    return repeats.dedup(table(spark, sf_dir, "documents")).drop("removed")


@query(lexical.ORACLE)
def op13_lexical(spark, sf_dir):
    """The ten documents that fit each benchmark item best."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query()
def op12_neighbours(spark, sf_dir):
    """The nearest vectors of every hundredth one."""
    return permutation.search(table(spark, sf_dir, "embeddings"))


@query()
def op11_align(spark, sf_dir):
    """Tokens of two tokenizers linked over every document."""
    return align.align(table(spark, sf_dir, "documents"))
