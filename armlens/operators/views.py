"""Row-level views of the request log: validity, arms, slices, derived cost."""

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from armlens import schema as S
from armlens.functions.numeric import exact_round, ratio


def without_trials(df: DataFrame, exclude: Iterable[int] = (S.QUALITY_TRIAL,)) -> DataFrame:
    """Drop quality-run (or warm-up) trials; a partition filter on written cells. A row
    without a trial is of none of them."""
    exclude = list(exclude)
    return df.filter(F.col("trial").isNull() | ~F.col("trial").isin(exclude)) if exclude else df


def is_valid() -> Column:
    return (
        F.col("error").isNull()
        & F.col("ttft_ms").isNotNull()
        & F.col("tokens_per_sec").isNotNull()
    )


def is_priced() -> Column:
    return (
        F.col("gpu_cost_usd").isNotNull()
        & F.col("output_tokens").isNotNull()
        & (F.col("output_tokens") > 0)
    )


def valid_requests(df: DataFrame) -> DataFrame:
    return df.filter(is_valid())


def weakly_valid_requests(df: DataFrame) -> DataFrame:
    return df.filter(F.col("ttft_ms").isNotNull())


def priced_requests(df: DataFrame) -> DataFrame:
    return df.filter(is_priced())


def with_acceptance(df: DataFrame) -> DataFrame:
    return df.filter(F.col("acceptance_rate").isNotNull())


def failures(df: DataFrame) -> DataFrame:
    return df.filter(F.col("error").isNotNull())


def sliced(df: DataFrame, **wanted: Iterable) -> DataFrame:
    """Keep rows whose columns hold one of the wanted values, e.g. gpu_type=["L4"]."""
    for name, values in wanted.items():
        df = df.filter(F.col(name).isin(list(values)))
    return df


def arm(base: str = S.BASE_PATTERN, spec: str = S.SPEC_PATTERN) -> Column:
    """'base', 'spec' or NULL, by pattern on the system name."""
    return F.when(F.col("system").rlike(base), "base").when(
        F.col("system").rlike(spec), "spec"
    )


def rate_card(spark: SparkSession, rates: Mapping[str, float] | None = None) -> DataFrame:
    rows = list((rates or S.USD_PER_HOUR).items())
    return spark.createDataFrame(rows, "gpu_type string, usd_per_hour double")


def with_cost(df: DataFrame, rates: DataFrame | None = None, latency_s: str = "latency_s") -> DataFrame:
    """Add gpu_cost_usd. The default rate card has four rows, so it is broadcast;
    for a caller's table the size decides at run time."""
    card = F.broadcast(rate_card(df.sparkSession)) if rates is None else rates
    cost = F.coalesce(F.col("usd_per_hour"), F.lit(0.0)) / 3600 * F.col(latency_s)
    return (
        df.join(card, "gpu_type", "left")
        .withColumn("gpu_cost_usd", cost)
        .withColumn("gpu_cost_usd", exact_round("gpu_cost_usd", 8))
        .drop("usd_per_hour")
    )


def as_failed_where(df: DataFrame, failed: Column) -> DataFrame:
    """Bring failed rows to the log's form: no metrics, no tokens, cost kept."""
    empty = {
        c: F.when(~failed, F.col(c))
        for c in ("ttft_ms", "tpot_ms", "tokens_per_sec", "output_text")
        if c in df.columns
    }
    return df.withColumns(
        {**empty, "output_tokens": F.when(failed, 0).otherwise(F.col("output_tokens"))}
    )


def cost_per(tokens: float) -> Column:
    """Cost of so many output tokens, one value per request."""
    return ratio("gpu_cost_usd", "output_tokens") * F.lit(float(tokens))


def all_arms(*arms: DataFrame) -> DataFrame:
    """Concatenate result lists; a column one of them lacks becomes NULL."""
    out = arms[0]
    for other in arms[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out
