"""Grouped summaries of the request log.

Every summary is one pass with partial aggregation, so a cell that holds most
rows costs one small partial row per task, not a large shuffle.
"""

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armlens import schema as S
from armlens.functions.numeric import half_even, ratio
from armlens.operators import views
from armlens.operators.quantiles import exact_quantiles


@dataclass(frozen=True)
class Metric:
    """A per-request number: column name, expression, better direction."""

    name: str
    expr: str | None = None
    higher_is_better: bool = False

    @property
    def column(self) -> Column:
        return F.expr(self.expr or self.name)


TTFT = Metric("ttft_ms")
TPOT = Metric("tpot_ms")
TPS = Metric("tokens_per_sec", higher_is_better=True)
LATENCY = Metric("total_latency_ms")
COST = Metric("gpu_cost_usd")
ACCEPTANCE = Metric("acceptance_rate", higher_is_better=True)


def keyed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with a missing key belong to no group."""
    return df.dropna(subset=list(keys))


def means(df: DataFrame, keys: Sequence[str], metrics: Sequence[Metric]) -> DataFrame:
    return keyed(df, keys).groupBy(*keys).agg(*[F.avg(m.column).alias(m.name) for m in metrics])


def partial_stats(df: DataFrame, keys: Sequence[str], metrics: Sequence[Metric]) -> DataFrame:
    """Per group and metric: how many values (``x_n``), their sum and the squares about their mean."""
    aggs = []
    for m in metrics:
        n = F.count(m.column)
        squares = F.coalesce(F.var_pop(m.column), F.lit(0.0)) * n
        aggs += [n.alias(f"{m.name}_n"), F.coalesce(F.sum(m.column), F.lit(0.0)).alias(f"{m.name}_sum"), squares.alias(f"{m.name}_m2")]
    return keyed(df, keys).groupBy(*keys).agg(*aggs)


def merged_stats(parts: DataFrame, keys: Sequence[str], metrics: Sequence[Metric]) -> DataFrame:
    """Partial statistics of disjoint sets of rows put together, whatever their order."""
    aggs = []
    for m in metrics:
        n, total = F.sum(f"{m.name}_n"), F.sum(f"{m.name}_sum")
        within = F.sum(f"{m.name}_m2") + F.sum(F.coalesce(ratio(F.col(f"{m.name}_sum") * F.col(f"{m.name}_sum"), f"{m.name}_n"), F.lit(0.0)))
        squares = F.greatest(within - F.coalesce(ratio(total * total, n), F.lit(0.0)), F.lit(0.0))
        aggs += [n.alias(f"{m.name}_n"), total.alias(f"{m.name}_sum"), squares.alias(f"{m.name}_m2")]
    return parts.groupBy(*keys).agg(*aggs)


def means_of_stats(stats: DataFrame, keys: Sequence[str], metrics: Sequence[Metric], deviation: bool = False) -> DataFrame:
    """The means, and with ``deviation`` also the sample deviations as ``x_std``."""
    out = [ratio(f"{m.name}_sum", f"{m.name}_n").alias(m.name) for m in metrics]
    if deviation:
        out += [F.sqrt(ratio(F.col(f"{m.name}_m2"), F.col(f"{m.name}_n") - 1)).alias(f"{m.name}_std") for m in metrics]
    return stats.select(*keys, *out)


def summary_stats(
    df: DataFrame,
    keys: Sequence[str] = tuple(S.SERIES_KEY),
    spread: Sequence[Metric] = (TTFT, TPOT, TPS),
    centre: Sequence[Metric] = (LATENCY, ACCEPTANCE),
) -> DataFrame:
    """Mean and sample deviation per cell, columns named metric_stat."""
    aggs = []
    for m in spread:
        aggs += [
            F.avg(m.column).alias(f"{m.name}_mean"),
            F.stddev_samp(m.column).alias(f"{m.name}_std"),
        ]
    aggs += [F.avg(m.column).alias(f"{m.name}_mean") for m in centre]
    return keyed(df, keys).groupBy(*keys).agg(*aggs)


def cost_summary(df: DataFrame) -> DataFrame:
    """Total cost and requests, failed ones included."""
    return (
        keyed(df, ["gpu_type", "system"])
        .groupBy("gpu_type", "system")
        .agg(
            F.sum("gpu_cost_usd").alias("total_cost_usd"),
            F.count("request_id").alias("total_requests"),
        )
    )


DASHBOARD_KEY = ["system", "gpu_type", "task", "concurrency"]
DASHBOARD = (TTFT, TPOT, TPS, COST)


def dashboard_means(df: DataFrame) -> DataFrame:
    return means(views.weakly_valid_requests(df), DASHBOARD_KEY, DASHBOARD)


def mean_cost(df: DataFrame, keys: Sequence[str], tokens: float, name: str) -> DataFrame:
    """Mean of the per-request cost of so many tokens."""
    return (
        keyed(views.priced_requests(df), keys)
        .groupBy(*keys)
        .agg(F.avg(views.cost_per(tokens)).alias(name))
    )


def cost_per_token(df: DataFrame) -> DataFrame:
    """Mean cost per token, scaled to 1 000 after averaging, 6 digits."""
    out = mean_cost(df, ["system", "gpu_type"], 1, "cost_per_token")
    return out.select(
        "system", "gpu_type", half_even(F.col("cost_per_token") * 1000, 6).alias("cost_per_1k_tokens")
    )


def acceptance(df: DataFrame, keys: Sequence[str] = tuple(S.PAIR_CELL)) -> DataFrame:
    return means(views.with_acceptance(df), keys, (ACCEPTANCE,))


def cell_tps(df: DataFrame) -> DataFrame:
    return means(df, S.SERIES_KEY, (TPS,))


def cell_report(df: DataFrame) -> DataFrame:
    """Per-cell run report. The TPS sum skips zeros but divides by all rows with a TTFT."""
    ok = F.col("ttft_ms").isNotNull()
    tps = F.coalesce(F.col("tokens_per_sec"), F.lit(0.0))
    return (
        df.groupBy(*S.CELL)
        .agg(
            F.count_if(ok).alias("completed"),
            F.count(F.lit(1)).alias("sent"),
            F.avg("ttft_ms").alias("avg_ttft_ms"),
            F.sum(F.when(ok, tps)).alias("tps_sum"),
            F.sum("gpu_cost_usd").alias("total_cost_usd"),
            F.max("acceptance_rate").alias("acceptance_rate"),
        )
        .withColumn("avg_tps", ratio("tps_sum", F.col("completed").cast("double")))
        .drop("tps_sum")
    )


def arm_averages(df: DataFrame, keys: Sequence[str] = ("system", "gpu_type")) -> DataFrame:
    """Averages that skip missing values, costs that count them as 0, and failures."""
    numbers = keyed(df, keys).groupBy(*keys).agg(
        F.avg("tpot_ms").alias("avg_tpot_ms"),
        F.avg("tokens_per_sec").alias("avg_tps"),
        F.avg("ttft_ms").alias("avg_ttft_ms"),
        F.sum(F.coalesce(F.col("gpu_cost_usd"), F.lit(0.0))).alias("cost_usd"),
        F.count("error").alias("failed"),
    )
    # A message among the numbers would sort every row; failures are few.
    first = views.failures(df).groupBy(*keys).agg(F.min_by("error", "request_id").alias("first_error"))
    return numbers.join(first, list(keys), "left")


def latency_tails(
    df: DataFrame,
    keys: Sequence[str] = tuple(S.SERIES_KEY),
    value: str = "ttft_ms",
    probabilities: Sequence[float] = (0.1, 0.5, 0.9),
) -> DataFrame:
    """Coefficient of variation and exact quantiles per cell."""
    spread = {
        "n": F.count("_v"),
        "variation": ratio(F.stddev_samp("_v"), F.avg("_v")),
    }
    return exact_quantiles(keyed(df, keys), keys, value, probabilities, extra=spread)


def dimension_values(
    df: DataFrame, dims: Sequence[str] = ("gpu_type", "task", "system", "concurrency")
) -> DataFrame:
    """Distinct values of each dimension, from one pass over the distinct cells."""
    cells = df.groupBy(*dims).agg(F.count(F.lit(1)).alias("n"))
    pairs = F.array(
        *[
            F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value"))
            for d in dims
        ]
    )
    return (
        cells.select("n", F.explode(pairs).alias("p"))
        .groupBy("p.dimension", "p.value")
        .agg(F.sum("n").alias("requests"))
        .filter(F.col("value").isNotNull())
    )


def record_counts(df: DataFrame) -> DataFrame:
    """Rows loaded under each of the three loading rules."""
    return df.agg(
        F.count(F.lit(1)).alias("all_rows"),
        F.count_if(views.is_valid()).alias("valid_rows"),
        F.count_if(F.col("ttft_ms").isNotNull()).alias("weakly_valid_rows"),
        F.count_if(F.coalesce(F.col("trial") != S.QUALITY_TRIAL, F.lit(True))).alias("summary_rows"),
    )
