"""The tables behind the charts, in one long format, from one pass over the log."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armlens import schema as S
from armlens.functions.numeric import ratio
from armlens.operators import views
from armlens.operators.compare import theory
from armlens.operators.intervals import T_975, Z_975
from armlens.operators.summary import dashboard_means, keyed

def _cells(df: DataFrame) -> DataFrame:
    """Sums, counts and deviations per (gpu, task, system, concurrency)."""
    valid, priced = views.is_valid(), views.is_priced()
    values = {
        "tps": F.col("tokens_per_sec"),
        "ttft": F.col("ttft_ms"),
        "tpot": F.col("tpot_ms"),
        "acc": F.col("acceptance_rate"),
        "cost_1m": F.when(priced, views.cost_per(1e6)),
        "valid_tps": F.when(valid, F.col("tokens_per_sec")),
        "valid_acc": F.when(valid, F.col("acceptance_rate")),
        "cost_1k": F.when(valid & priced, views.cost_per(1e3)),
    }
    aggs = []
    for name, value in values.items():
        aggs += [
            F.sum(value).alias(f"{name}_sum"),
            F.count(value).alias(f"{name}_n"),
            F.stddev_samp(value).alias(f"{name}_std"),
        ]
    return keyed(df, S.SERIES_KEY).groupBy(*S.SERIES_KEY).agg(*aggs)


def _entry(series: str, metric: str, name: str, keep_task=True, keep_system=True, when=None, side=None) -> Column:
    """One series row of a cell. ``side`` marks the part a ratio is built from."""
    text = F.lit(None).cast("string")
    row = F.struct(
        F.lit(series).alias("series"),
        F.lit(metric).alias("metric"),
        (F.col("task") if keep_task else text).alias("task"),
        (F.col("system") if keep_system else text).alias("system"),
        F.lit(side or "").alias("side"),
        F.col(f"{name}_sum").alias("total"),
        F.col(f"{name}_n").alias("n"),
        F.col(f"{name}_std").alias("std"),
    )
    known = F.col(f"{name}_n") > 0
    return F.when(known if when is None else known & when, row)


def _merged_deviation(n: Column, total: Column, std: Column) -> Column:
    """Sample deviation of parts put together: the spread inside the parts and between their means."""
    inside = F.sum((n - 1) * F.coalesce(std, F.lit(0.0)) * F.coalesce(std, F.lit(0.0)))
    between = F.sum(total * total / n) - F.sum(total) * F.sum(total) / F.sum(n)
    spread = F.sqrt((inside + F.greatest(between, F.lit(0.0))) / (F.sum(n) - 1))
    return F.when(F.count(F.lit(1)) == 1, F.max(std)).when(F.sum(n) > 1, spread)


def chart_series(df: DataFrame) -> DataFrame:
    """(series, metric, gpu_type, task, system, concurrency, n, mean, ci_low, ci_high).

    Cells are computed once. Each cell emits the rows of every series it belongs
    to, and a second, small grouping puts coarser series together from sums.
    """
    arm = views.arm()
    base, spec = arm == "base", arm == "spec"
    entries = [
        _entry("throughput", "tokens_per_sec", "tps"),
        _entry("first_token", "ttft_ms", "ttft"),
        _entry("per_token", "tpot_ms", "tpot"),
        _entry("cost_per_1m", "cost_usd", "cost_1m"),
        _entry("acceptance", "acceptance_rate", "acc", keep_system=False),
        _entry("valid_acceptance", "acceptance_rate", "valid_acc", keep_system=False, when=spec),
        _entry("theory", "speedup", "valid_acc", keep_system=False, when=spec),
        _entry("speedup", "speedup", "valid_tps", keep_system=False, when=base, side="base"),
        _entry("speedup", "speedup", "valid_tps", keep_system=False, when=spec, side="spec"),
        _entry("cost_per_1k", "cost_usd", "cost_1k", keep_task=False),
    ]
    rows = (
        _cells(df)
        .select("gpu_type", "concurrency", "task", "system", F.explode(F.array(*entries)).alias("e"))
        .filter(F.col("e").isNotNull())
    )

    def part(value: str, side: str | None = None) -> Column:
        return F.sum(F.col(f"e.{value}") if side is None else F.when(F.col("e.side") == side, F.col(f"e.{value}")))

    merged = rows.groupBy(
        "e.series", "e.metric", "gpu_type", "e.task", "e.system", "concurrency"
    ).agg(
        part("n").alias("n"),
        (part("total") / part("n")).alias("_mean"),
        ratio(
            part("total", "spec") / part("n", "spec"), part("total", "base") / part("n", "base")
        ).alias("_ratio"),
        _merged_deviation(F.col("e.n"), F.col("e.total"), F.col("e.std")).alias("_std"),
    )
    t = F.when(F.col("n") > len(T_975) + 1, F.lit(Z_975)).otherwise(
        F.get(F.array(*[F.lit(v) for v in T_975]), (F.col("n") - 2).cast("int"))
    )
    has_interval = F.col("series").isin("throughput", "first_token", "per_token", "acceptance")
    half = F.when(has_interval, t * F.col("_std") / F.sqrt(F.col("n").cast("double")))
    mean = (
        F.when(F.col("series") == "speedup", F.col("_ratio"))
        .when(F.col("series") == "theory", theory(F.col("_mean")))
        .otherwise(F.col("_mean"))
    )
    return merged.select(
        "series",
        "metric",
        "gpu_type",
        "task",
        "system",
        "concurrency",
        "n",
        mean.alias("mean"),
        (mean - half).alias("ci_low"),
        (mean + half).alias("ci_high"),
    )


def dashboard_series(df: DataFrame) -> DataFrame:
    """The dashboard's lines: mean first-token time and throughput per concurrency."""
    rows = dashboard_means(df)
    entries = F.array(
        *[
            F.struct(F.lit(m).alias("metric"), F.col(m).alias("mean"))
            for m in ("ttft_ms", "tokens_per_sec")
        ]
    )
    return rows.select("gpu_type", "task", "system", "concurrency", F.inline(entries))


def rouge_bars(summary: DataFrame, systems=("baseline", "eagle3")) -> DataFrame:
    """Bar heights; a system without scores gets zeros."""
    scores = ("rouge1", "rouge2", "rougeL")
    wanted = summary.sparkSession.createDataFrame([(s,) for s in systems], "system string")
    bars = wanted.join(summary, "system", "left").fillna(0.0, list(scores))
    entries = F.array(*[F.struct(F.lit(s).alias("metric"), F.col(s).alias("score")) for s in scores])
    return bars.select("system", F.inline(entries))
