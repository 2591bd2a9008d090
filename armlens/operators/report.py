"""Report labels and previews."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from armlens.functions.numeric import half_even, percent, times, usd


def summary_labels(summary: DataFrame) -> DataFrame:
    """Readable labels for the A/B summary rows."""
    return summary.select(
        "gpu",
        F.initcap("task").alias("task"),
        "concurrency",
        times("speedup_actual").alias("speedup"),
        percent(half_even("acceptance_rate", 2)).alias("acceptance"),
        F.format_string("%+.1f%%", "overhead_vs_theory_pct").alias("overhead"),
    )


def cost_labels(costs: DataFrame, value: str = "cost_per_1k") -> DataFrame:
    return costs.withColumn("label", usd(value, 4))


def failure_panel(failed: DataFrame) -> DataFrame:
    """How many requests failed and the first message, per system."""
    return failed.groupBy("system").agg(
        F.count(F.lit(1)).alias("failed"),
        F.min_by("error", "request_id").alias("first_error"),
    )


def text_preview(df: DataFrame, text: str = "output_text", chars: int = 500) -> DataFrame:
    return df.withColumn("preview", F.substring(F.col(text), 1, chars)).drop(text)
