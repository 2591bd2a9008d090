"""Exact quantiles per group by radix selection.

A value is a 64-bit number with the same order. Every pass counts rows by 16 more of its bits, but only
rows that begin like one of the values that are looked for, and finds the interval of values that
holds each wanted rank. Four passes end at the values themselves. What a pass shuffles is a table of
counts, whatever the size of a group and the number of probabilities.
"""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from armlens.session import shared_dir

BITS = 16
PASSES = 64 // BITS
MANTISSA = 52
LEAST_EXPONENT = -1022


def with_ordered_bits(rows: DataFrame, value: str = "_v", name: str = "_bits") -> DataFrame:
    """Add a double as a long of the same order: its bits for what is not negative, the negated bits of
    the absolute value else. Both zeros are 0; NaN is above infinity."""
    size = F.abs(F.col(value))
    # Step by step, so that no step is worked out again wherever the next one names it.
    rows = rows.withColumn("_e", F.greatest(F.floor(F.log2(size)), F.lit(LEAST_EXPONENT)))
    rows = rows.withColumn("_p", F.pow(F.lit(2.0), F.col("_e")))
    # log2 may round to the neighbouring exponent; the powers themselves are exact.
    high, low = F.col("_p") > size, F.col("_p") * 2 <= size
    rows = rows.withColumns(
        {
            "_e": F.when(high, F.col("_e") - 1).when(low, F.col("_e") + 1).otherwise(F.col("_e")),
            "_p": F.when(high, F.col("_p") / 2).when(low, F.col("_p") * 2).otherwise(F.col("_p")),
        }
    )
    mantissa = (size / F.col("_p") - 1) * 2.0**MANTISSA
    normal = (F.col("_e") - LEAST_EXPONENT + 1).cast("long") * F.lit(1 << MANTISSA) + mantissa.cast("long")
    tiny = (size * 2.0**537 * 2.0**537).cast("long")
    bits = (
        F.when(F.isnan(value), F.lit(0x7FF8 << 48))
        .when(size == float("inf"), F.lit(0x7FF0 << 48))
        .when(size < 2.0**LEAST_EXPONENT, tiny)
        .otherwise(normal)
    )
    rows = rows.withColumn(name, bits).drop("_e", "_p")
    return rows.withColumn(name, F.when(F.col(value) < 0, -F.col(name)).otherwise(F.col(name)))


def _written(df: DataFrame) -> DataFrame:
    path = shared_dir(df.sparkSession, "ranks")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _narrowed(rows: DataFrame, wanted: DataFrame, keys: list[str], step: int) -> DataFrame:
    """The intervals that hold the wanted ranks after ``step`` passes: keys, ``_prefix``, how many rows are
    below it, the ranks in it, and in the end its value."""
    within = F.shiftright("_bits", 64 - BITS * (step - 1)) if step > 1 else F.lit(0).cast("long")
    prefix = F.shiftright("_bits", 64 - BITS * step) if step < PASSES else F.col("_bits")
    counted = (
        rows.withColumn("_prefix", within)
        .join(wanted, [*keys, "_prefix"])
        .groupBy(*keys, "_prefix", prefix.alias("_next"))
        .agg(F.count(F.lit(1)).alias("_c"), F.max("_v").alias("_v"), F.max("_below").alias("_below"), F.max("_ranks").alias("_ranks"))
    )
    upto = Window.partitionBy(*keys, "_prefix").orderBy("_next")
    below = F.col("_below") + F.sum("_c").over(upto) - F.col("_c")
    placed = counted.withColumn("_below", below)
    mine = F.filter("_ranks", lambda r: (r >= F.col("_below")) & (r < F.col("_below") + F.col("_c")))
    found = placed.withColumn("_ranks", mine).filter(F.size("_ranks") > 0)
    return found.select(*keys, F.col("_next").alias("_prefix"), "_below", "_ranks", "_v")


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: Sequence[float],
    extra: Mapping[str, Column] | None = None,
) -> DataFrame:
    """One row per group with columns p10, p50, ... (linear interpolation).

    ``extra`` are numeric aggregates over ``_v``. Rows without a value count nowhere, and rows with a
    missing key belong to no group.
    """
    keys, extra, probabilities = list(keys), dict(extra or {}), list(probabilities)
    rows = with_ordered_bits(df.select(*keys, F.col(value).cast("double").alias("_v")).filter("_v is not null"))
    # Keys and one number of each row, so that the passes do not work out the input again.
    rows = _written(rows)
    groups = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[e.alias(n) for n, e in extra.items()])
    groups = _written(groups)  # one row per group, joined and joined back
    last = F.col("_n") - 1
    place = {p: last * F.lit(p) for p in probabilities}
    low = {p: F.floor(place[p]) for p in probabilities}
    high = {p: F.least(low[p] + 1, last) for p in probabilities}
    ranks = F.array_distinct(F.array(*[r[p] for p in probabilities for r in (low, high)]))
    wanted = groups.select(*keys, F.lit(0).cast("long").alias("_prefix"), F.lit(0).cast("long").alias("_below"), ranks.alias("_ranks"))
    for step in range(1, PASSES + 1):
        # Small, and of a known size for the next pass's join.
        wanted = _written(_narrowed(rows, wanted.drop("_v"), keys, step))
    values = F.map_from_entries(F.flatten(F.collect_list(F.transform("_ranks", lambda r: F.struct(r, F.col("_v"))))))
    out = groups.join(wanted.groupBy(*keys).agg(values.alias("_at")), keys)
    quantiles = []
    for p in probabilities:
        below, above = F.element_at("_at", low[p]), F.element_at("_at", high[p])
        between = below + (above - below) * (place[p] - low[p])
        between = F.when(below == above, below).otherwise(between)
        quantiles.append(between.alias(f"p{round(p * 100):02d}"))
    return out.select(*keys, *extra, *quantiles)
