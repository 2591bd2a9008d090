"""95 % intervals of the mean per cell."""

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from armlens import schema as S
from armlens.functions.hashing import PRIME, hash32, poisson_draws
from armlens.functions.numeric import ratio
from armlens.operators.summary import Metric, keyed

# 97.5 % points of Student's t for 1 to 30 degrees of freedom.
T_975 = (
    12.706, 4.303, 3.182, 2.776, 2.571, 2.447, 2.365, 2.306, 2.262, 2.228,
    2.201, 2.179, 2.160, 2.145, 2.131, 2.120, 2.110, 2.101, 2.093, 2.086,
    2.080, 2.074, 2.069, 2.064, 2.060, 2.056, 2.052, 2.048, 2.045, 2.042,
)
Z_975 = 1.96


def _valued(df: DataFrame, value: str | Metric, keys: Sequence[str], *more: str) -> DataFrame:
    """Keys and ``_x``, the metric or column, where there is one."""
    x = value.column if isinstance(value, Metric) else F.col(value)
    return keyed(df, keys).select(*keys, *more, x.cast("double").alias("_x")).filter("_x is not null")


def normal_interval(
    df: DataFrame, value: str | Metric, keys: Sequence[str] = tuple(S.SERIES_KEY)
) -> DataFrame:
    """mean ± t * s / sqrt(n) of a column or any metric; one row gives a mean and no interval."""
    table = F.array(*[F.lit(t) for t in T_975])
    out = _valued(df, value, keys).groupBy(*keys).agg(
        F.count("_x").alias("n"),
        F.avg("_x").alias("mean"),
        F.stddev_samp("_x").alias("_s"),
    )
    t = F.when(F.col("n") > len(T_975) + 1, F.lit(Z_975)).otherwise(
        F.get(table, (F.col("n") - 2).cast("int"))
    )
    half = t * F.col("_s") / F.sqrt(F.col("n").cast("double"))
    return out.select(
        *keys,
        "n",
        "mean",
        (F.col("mean") - half).alias("ci_low"),
        (F.col("mean") + half).alias("ci_high"),
    )


def _weighted_sums(keys: list[str], replicates: int, seed: int):
    """Of each batch of rows (keys, ``_x``, ``_h``) and key, the weighted sum and the weights' sum per replicate."""

    def batch_sums(batch: pa.RecordBatch) -> pa.RecordBatch:
        code = np.zeros(batch.num_rows, np.int64)
        for k in keys:
            coded = batch.column(k).dictionary_encode()
            code = np.unique(code * len(coded.dictionary) + coded.indices.to_numpy(), return_inverse=True)[1]
        order = np.argsort(code, kind="stable")
        starts = np.flatnonzero(np.diff(code[order], prepend=-1))
        weights = poisson_draws(batch.column("_h").to_numpy()[order], replicates, seed)
        x = batch.column("_x").to_numpy()[order]
        sums = np.add.reduceat(weights * x[:, None], starts, axis=0)
        counts = np.add.reduceat(weights, starts, axis=0)
        first = pa.array(order[starts])
        lists = [pa.array(list(v)) for v in (sums, counts)]
        return pa.RecordBatch.from_arrays([*(batch.column(k).take(first) for k in keys), *lists], [*keys, "_s", "_c"])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch_sums(batch)

    return make


def bootstrap_interval(
    df: DataFrame,
    value: str | Metric,
    keys: Sequence[str] = tuple(S.SERIES_KEY),
    by: str = "request_id",
    replicates: int = 100,
    seed: int = S.SAMPLE_SEED,
) -> DataFrame:
    """Seeded Poisson bootstrap of the mean, of a column or any metric.

    Every row draws its weight in each replicate from the hash of ``by``: rows are resampled one
    by one where it names them, and as blocks where it names a block of rows (a trial, a prompt). A
    batch of rows becomes one vector of weighted sums and one of weights per key, and vectors are added
    element by element, so no row is sent anywhere. A replicate in which no row has a weight
    counts each row once.
    """
    keys = list(keys)
    h = F.pmod(hash32(F.col(by).cast("string")), F.lit(PRIME))
    rows = _valued(df, value, keys, by).select(*keys, "_x", h.alias("_h"))
    vectors = T.StructType([*rows.select(*keys).schema.fields]).add("_s", T.ArrayType(T.DoubleType())).add("_c", T.ArrayType(T.LongType()))
    parts = rows.mapInArrow(_weighted_sums(keys, replicates, seed), vectors)
    each = parts.select(*keys, F.posexplode(F.arrays_zip("_s", "_c")).alias("at", "_p"))
    means = each.groupBy(*keys, "at").agg(ratio(F.sum("_p._s"), F.sum("_p._c").cast("double")).alias("_m")).filter("_m is not null")
    sampled = means.groupBy(*keys).agg(F.array_sort(F.collect_list("_m")).alias("_m"))
    plain = rows.groupBy(*keys).agg(F.count("_x").alias("n"), F.avg("_x").alias("mean"))
    out = plain.join(sampled, keys, "left")
    drawn_means = F.coalesce("_m", F.array().cast("array<double>"))
    rest = F.array_repeat("mean", F.lit(replicates) - F.size(drawn_means))
    out = out.withColumn("_m", F.array_sort(F.concat(drawn_means, rest)))

    def at(p: float) -> Column:
        place = p * (replicates - 1)
        low, high = F.get("_m", F.lit(int(place))), F.get("_m", F.lit(min(int(place) + 1, replicates - 1)))
        return low + (high - low) * (place - int(place))

    return out.select(
        *keys, "n", "mean", F.size("_m").cast("bigint").alias("replicates"), at(0.025).alias("ci_low"), at(0.975).alias("ci_high")
    )
