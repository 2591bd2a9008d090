"""Comparison of a baseline arm with a treatment arm.

Both arms come out of one grouped pass with conditional aggregates, so the two
sides are aligned without a join.
"""

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from armlens import schema as S
from armlens.functions.numeric import exact_round, half_even, percent, ratio, times
from armlens.operators import views
from armlens.operators.summary import COST, TPOT, TPS, TTFT, Metric, cell_tps, keyed, means


def both_arms(
    df: DataFrame,
    keys: Sequence[str] = tuple(S.PAIR_CELL),
    metrics: Sequence[Metric] = (TPS,),
    base: str = S.BASE_PATTERN,
    spec: str = S.SPEC_PATTERN,
) -> DataFrame:
    """One row per key: rows, cost and mean of each metric for both arms, and the
    acceptance rate of the treatment."""
    rows = keyed(df, keys).withColumn("_arm", views.arm(base, spec)).dropna(subset=["_arm"])

    def only(side: str, value: Column) -> Column:
        return F.when(F.col("_arm") == side, value)

    aggs = [F.count(only(side, F.lit(1))).alias(f"n_{side}") for side in ("base", "spec")]
    for m in metrics:
        for side in ("base", "spec"):
            aggs.append(F.avg(only(side, m.column)).alias(f"{m.name}_{side}"))
    cost = F.coalesce(F.col("gpu_cost_usd"), F.lit(0.0))
    aggs += [F.sum(only(side, cost)).alias(f"cost_{side}") for side in ("base", "spec")]
    aggs.append(F.avg(only("spec", F.col("acceptance_rate"))).alias("alpha"))
    return rows.groupBy(*keys).agg(*aggs)


def aligned(arms: DataFrame) -> DataFrame:
    """Keep cells both arms have rows in."""
    return arms.filter((F.col("n_base") > 0) & (F.col("n_spec") > 0))


def theory(alpha: Column, k: int = S.DRAFT_TOKENS) -> Column:
    return (1 + alpha * k) / (1 + alpha)


def expected_tokens(alpha: Column, k: int = S.DRAFT_TOKENS, draft_cost: float = 0.0) -> Column:
    """The published expected improvement (Leviathan et al. 2023), as an option."""
    gain = F.when(alpha == 1, F.lit(float(k + 1))).otherwise(
        ratio(1 - F.pow(alpha, F.lit(k + 1)), 1 - alpha)
    )
    return gain / F.lit(k * draft_cost + 1.0)


def break_even(speedup: Column) -> Column:
    return (
        F.when(speedup > 1, "faster").when(speedup < 1, "slower").when(speedup == 1, "equal")
    )


def speedups(df: DataFrame, k: int = S.DRAFT_TOKENS, **arms) -> DataFrame:
    """Ratio of mean throughputs per cell with theory and the gap between them."""
    cells = aligned(both_arms(views.valid_requests(df), **arms))
    return cells.withColumn("speedup", ratio("tokens_per_sec_spec", "tokens_per_sec_base")).withColumns(
        {"theory": theory(F.col("alpha"), k)}
    ).withColumn("overhead_pct", (1 - ratio("speedup", "theory")) * 100)


def extended_summary(df: DataFrame, k: int = S.DRAFT_TOKENS, **arms) -> DataFrame:
    """The A/B summary table with report rounding."""
    return speedups(df, k, **arms).select(
        F.col("gpu_type").alias("gpu"),
        "task",
        "concurrency",
        half_even("tokens_per_sec_base", 2).alias("baseline_tps"),
        half_even("tokens_per_sec_spec", 2).alias("spec_tps"),
        half_even("speedup", 3).alias("speedup_actual"),
        half_even("theory", 3).alias("speedup_theoretical"),
        half_even("alpha", 3).alias("acceptance_rate"),
        half_even("overhead_pct", 1).alias("overhead_vs_theory_pct"),
    )


def on_grid(grid: DataFrame, cells: DataFrame) -> DataFrame:
    """Every expected cell; a cell without both arms keeps NULL values."""
    return grid.join(cells, [c for c in S.PAIR_CELL if c in grid.columns], "left")


def arms_per_cell(df: DataFrame) -> DataFrame:
    """Mean throughput of each system, gathered per (gpu, task, concurrency).

    The arrays hold one entry per system name that exists, not per request.
    """
    cells = cell_tps(df).withColumn("_arm", views.arm())
    entry = F.struct("system", "tokens_per_sec")

    def gathered(side: str) -> Column:
        return F.sort_array(F.collect_list(F.when(F.col("_arm") == side, entry)))

    return cells.groupBy(*S.PAIR_CELL).agg(
        gathered("base").alias("bases"), gathered("spec").alias("specs")
    )


def crossover(df: DataFrame) -> DataFrame:
    """Smallest concurrency at which a baseline beats a treatment, per (gpu, task)."""
    cells = arms_per_cell(df)
    beaten = F.filter(
        "specs", lambda s: s["tokens_per_sec"] < F.col("b")["tokens_per_sec"]
    )
    meetings = (
        cells.select(*S.PAIR_CELL, "specs", F.explode_outer("bases").alias("b"))
        .withColumn("_loser", F.get(beaten, F.lit(0))["system"])
        .withColumn("_first_spec", F.array_min(F.transform("specs", lambda s: s["system"])))
    )
    crossed = F.col("_loser").isNotNull()
    return (
        meetings.groupBy("gpu_type", "task")
        .agg(
            F.min(F.when(crossed, F.col("concurrency"))).alias("crossover_concurrency"),
            F.min_by(
                "_loser", F.when(crossed, F.struct("b.system", "concurrency"))
            ).alias("_crossed_by"),
            F.min("_first_spec").alias("_any_spec"),
            F.count("b.system").alias("_bases"),
        )
        .filter(F.col("_any_spec").isNotNull() & (F.col("_bases") > 0))
        .select(
            "gpu_type",
            "task",
            F.coalesce("_crossed_by", "_any_spec").alias("speculative_system"),
            "crossover_concurrency",
            F.col("crossover_concurrency").isNotNull().alias("crossed"),
            F.coalesce(
                F.col("crossover_concurrency").cast("string"),
                F.lit(f">{max(S.CONCURRENCIES)} (Never Crossed)"),
            ).alias("label"),
        )
    )


def paired_tps(df: DataFrame) -> DataFrame:
    """Baseline and treatment throughput side by side for every pair of systems."""
    cells = cell_tps(df).withColumn("_arm", views.arm())
    base = cells.filter(F.col("_arm") == "base").select(
        *S.PAIR_CELL,
        F.col("system").alias("system_base"),
        F.col("tokens_per_sec").alias("tokens_per_sec_base"),
    )
    spec = cells.filter(F.col("_arm") == "spec").select(
        *S.PAIR_CELL,
        F.col("system").alias("system_spec"),
        F.col("tokens_per_sec").alias("tokens_per_sec_spec"),
    )
    return base.join(spec, S.PAIR_CELL)


def verdict(df: DataFrame, keys: Sequence[str] = ("gpu_type", "concurrency"), **arms) -> DataFrame:
    """Per-token and overall speedup, cost saving and a one-line verdict."""
    both = aligned(both_arms(df, keys, (TPOT, TPS, TTFT), **arms))
    present = (F.col("tpot_ms_base") > 0) & (F.col("tpot_ms_spec") > 0)
    out = both.filter(present).withColumns(
        {
            "tpot_speedup": ratio("tpot_ms_base", "tpot_ms_spec"),
            "tps_speedup": F.when(
                (F.col("tokens_per_sec_spec") > 0) & (F.col("tokens_per_sec_base") > 0),
                ratio("tokens_per_sec_spec", "tokens_per_sec_base"),
            ),
            "cost_saving_pct": (1 - ratio("cost_spec", "cost_base")) * 100,
        }
    )
    win = F.col("tpot_speedup") >= 1.0
    parts = F.concat_ws(
        " | ",
        F.concat(times("tpot_speedup"), F.lit(" per token")),
        F.concat(times("tps_speedup"), F.lit(" throughput")),
        F.when(
            F.col("cost_saving_pct") > 0,
            F.concat(percent(half_even(F.col("cost_saving_pct"), 0) / 100), F.lit(" cheaper")),
        ),
        F.when(F.col("alpha") > 0, F.concat(percent(half_even("alpha", 2)), F.lit(" accepted"))),
    )
    return out.select(
        *keys,
        "tpot_speedup",
        "tps_speedup",
        "cost_saving_pct",
        "alpha",
        break_even(F.col("tpot_speedup")).alias("class"),
        win.alias("win"),
        F.when(win, parts)
        .otherwise(F.concat(F.lit("no gain over the baseline, "), times("tpot_speedup")))
        .alias("headline"),
    )


def metric_deltas(
    df: DataFrame,
    keys: Sequence[str] = ("gpu_type", "task", "concurrency"),
    metrics: Sequence[Metric] = (TPOT, TPS, TTFT),
    **arms,
) -> DataFrame:
    """Long table of treatment minus baseline per metric, with the better direction and a signed label."""
    rows = aligned(both_arms(df, keys, metrics, **arms))
    entries = F.array(
        *[
            F.struct(
                F.lit(m.name).alias("metric"),
                F.col(f"{m.name}_base").alias("base"),
                F.col(f"{m.name}_spec").alias("spec"),
                F.lit(m.higher_is_better).alias("higher_is_better"),
                F.lit(DELTA_LABELS.get(m.name, (1, ""))[0]).alias("digits"),
                F.lit(DELTA_LABELS.get(m.name, (1, ""))[1]).alias("unit"),
            )
            for m in metrics
        ]
    )
    delta = F.col("spec") - F.col("base")
    out = rows.select(*keys, F.inline(entries)).withColumn("delta", delta)
    return out.select(
        *keys,
        "metric",
        "base",
        "spec",
        "delta",
        F.when(F.col("higher_is_better"), delta > 0).otherwise(delta < 0).alias("improved"),
        _signed("delta").alias("label"),
    )


#: Digits and unit of a metric's signed label.
DELTA_LABELS = {"tpot_ms": (1, " ms"), "tokens_per_sec": (1, " tok/s"), "ttft_ms": (0, " ms")}


def _signed(name: str) -> Column:
    """A value with its sign, rounded to the ``digits`` of its row and followed by its ``unit``."""
    sign = F.when(F.col(name) < 0, "-").otherwise("+")
    whole, one = (F.format_string(f"%.{d}f", F.abs(exact_round(name, d))) for d in (0, 1))
    return F.when(F.col(name).isNotNull(), F.concat(sign, F.when(F.col("digits") == 0, whole).otherwise(one), "unit"))


def attempts(df: DataFrame, key: Sequence[str], **arms) -> DataFrame:
    """Rows of both arms with ``attempt``: the number of the request within its key and arm, by
    request id. A third attempt of one arm pairs with the third of the other."""
    rows = keyed(df, key).withColumn("_arm", views.arm(**arms)).dropna(subset=["_arm"])
    place = Window.partitionBy(*key, "_arm").orderBy("request_id")
    return rows.withColumn("attempt", F.row_number().over(place))


def paired_requests(df: DataFrame, key: Sequence[str], carry: Sequence[str], **arms) -> DataFrame:
    """The same request in both arms, joined on the key and the attempt."""
    rows = attempts(df, key, **arms).select(*key, "attempt", "_arm", *carry)
    on = [*key, "attempt"]
    base, spec = (
        rows.filter(F.col("_arm") == side).drop("_arm").withColumnsRenamed({c: f"{c}_{side}" for c in carry})
        for side in ("base", "spec")
    )
    return base.join(spec, on).drop("attempt")


def unpaired_requests(df: DataFrame, key: Sequence[str], **arms) -> DataFrame:
    """Attempts of each key that the other arm has no partner for; keys without any are left out."""
    seen = keyed(df, key).withColumn("_arm", views.arm(**arms)).groupBy(*key).agg(
        F.count_if(F.col("_arm") == "base").alias("base"), F.count_if(F.col("_arm") == "spec").alias("spec")
    )
    extra = {
        "base_unpaired": F.greatest(F.col("base") - F.col("spec"), F.lit(0)),
        "spec_unpaired": F.greatest(F.col("spec") - F.col("base"), F.lit(0)),
    }
    return seen.filter("base <> spec").withColumns(extra).drop("base", "spec")


PAIR_KEY = ["gpu_type", "task", "prompt_id", "concurrency", "trial"]


def race(df: DataFrame, key: Sequence[str] = tuple(PAIR_KEY), **arms) -> DataFrame:
    """Wall-clock winner of each request pair; none where a latency is missing or 0."""
    done = df.filter(F.col("error").isNull())
    pairs = paired_requests(done, key, ["total_latency_ms"], **arms)
    speedup = ratio("total_latency_ms_base", "total_latency_ms_spec")
    return pairs.withColumn("speedup", speedup).withColumn(
        "winner",
        F.when(F.col("speedup") > 1, "spec").when(F.col("total_latency_ms_base") > 0, F.when(F.col("speedup") <= 1, "base")),
    )


def ttft_overhead(df: DataFrame, keys: Sequence[str] = tuple(S.PAIR_CELL), **arms) -> DataFrame:
    rows = aligned(both_arms(views.valid_requests(df), keys, (TTFT,), **arms))
    return rows.select(
        *keys,
        ratio("ttft_ms_spec", "ttft_ms_base").alias("ttft_ratio"),
        (F.col("ttft_ms_spec") - F.col("ttft_ms_base")).alias("ttft_extra_ms"),
    )


def _beaten(points: np.ndarray, by: np.ndarray) -> np.ndarray:
    at_least = (by[None] >= points[:, None]).all(axis=2)
    return (at_least & (by[None] > points[:, None]).any(axis=2)).any(axis=1)


def _undominated(points: np.ndarray) -> np.ndarray:
    """Which rows no other row reaches in every column and passes in one; equal rows all stay. A row with
    a missing value neither beats nor is beaten."""
    known = ~np.isnan(points).any(axis=1)
    stays = np.ones(len(points), bool)
    # A row that is beaten is also beaten by one that stays, and that one has the larger sum of ranks.
    ranks = sum(np.unique(c, return_inverse=True)[1] for c in points.T) if len(points) else np.zeros(0)
    best = np.zeros((0, points.shape[1]))
    order = np.flatnonzero(known)[np.argsort(-ranks[known], kind="stable")]
    for at in range(0, len(order), 256):
        some = order[at : at + 256]
        stays[some] = ~_beaten(points[some], best)
        for place in some[stays[some]]:
            stays[place] = not _beaten(points[place : place + 1], best)[0]
            if stays[place]:
                best = np.vstack([best, points[place]])
    return stays


def skyline(points: DataFrame, metrics: Sequence[Metric], fan_in: int = 8) -> DataFrame:
    """The rows that no other row beats in all of ``metrics`` at once.

    A task keeps the skyline of its rows, and tasks meet by ``fan_in`` until one is left, so
    what moves are rows that may still belong to the result.
    """
    names = [f"_m{i}" for i in range(len(metrics))]
    signed = [(m.column if m.higher_is_better else -m.column).cast("double").alias(n) for m, n in zip(metrics, names)]
    rows = points.select("*", *signed)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for batch in batches:
            some = pa.Table.from_batches([batch])
            some = some if kept is None else pa.concat_tables([kept, some])
            values = np.column_stack([some.column(n).to_numpy(zero_copy_only=False).astype(float) for n in names])
            kept = some.filter(pa.array(_undominated(values)))
        if kept is not None:
            yield from kept.to_batches()

    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = rows.mapInArrow(keep, rows.schema)
    while tasks > 1:
        tasks = -(-tasks // fan_in)
        out = out.repartition(tasks).mapInArrow(keep, rows.schema)
    return out.drop(*names)


def cost_frontier(df: DataFrame, metrics: Sequence[Metric] = (TPS, COST)) -> DataFrame:
    """Configurations and their mean metrics; on the frontier are those that no other one beats in all of them."""
    keys = ["gpu_type", "system"]
    points = means(views.valid_requests(df), keys, metrics)
    best = skyline(points, metrics).select(*keys, F.lit(True).alias("on_frontier"))
    return points.join(best, keys, "left").withColumn("on_frontier", F.coalesce("on_frontier", F.lit(False)))


def speedup_trend(df: DataFrame, **arms) -> DataFrame:
    """How the speedup moves from one concurrency to the next."""
    along = Window.partitionBy("gpu_type", "task").orderBy("concurrency")
    cells = speedups(df, **arms).select(*S.PAIR_CELL, "speedup")
    previous = F.lag("speedup").over(along)
    return cells.withColumn("previous", previous).withColumn(
        "change", F.col("speedup") - F.col("previous")
    )


def cross_hardware(df: DataFrame, left: str = "A100", right: str = "L4") -> DataFrame:
    """Acceptance on two kinds of hardware, and the right one's treatment arm
    against the left one's baseline."""
    rows = keyed(views.valid_requests(df), S.PAIR_CELL).withColumn("_arm", views.arm())

    def mean(gpu: str, side: str, value: str) -> Column:
        at = (F.col("gpu_type") == gpu) & (F.col("_arm") == side)
        return F.avg(F.when(at, F.col(value)))

    out = rows.filter(F.col("gpu_type").isin(left, right)).groupBy("task", "concurrency").agg(
        mean(left, "spec", "acceptance_rate").alias("alpha_left"),
        mean(right, "spec", "acceptance_rate").alias("alpha_right"),
        mean(left, "base", "tokens_per_sec").alias("_left_base"),
        mean(right, "spec", "tokens_per_sec").alias("_right_spec"),
    )
    return out.select(
        "task",
        "concurrency",
        "alpha_left",
        "alpha_right",
        (F.col("alpha_left") - F.col("alpha_right")).alias("alpha_gap"),
        ratio("_right_spec", "_left_base").alias("right_spec_vs_left_base"),
    )


