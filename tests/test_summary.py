import statistics

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from armlens.operators import intervals, series, summary, views
from armlens.functions import hashing
from armlens.operators import quantiles
from armlens.operators.summary import Metric
from armlens.operators.quantiles import exact_quantiles


@pytest.fixture(scope="module")
def log(requests_of):
    return requests_of(
        {"tokens_per_sec": 10.0, "ttft_ms": 1.0},
        {"tokens_per_sec": 20.0, "ttft_ms": 3.0},
        {"tokens_per_sec": None, "ttft_ms": None, "tpot_ms": None, "output_tokens": 0, "error": "down"},
        {"system": "eagle3", "tokens_per_sec": 60.0, "acceptance_rate": 0.4},
        {"system": "eagle3", "trial": 99, "tokens_per_sec": 1.0},
        {"gpu_type": "V9", "tokens_per_sec": 5.0, "gpu_cost_usd": 0.0},
        {"gpu_type": None},
    )


def test_filters(log):
    assert views.valid_requests(log).count() == 6
    assert views.weakly_valid_requests(log).count() == 6
    assert views.priced_requests(log).count() == 6
    assert views.failures(log).count() == 1
    assert views.without_trials(log).count() == 6
    assert views.without_trials(log, ()).count() == 7
    assert views.with_acceptance(log).count() == 1
    assert views.sliced(log, gpu_type=["L4"], system=["eagle3"]).count() == 2


def test_summary_has_sample_deviation_and_no_null_group(log):
    got = {(r.gpu_type, r.system): r for r in summary.summary_stats(views.without_trials(log)).collect()}
    assert set(got) == {("L4", "baseline"), ("L4", "eagle3"), ("V9", "baseline")}
    base = got["L4", "baseline"]
    assert base.tokens_per_sec_mean == 15.0
    assert base.tokens_per_sec_std == pytest.approx(statistics.stdev([10, 20]))
    assert base.total_latency_ms_mean == 1000.0
    assert got["L4", "eagle3"].tokens_per_sec_std is None


def test_cost_counts_failed_requests(log):
    got = rows(summary.cost_summary(views.without_trials(log)), "gpu_type", "system")
    assert [(g, s, n) for g, s, _, n in got] == [("L4", "baseline", 3), ("L4", "eagle3", 1), ("V9", "baseline", 1)]
    assert got[0][2] == pytest.approx(0.003)


def test_cost_is_mean_of_ratios(requests_of):
    log = requests_of(
        {"gpu_cost_usd": 0.1, "output_tokens": 10},
        {"gpu_cost_usd": 0.1, "output_tokens": 40},
        {"gpu_cost_usd": 0.1, "output_tokens": 0},
    )
    got = summary.mean_cost(log, ["gpu_type"], 1000, "c").first()
    assert got.c == pytest.approx((10 + 2.5) / 2)
    assert summary.cost_per_token(log).first().cost_per_1k_tokens == pytest.approx(6.25)


def test_cell_report_divides_by_rows_with_first_token(requests_of):
    log = requests_of(
        {"tokens_per_sec": 10.0},
        {"tokens_per_sec": 0.0},
        {"tokens_per_sec": None},
        {"ttft_ms": None, "tokens_per_sec": 100.0},
    )
    got = summary.cell_report(log).first()
    assert (got.completed, got.sent) == (3, 4)
    assert got.avg_tps == pytest.approx(10 / 3)


def test_cost_of_unknown_hardware_is_zero(spark):
    df = spark.createDataFrame([("A100", 10.0), ("none", 10.0)], "gpu_type string, latency_s double")
    got = {r.gpu_type: r.gpu_cost_usd for r in views.with_cost(df).collect()}
    assert got == {"A100": round(3.67 / 3600 * 10, 8), "none": 0.0}


def test_failed_rows_keep_cost_only(log):
    got = views.as_failed_where(log, F.col("system") == "eagle3").filter("system = 'eagle3'").first()
    assert (got.ttft_ms, got.tokens_per_sec, got.output_tokens, got.gpu_cost_usd) == (None, None, 0, 0.001)


def test_union_fills_missing_columns(log):
    both = views.all_arms(log, log.drop("output_text"))
    assert both.count() == 14 and both.filter("output_text is null").count() == 7


def test_dimension_values(log):
    got = rows(summary.dimension_values(log), "dimension", "value")
    assert ("system", "eagle3", 2) in got and ("gpu_type", "L4", 5) in got
    assert all(value is not None for _, value, _ in got)


def test_ordered_bits(spark):
    tiny = 5e-324
    edges = [0.0, -0.0, tiny, -tiny, 2.2250738585072014e-308, 2.225073858507201e-308, 1.0, -1.0, 0.1, 3.0, 1 / 3, 1e308, -1e308, float("inf"), -float("inf")]
    edges += [float(2.0**e) for e in range(-1074, 1024, 13)] + [float(np.nextafter(2.0**e, 0)) for e in range(-1000, 1024, 17)]
    rng = np.random.default_rng(2)
    drawn = rng.integers(0, 0x7FF0 << 48, 3000).view(np.float64)
    values = [*edges, *map(float, drawn), *map(float, -drawn)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r[1] for r in quantiles.with_ordered_bits(df, "v").collect()]
    raw = [int(np.float64(abs(v)).view(np.int64)) for v in values]
    assert got == [-b if v < 0 else b for v, b in zip(values, raw)]
    (_, nan) = quantiles.with_ordered_bits(spark.createDataFrame([(float("nan"),)], "v double"), "v").first()
    assert nan > max(got)


def test_exact_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(3)
    groups = {
        "skewed": np.exp(rng.normal(size=4000) * 3),
        "ties": rng.integers(0, 5, 900).astype(float),
        "one": np.array([7.0]),
        "flat": np.full(50, 2.5),
        "two": np.array([1.0, 2.0]),
        "signed": rng.normal(size=3000) * 1e-3,
        "near": 1.0 + rng.integers(0, 40, 2000) * 2.0**-52,
    }
    data = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("flat", None)]
    df = spark.createDataFrame(data, "g string, v double").repartition(6)
    probabilities = [0.0, 0.1, 0.5, 0.9, 1.0]
    got = {r.g: r for r in exact_quantiles(df, ["g"], "v", probabilities).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        for p, name in zip(probabilities, ("p00", "p10", "p50", "p90", "p100")):
            assert got[g][name] == pytest.approx(np.quantile(values, p), rel=1e-12)


def test_quantiles_of_many_groups(spark):
    df = spark.range(60_000).selectExpr("id % 3 as g", "cast(id as double) as v")
    got = rows(exact_quantiles(df, ["g"], "v", [0.5]), "g")
    assert [p for _, p in got] == [np.median(np.arange(g, 60_000, 3)) for g in range(3)]


def test_normal_interval(spark):
    values = [1.0, 2.0, 4.0, 9.0]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 5.0)], "g string, x double")
    a, b = intervals.normal_interval(df, "x", ["g"]).orderBy("g").collect()
    half = 3.182 * statistics.stdev(values) / 2
    assert (a.ci_low, a.ci_high) == (pytest.approx(4 - half), pytest.approx(4 + half))
    assert (b.mean, b.ci_low) == (5.0, None)


def test_bootstrap_is_stable_and_near_theory(spark):
    rng = np.random.default_rng(5)
    data = [("a", str(i), float(v)) for i, v in enumerate(rng.normal(10, 2, 4000))]
    df = spark.createDataFrame(data, "g string, id string, x double")
    args = dict(value="x", by="id", keys=["g"], replicates=200)
    first = intervals.bootstrap_interval(df, **args).first()
    again = intervals.bootstrap_interval(df.repartition(7), **args).first()
    assert [round(v, 9) for v in first[1:]] == [round(v, 9) for v in again[1:]]
    assert first.replicates == 200
    half = 1.96 * 2 / np.sqrt(4000)
    assert first.ci_high - first.ci_low == pytest.approx(2 * half, rel=0.3)
    assert first.ci_low < first.mean < first.ci_high and first.n == 4000


def test_bootstrap_next_to_plain_weights(spark):
    """Every replicate counts, also one that gives no row a weight; blocks draw together."""
    import hashlib

    data = [("one", "a", 3.0), *[("few", f"r{i}", float(i)) for i in range(4)], *[("many", f"m{i}", float(i % 7)) for i in range(60)]]
    df = spark.createDataFrame(data, "g string, id string, x double").withColumn("block", F.substring("id", 1, 2))

    def plain(group, key):
        means = []
        values = [(key(i), x) for g, i, x in data if g == group]
        for a, c in hashing.draw_numbers(50, 9):
            draws = [(sum((int(hashlib.md5(k.encode()).hexdigest()[:8], 16) % hashing.PRIME * a + c) % hashing.PRIME >= cut for cut in hashing.poisson_cuts()), x) for k, x in values]
            total = sum(w for w, _ in draws)
            means.append(sum(w * x for w, x in draws) / total if total else sum(x for _, x in values) / len(values))
        return np.quantile(means, [0.025, 0.975])

    for by, key in (("id", lambda i: i), ("block", lambda i: i[:2])):
        for r in intervals.bootstrap_interval(df, Metric("twice", "x * 2"), ["g"], by, 50, 9).collect():
            assert r.replicates == 50
            assert (r.ci_low, r.ci_high) == pytest.approx(tuple(2 * plain(r.g, key)), abs=1e-12)


def test_rouge_bars_fill_missing_system(spark):
    table = spark.createDataFrame([("baseline", 0.3, 0.1, 0.2)], "system string, rouge1 double, rouge2 double, rougeL double")
    got = rows(series.rouge_bars(table), "system", "metric")
    assert got[0] == ("baseline", "rouge1", 0.3) and got[-1] == ("eagle3", "rougeL", 0.0)


def test_chart_series_ratio_and_cost(requests_of):
    log = requests_of(
        {"tokens_per_sec": 10.0, "task": "chat"},
        {"tokens_per_sec": 30.0, "task": "chat"},
        {"tokens_per_sec": 60.0, "task": "chat", "system": "eagle3", "acceptance_rate": 0.5},
        {"task": "code", "gpu_cost_usd": 0.002},
    )
    got = {(r.series, r.task, r.system): r for r in series.chart_series(log).collect()}
    assert got["speedup", "chat", None].mean == pytest.approx(3.0)
    assert got["theory", "chat", None].mean == pytest.approx(3.5 / 1.5)
    assert got["cost_per_1k", None, "baseline"].mean == pytest.approx((0.01 + 0.01 + 0.02) / 3)
    assert got["throughput", "chat", "baseline"].n == 2
    assert got["throughput", "chat", "eagle3"].ci_low is None
