import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from armlens.operators import compare, coverage, report
from armlens.operators.summary import Metric


def cell(tps, system="baseline", concurrency=1, task="chat", gpu="A100", **more):
    return {"tokens_per_sec": tps, "system": system, "concurrency": concurrency, "task": task, "gpu_type": gpu, **more}


def test_extended_summary_row(requests_of):
    # Means of a published cell: 92.44 and 264.96 tok/s at acceptance 0.4263.
    log = requests_of(
        cell(92.0), cell(92.88), cell(264.0, "eagle3", acceptance_rate=0.4263),
        cell(265.92, "eagle3", acceptance_rate=0.4263), cell(1.0, concurrency=4),
    )
    (row,) = compare.extended_summary(log).collect()
    assert row.asDict() == {
        "gpu": "A100", "task": "chat", "concurrency": 1, "baseline_tps": 92.44, "spec_tps": 264.96,
        "speedup_actual": 2.866, "speedup_theoretical": 2.196, "acceptance_rate": 0.426,
        "overhead_vs_theory_pct": -30.6,
    }


def test_ratio_of_means_not_mean_of_ratios(requests_of):
    log = requests_of(cell(10.0), cell(30.0), cell(20.0, "eagle3"), cell(40.0, "eagle3"))
    row = compare.speedups(log).first()
    assert row.speedup == pytest.approx(1.5)
    assert row.theory is None and row.overhead_pct is None


def test_grid_keeps_missing_cells(spark, requests_of):
    cells = compare.speedups(requests_of(cell(10.0), cell(20.0, "eagle3"))).select("gpu_type", "task", "concurrency", "speedup")
    got = compare.on_grid(coverage.comparison_grid(spark, ["A100"]), cells)
    assert got.count() == 15 and got.filter("speedup is not null").count() == 1


def test_crossover(requests_of):
    log = requests_of(
        cell(10.0), cell(20.0, "eagle3"), cell(10.0, concurrency=8), cell(9.0, "eagle3", 8),
        cell(10.0, concurrency=16), cell(5.0, "eagle3", 16),
        cell(1.0, task="code"), cell(2.0, "eagle3", task="code"),
        cell(1.0, task="summarization"),
        cell(5.0, "mlx_baseline", gpu="mac"), cell(4.0, "mlx_spec", gpu="mac"),
    )
    got = rows(compare.crossover(log), "gpu_type", "task")
    assert got == [
        ("A100", "chat", "eagle3", 8, True, "8"),
        ("A100", "code", "eagle3", None, False, ">32 (Never Crossed)"),
        ("mac", "chat", "mlx_spec", 1, True, "1"),
    ]


def test_crossover_without_shared_concurrency(requests_of):
    got = rows(compare.crossover(requests_of(cell(1.0), cell(2.0, "eagle3", 4))))
    assert got == [("A100", "chat", "eagle3", None, False, ">32 (Never Crossed)")]


def test_crossover_reports_first_crossing_row(requests_of):
    # Two treatments and two baselines: ordered by baseline system, then concurrency.
    log = requests_of(
        cell(10.0, "baseline", 8), cell(50.0, "mlx_baseline", 4),
        cell(20.0, "eagle3", 4), cell(30.0, "mlx_spec", 4), cell(11.0, "eagle3", 8), cell(9.0, "mlx_spec", 8),
    )
    (row,) = compare.crossover(log).collect()
    assert (row.crossover_concurrency, row.speculative_system) == (4, "mlx_spec")


def test_verdict(requests_of):
    log = requests_of(
        cell(10.0, tpot_ms=20.0, gpu_cost_usd=0.1),
        cell(30.0, "eagle3", tpot_ms=10.0, gpu_cost_usd=0.05, acceptance_rate=0.45),
        cell(10.0, concurrency=32, tpot_ms=5.0), cell(9.0, "eagle3", 32, tpot_ms=10.0),
        cell(10.0, concurrency=4), cell(9.0, "eagle3", 4, tpot_ms=None),
    )
    win, lose = compare.verdict(log).orderBy("concurrency").collect()
    assert win.headline == "2.00× per token | 3.00× throughput | 50% cheaper | 45% accepted"
    assert lose.headline == "no gain over the baseline, 0.50×"
    assert (win["class"], lose["class"], lose.win) == ("faster", "slower", False)


def test_metric_deltas(requests_of):
    log = requests_of(cell(10.0, ttft_ms=5.0), cell(30.0, "eagle3", ttft_ms=8.0))
    got = {r.metric: (r.delta, r.improved) for r in compare.metric_deltas(log).collect()}
    assert got == {"tokens_per_sec": (20.0, True), "ttft_ms": (3.0, False), "tpot_ms": (0.0, False)}


def test_signed_labels(requests_of):
    log = requests_of(cell(10.0, ttft_ms=8.0, tpot_ms=1.25), cell(9.96, "eagle3", ttft_ms=5.5, tpot_ms=1.5))
    got = {r.metric: r.label for r in compare.metric_deltas(log).collect()}
    assert got == {m: f % d for m, f, d in (("tokens_per_sec", "%+.1f tok/s", 9.96 - 10), ("ttft_ms", "%+.0f ms", -2.5), ("tpot_ms", "%+.1f ms", 0.25))}


def test_race_pairs_once_per_key(spark, requests_of):
    log = requests_of(
        cell(1.0, total_latency_ms=300.0, request_id="a_c1_t1"), cell(1.0, total_latency_ms=999.0, request_id="b_c1_t1"),
        cell(1.0, "eagle3", total_latency_ms=100.0, request_id="a_c1_t1"),
        cell(1.0, "eagle3", total_latency_ms=1.0, error="x", request_id="b_c1_t1"),
    )
    from armlens.functions.text import prompt_id

    got = compare.race(log.withColumn("prompt_id", prompt_id("request_id"))).collect()
    assert [(r.prompt_id, r.speedup, r.winner) for r in got] == [("a", 3.0, "spec")]


def test_frontier_handles_ties(requests_of):
    log = requests_of(
        cell(10.0, gpu_cost_usd=1.0), cell(30.0, "eagle3", gpu_cost_usd=0.5),
        cell(30.0, gpu="L4", gpu_cost_usd=0.5), cell(20.0, "eagle3", gpu="L4", gpu_cost_usd=0.5),
        cell(40.0, gpu="T4", gpu_cost_usd=2.0), cell(5.0, "eagle3", gpu="T4", gpu_cost_usd=0.1),
    )
    got = {(r.gpu_type, r.system): r.on_frontier for r in compare.cost_frontier(log).collect()}
    assert got == {
        ("A100", "baseline"): False, ("A100", "eagle3"): True, ("L4", "baseline"): True,
        ("L4", "eagle3"): False, ("T4", "baseline"): True, ("T4", "eagle3"): True,
    }


def test_trend_and_hardware(requests_of):
    log = requests_of(
        cell(10.0), cell(30.0, "eagle3", acceptance_rate=0.4), cell(10.0, concurrency=4), cell(20.0, "eagle3", 4),
        cell(5.0, "eagle3", gpu="L4", acceptance_rate=0.3),
    )
    assert [r.change for r in compare.speedup_trend(log).orderBy("concurrency").collect()] == [None, -1.0]
    row = compare.cross_hardware(log).filter("concurrency = 1").first()
    assert row.alpha_gap == pytest.approx(0.1) and row.right_spec_vs_left_base == pytest.approx(0.5)


def test_grid_and_coverage(spark, requests_of):
    grid = coverage.experiment_grid(spark, ("A100", "mac"), ("chat",), (1, 4), (1,))
    assert grid.count() == 8
    assert {r.system for r in grid.filter("gpu_type = 'mac'").collect()} == {"mlx_baseline", "mlx_spec"}
    log = requests_of(cell(1.0), cell(1.0, concurrency=4), cell(1.0, "other"))
    status = {(r.system, r.concurrency): r.status for r in coverage.coverage(grid, log).collect()}
    assert status["baseline", 1] == "done" and status["baseline", 4] == "short" and status["eagle3", 1] == "missing"
    assert coverage.missing_cells(grid, log).count() == 6
    assert [r.system for r in coverage.unexpected_cells(grid, log).collect()] == ["other"]
    progress = {(r.gpu_type, r.system): r.share_done for r in coverage.progress(coverage.coverage(grid, log)).collect()}
    assert progress["A100", "baseline"] == 0.5
    bad = rows(coverage.domain_violations(log), "column")
    assert bad == [("system", "other", 1)]


def test_missing_inputs(spark):
    prompts = spark.createDataFrame([("chat",)], "task string")
    assert sorted(r.task for r in coverage.missing_inputs(prompts).collect()) == ["code", "summarization"]


def test_labels(requests_of):
    log = requests_of(cell(10.0), cell(23.3, "eagle3", acceptance_rate=0.5))
    row = report.summary_labels(compare.extended_summary(log)).first()
    assert (row.task, row.speedup, row.acceptance, row.overhead) == ("Chat", "2.33×", "50%", "+0.1%")


def test_attempts_pair_by_number(requests_of):
    log = requests_of(
        cell(1.0, total_latency_ms=300.0, request_id="a_c1_t1"), cell(1.0, total_latency_ms=100.0, request_id="a_c1_t1x"),
        cell(1.0, "eagle3", total_latency_ms=100.0, request_id="a_c1_t1"), cell(1.0, "eagle3", total_latency_ms=200.0, request_id="a_c1_t1x"),
        cell(1.0, "eagle3", total_latency_ms=None, request_id="b_c1_t1"), cell(1.0, total_latency_ms=10.0, request_id="b_c1_t1"),
        cell(1.0, total_latency_ms=10.0, request_id="c_c1_t1"),
    ).withColumn("prompt_id", F.substring("request_id", 1, 1))
    got = sorted(((r.prompt_id, r.speedup, r.winner) for r in compare.race(log).collect()), key=str)
    assert got == [("a", 0.5, "base"), ("a", 3.0, "spec"), ("b", None, None)]
    left = [(r.prompt_id, r.base_unpaired, r.spec_unpaired) for r in compare.unpaired_requests(log, ["prompt_id"]).collect()]
    assert left == [("c", 1, 0)]


def test_rows_without_a_trial_stay(requests_of):
    from armlens.operators import summary, views

    log = requests_of({"trial": None}, {"trial": 99}, {"trial": 1})
    assert views.without_trials(log).count() == 2 and summary.record_counts(log).first().summary_rows == 2


def test_interval_over_two_systems(requests_of):
    import numpy as np

    from armlens.operators import series

    rates = {"eagle3": [0.3, 0.5, 0.4], "mlx_spec": [0.1, 0.2]}
    log = requests_of(*[{"system": s, "acceptance_rate": r} for s, some in rates.items() for r in some])
    got = series.chart_series(log).filter("series = 'acceptance'").collect()
    values = np.array([r for some in rates.values() for r in some])
    half = 2.776 * values.std(ddof=1) / np.sqrt(5)
    assert [(r.n, round(r.mean, 9), round(r.ci_high, 9)) for r in got] == [(5, round(values.mean(), 9), round(values.mean() + half, 9))]


def test_skyline_next_to_all_pairs(spark):
    rng = random.Random(8)
    points = [(k, *(float(rng.randrange(12)) for _ in range(3))) for k in range(700)] + [(700, None, 99.0, 0.0), (701, 11.0, 11.0, 0.0), (702, 11.0, 11.0, 0.0)]
    df = spark.createDataFrame(points, "id int, a double, b double, c double").repartition(5)
    metrics = (Metric("a", higher_is_better=True), Metric("b", higher_is_better=True), Metric("c"))
    got = sorted(r.id for r in compare.skyline(df, metrics, fan_in=3).collect())

    def beats(p, q):
        x, y = ((r[1], r[2], -r[3]) for r in (p, q))
        return None not in x and None not in y and all(i >= j for i, j in zip(x, y)) and x != y

    assert got == [p[0] for p in points if not any(beats(q, p) for q in points)]
    assert {700, 701, 702} <= set(got)
    assert not compare.skyline(df.limit(0), metrics).collect()
