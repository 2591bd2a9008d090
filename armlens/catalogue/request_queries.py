"""Queries over the request log (adapter: lineitem)."""

from pyspark.sql import functions as F

from armlens import schema as S
from armlens.catalogue import adapters as A
from armlens.catalogue.registry import div, exact_r, query, r, tidy
from armlens.functions.hashing import PRIME, draw_numbers, poisson_cuts
from armlens.functions.text import prompt_id, request_id
from armlens.operators import (
    compare,
    coverage,
    intervals,
    report,
    series,
    summary,
    views,
)
from armlens.sources import requests as source
from armlens.sources import tables
from armlens.session import shared_dir
from armlens.streaming import jobs

REQ = f"WITH requests AS ({A.REQUESTS_SQL}), counted AS (SELECT * FROM requests WHERE trial <> 99)"
VALID = "error IS NULL AND ttft_ms IS NOT NULL AND tokens_per_sec IS NOT NULL"
ARM = (
    "CASE WHEN regexp_matches(system, 'baseline') THEN 'base'"
    " WHEN regexp_matches(system, 'eagle3|mlx_spec') THEN 'spec' END"
)
WITH_ARM = f"{REQ}, armed AS (SELECT *, {ARM} AS arm FROM counted)"
GPUS = ("A100", "L4", "T4", "mac")


def log(spark, sf_dir):
    return A.requests(spark, sf_dir)


def counted(spark, sf_dir):
    """The log without the quality trial."""
    return views.without_trials(log(spark, sf_dir))


def avg_of(value: str, arm: str) -> str:
    return f"avg(CASE WHEN arm = '{arm}' THEN {value} END)"


def n_of(arm: str) -> str:
    return f"count(CASE WHEN arm = '{arm}' THEN 1 END)"


# --- loading, filters, derived columns -------------------------------------------

_LINE = (
    "SELECT *, CASE WHEN l_partkey % 97 = 2 THEN CAST(NULL AS DOUBLE) ELSE ttft_ms END AS seen_ttft"
    " FROM counted WHERE l_partkey % 97 NOT IN (0, 1)"
)


@query(
    f"""{REQ}
    SELECT system, count(*) AS n, count(error) AS failed, CAST(sum(output_tokens) AS BIGINT) AS tokens,
           {r('avg(seen_ttft)', 4)} AS avg_ttft_ms FROM ({_LINE}) GROUP BY system
    UNION ALL
    SELECT '(malformed)', count(*), 0, 0, NULL FROM requests WHERE l_partkey % 97 = 0"""
)
def requests_scan(spark, sf_dir):
    """Write the log as JSON lines, some of them blank, broken or with NaN, and load it."""
    rows = log(spark, sf_dir)
    fields = [f.name for f in S.REQUEST.fields]
    text = F.to_json(F.struct(*fields))
    with_nan = F.regexp_replace(text, r'"ttft_ms":[^,]+', '"ttft_ms":NaN')
    kind = F.col("l_partkey") % 97
    lines = rows.select(
        F.when(kind == 0, F.concat(F.substring(text, 1, 40), F.lit(" broken")))
        .when(kind == 1, "")
        .when(kind == 2, with_nan)
        .otherwise(text)
        .alias("value")
    )
    path = shared_dir(spark, "request-lines")
    source.write_raw_lines(lines, path)
    target = shared_dir(spark, "request-rows")
    source.sort_out(spark, path, target)
    loaded = source.read_sorted(spark, target)
    per_system = loaded.groupBy("system").agg(
        F.count(F.lit(1)).alias("n"),
        F.count("error").alias("failed"),
        F.sum("output_tokens").alias("tokens"),
        F.avg("ttft_ms").alias("avg_ttft_ms"),
    )
    bad = source.quarantined(spark, target).agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("(malformed)").alias("system"),
        "n",
        F.lit(0).cast("bigint").alias("failed"),
        F.lit(0).cast("bigint").alias("tokens"),
        F.lit(None).cast("double").alias("avg_ttft_ms"),
    )
    return tidy(per_system.unionByName(bad), 4)


_FILE = (
    "concat(system, '_', gpu_type, '_', task, '_c', lpad(CAST(concurrency + CASE WHEN l_partkey % 50 = 0"
    " THEN 1 ELSE 0 END AS STRING), 2, '0'), '_t', CAST(trial AS STRING), '.jsonl')"
)


@query(
    f"""{REQ} SELECT file_name, count(*) AS rows FROM (SELECT *, {_FILE} AS file_name FROM requests)
    WHERE l_partkey % 50 = 0 GROUP BY file_name"""
)
def cell_name_check(spark, sf_dir):
    """Result files, some of them misnamed, whose name disagrees with their rows."""
    path = shared_dir(spark, "result-files")
    source.write_result_files(log(spark, sf_dir), path, F.expr(_FILE))
    return coverage.cell_name_mismatches(source.with_file_name(spark, path))


@query(
    f"""{REQ} SELECT request_id, gpu_type, {exact_r('cost', 8)} AS gpu_cost_usd
    FROM (SELECT *, CASE gpu_type WHEN 'T4' THEN 0.35e0 WHEN 'L4' THEN 0.70e0 WHEN 'A100' THEN 3.67e0
    ELSE 0e0 END / 3600 * (total_latency_ms / 1000) AS cost FROM requests)"""
)
def request_cost(spark, sf_dir):
    """Cost of each request from the rate card; unknown hardware costs nothing."""
    rows = log(spark, sf_dir).select(
        "request_id", "gpu_type", (F.col("total_latency_ms") / 1000).alias("latency_s")
    )
    return views.with_cost(rows).select("request_id", "gpu_type", "gpu_cost_usd")


@query(
    f"""{REQ} SELECT request_id, regexp_extract(request_id, '^(.*)_c\\d+_t\\d+$', 1) AS prompt_id,
    request_id AS composed FROM requests"""
)
def prompt_ids(spark, sf_dir):
    """Take the prompt id out of a request id and put the request id together again."""
    rows = log(spark, sf_dir).select(
        "request_id", prompt_id("request_id").alias("prompt_id"), "concurrency", "trial"
    )
    return rows.select(
        "request_id", "prompt_id", request_id("prompt_id", "concurrency", "trial").alias("composed")
    )


@query(
    f"""{REQ} SELECT
      count(*) FILTER ({VALID}) AS valid_rows,
      count(*) FILTER (ttft_ms IS NOT NULL) AS weakly_valid_rows,
      count(*) FILTER (gpu_type IN ('L4', 'A100') AND task = 'code') AS sliced_rows,
      count(*) FILTER (acceptance_rate IS NOT NULL) AS accepted_rows,
      count(*) FILTER (gpu_cost_usd IS NOT NULL AND output_tokens > 0) AS priced_rows,
      count(*) FILTER (error IS NOT NULL) AS failed_rows FROM counted"""
)
def request_filters(spark, sf_dir):
    """Rows each filter keeps, from one scan."""
    rows = counted(spark, sf_dir)
    return rows.agg(
        F.count_if(views.is_valid()).alias("valid_rows"),
        F.count_if(F.col("ttft_ms").isNotNull()).alias("weakly_valid_rows"),
        F.count_if(F.col("gpu_type").isin("L4", "A100") & (F.col("task") == "code")).alias(
            "sliced_rows"
        ),
        F.count("acceptance_rate").alias("accepted_rows"),
        F.count_if(views.is_priced()).alias("priced_rows"),
        F.count("error").alias("failed_rows"),
    )


@query(
    f"""{REQ} SELECT system, task, concurrency, count(*) AS n, {r('avg(total_latency_ms)')} AS mean_latency_ms
    FROM counted WHERE {VALID} AND gpu_type IN ('A100', 'T4') AND concurrency IN (4, 16)
    GROUP BY system, task, concurrency"""
)
def request_slices(spark, sf_dir):
    """Valid requests of a multi-value selection."""
    rows = views.sliced(
        views.valid_requests(counted(spark, sf_dir)), gpu_type=["A100", "T4"], concurrency=[4, 16]
    )
    return tidy(
        rows.groupBy("system", "task", "concurrency").agg(
            F.count(F.lit(1)).alias("n"), F.avg("total_latency_ms").alias("mean_latency_ms")
        )
    )


@query(
    f"""{REQ} SELECT 'gpu_type' AS "column", gpu_type AS "value", count(*) AS "rows" FROM requests
    WHERE gpu_type NOT IN ('T4', 'L4', 'A100', 'mac') GROUP BY gpu_type
    UNION ALL SELECT 'trial', CAST(trial AS VARCHAR), count(*) FROM requests
    WHERE trial NOT IN (1, 2, 3) GROUP BY trial"""
)
def domain_violations(spark, sf_dir):
    """Values outside the accepted lists."""
    rules = {
        "system": S.SYSTEMS,
        "gpu_type": S.GPU_TYPES,
        "task": S.TASKS,
        "concurrency": S.CONCURRENCIES,
        "trial": S.TRIALS,
    }
    return coverage.domain_violations(log(spark, sf_dir), rules)


@query(
    f"""{REQ} SELECT system, count(*) AS failed, min_by(error, request_id) AS first_error FROM requests
    WHERE error IS NOT NULL GROUP BY system"""
)
def failures(spark, sf_dir):
    """Failed requests and the first message per system."""
    return report.failure_panel(views.failures(log(spark, sf_dir)))


@query(
    f"""{REQ} SELECT request_id, CASE WHEN l_partkey % 9 <> 0 THEN ttft_ms END AS ttft_ms,
    CASE WHEN l_partkey % 9 <> 0 THEN tpot_ms END AS tpot_ms,
    CASE WHEN l_partkey % 9 <> 0 THEN tokens_per_sec END AS tokens_per_sec,
    CASE WHEN l_partkey % 9 <> 0 THEN output_tokens ELSE 0 END AS output_tokens,
    {r('gpu_cost_usd', 8)} AS gpu_cost_usd FROM requests"""
)
def failed_shape(spark, sf_dir):
    """Rows marked as failed get the shape of a failure; the cost stays."""
    rows = views.as_failed_where(log(spark, sf_dir), F.col("l_partkey") % 9 == 0)
    return rows.select(
        "request_id",
        "ttft_ms",
        "tpot_ms",
        "tokens_per_sec",
        "output_tokens",
        (F.rint(F.col("gpu_cost_usd") * 1e8) / 1e8).alias("gpu_cost_usd"),
    )


@query(
    f"""{REQ} SELECT side, system, count(*) AS n, count(error) AS failed, {r('sum(gpu_cost_usd)')} AS cost_usd
    FROM (SELECT 'first' AS side, * FROM counted WHERE system IN ('baseline', 'mlx_baseline')
    UNION ALL SELECT 'second', * FROM counted WHERE system IN ('eagle3', 'mlx_spec')) GROUP BY side, system"""
)
def arm_union(spark, sf_dir):
    """Both arms' result lists as one; the second list lacks a column of the first."""
    rows = counted(spark, sf_dir)
    base = rows.filter(views.arm() == "base").withColumn("side", F.lit("first"))
    spec = rows.filter(views.arm() == "spec").withColumn("side", F.lit("second")).drop("output_text")
    both = views.all_arms(base, spec)
    return tidy(
        both.groupBy("side", "system").agg(
            F.count(F.lit(1)).alias("n"),
            F.count("error").alias("failed"),
            F.sum("gpu_cost_usd").alias("cost_usd"),
        )
    )


# --- summaries ---------------------------------------------------------------------

_STATS = ", ".join(
    f"{r(f'avg({c})')} AS {c}_mean, {r(f'stddev_samp({c})')} AS {c}_std"
    for c in ("ttft_ms", "tpot_ms", "tokens_per_sec")
)


@query(
    f"""{REQ} SELECT gpu_type, task, system, concurrency, {_STATS},
    {r('avg(total_latency_ms)')} AS total_latency_ms_mean, {r('avg(acceptance_rate)')} AS acceptance_rate_mean
    FROM counted GROUP BY gpu_type, task, system, concurrency"""
)
def summary_stats(spark, sf_dir):
    """Mean and deviation of the metrics per cell."""
    return tidy(summary.summary_stats(counted(spark, sf_dir)))


@query(
    f"""{REQ} SELECT gpu_type, system, {r('sum(gpu_cost_usd)')} AS total_cost_usd,
    count(request_id) AS total_requests FROM counted GROUP BY gpu_type, system"""
)
def cost_summary(spark, sf_dir):
    """Total cost and requests per hardware and system."""
    return tidy(summary.cost_summary(counted(spark, sf_dir)))


@query(
    f"""{REQ} SELECT system, gpu_type, task, concurrency, {r('avg(ttft_ms)')} AS ttft_ms,
    {r('avg(tpot_ms)')} AS tpot_ms, {r('avg(tokens_per_sec)')} AS tokens_per_sec,
    {r('avg(gpu_cost_usd)')} AS gpu_cost_usd FROM counted
    WHERE ttft_ms IS NOT NULL GROUP BY system, gpu_type, task, concurrency"""
)
def dashboard_means(spark, sf_dir):
    """Dashboard table of the whole log."""
    return tidy(summary.dashboard_means(counted(spark, sf_dir)))


@query(
    f"""{REQ} SELECT system, gpu_type, {r('avg(gpu_cost_usd / output_tokens) * 1000')} AS cost_per_1k_tokens
    FROM counted WHERE output_tokens > 0 GROUP BY system, gpu_type"""
)
def cost_per_token(spark, sf_dir):
    """Mean cost per token, shown per 1 000."""
    return summary.cost_per_token(counted(spark, sf_dir))


@query(
    f"""{REQ} SELECT gpu_type, system, concurrency, {r('avg(gpu_cost_usd / output_tokens * 1000)', 8)}
    AS cost_per_1k FROM counted WHERE {VALID} AND output_tokens > 0 GROUP BY gpu_type, system, concurrency"""
)
def cost_per_1k(spark, sf_dir):
    """Mean cost of 1 000 tokens of valid requests."""
    rows = views.valid_requests(counted(spark, sf_dir))
    return tidy(summary.mean_cost(rows, ["gpu_type", "system", "concurrency"], 1e3, "cost_per_1k"), 8)


@query(
    f"""{REQ} SELECT gpu_type, task, concurrency, system, {r('avg(gpu_cost_usd / output_tokens * 1000000)')}
    AS cost_per_1m FROM counted WHERE output_tokens > 0 GROUP BY gpu_type, task, concurrency, system"""
)
def cost_per_1m(spark, sf_dir):
    """Mean cost of 1 000 000 tokens."""
    keys = ["gpu_type", "task", "concurrency", "system"]
    return tidy(summary.mean_cost(counted(spark, sf_dir), keys, 1e6, "cost_per_1m"))


@query(
    f"""{REQ} SELECT gpu_type, task, concurrency, {r('avg(acceptance_rate)')} AS acceptance_rate FROM counted
    WHERE acceptance_rate IS NOT NULL GROUP BY gpu_type, task, concurrency"""
)
def acceptance_by_task(spark, sf_dir):
    """Mean acceptance rate per hardware, task and concurrency."""
    return tidy(summary.acceptance(counted(spark, sf_dir)))


@query(
    f"""{REQ} SELECT gpu_type, task, system, concurrency, {r('avg(tokens_per_sec)')} AS tokens_per_sec
    FROM counted GROUP BY gpu_type, task, system, concurrency"""
)
def cell_tps(spark, sf_dir):
    """Mean throughput per cell."""
    return tidy(summary.cell_tps(counted(spark, sf_dir)))


@query(
    f"""{REQ} SELECT system, gpu_type, task, concurrency, trial, count(ttft_ms) AS completed, count(*) AS sent,
    {r('avg(ttft_ms)')} AS avg_ttft_ms, {r('sum(gpu_cost_usd)')} AS total_cost_usd,
    {r('max(acceptance_rate)')} AS acceptance_rate,
    {r(div('sum(CASE WHEN ttft_ms IS NOT NULL THEN coalesce(tokens_per_sec, 0) END)', 'count(ttft_ms)'))} AS avg_tps
    FROM requests GROUP BY system, gpu_type, task, concurrency, trial"""
)
def cell_report(spark, sf_dir):
    """The run report of every cell."""
    return tidy(summary.cell_report(log(spark, sf_dir)))


@query(
    f"""{REQ} SELECT system, gpu_type, {r('avg(tpot_ms)')} AS avg_tpot_ms, {r('avg(tokens_per_sec)')} AS avg_tps,
    {r('avg(ttft_ms)')} AS avg_ttft_ms, {r('sum(coalesce(gpu_cost_usd, 0))')} AS cost_usd,
    count(error) AS failed, min_by(error, CASE WHEN error IS NOT NULL THEN request_id END) AS first_error
    FROM counted GROUP BY system, gpu_type"""
)
def arm_averages(spark, sf_dir):
    """Averages, cost and failures per arm."""
    return tidy(summary.arm_averages(counted(spark, sf_dir)))


@query(
    f"""{REQ} SELECT gpu_type, task, system, concurrency, count(*) AS n,
    {r(div('stddev_samp(ttft_ms)', 'avg(ttft_ms)'))} AS variation,
    {r('quantile_cont(ttft_ms, 0.1)')} AS p10, {r('quantile_cont(ttft_ms, 0.5)')} AS p50,
    {r('quantile_cont(ttft_ms, 0.9)')} AS p90
    FROM counted WHERE ttft_ms IS NOT NULL GROUP BY gpu_type, task, system, concurrency"""
)
def latency_tails(spark, sf_dir):
    """Spread and exact tails of the time to the first token."""
    return tidy(summary.latency_tails(counted(spark, sf_dir)))


@query(
    f"""{REQ} SELECT 'gpu_type' AS dimension, gpu_type AS "value", count(*) AS requests FROM requests GROUP BY 2
    UNION ALL SELECT 'task', task, count(*) FROM requests GROUP BY 2
    UNION ALL SELECT 'system', system, count(*) FROM requests GROUP BY 2
    UNION ALL SELECT 'concurrency', CAST(concurrency AS VARCHAR), count(*) FROM requests GROUP BY 2"""
)
def dimension_values(spark, sf_dir):
    """Distinct values of the dimensions."""
    return summary.dimension_values(log(spark, sf_dir))


@query(
    f"""{REQ} SELECT count(*) AS all_rows, count(*) FILTER ({VALID}) AS valid_rows,
    count(ttft_ms) AS weakly_valid_rows, count(*) FILTER (trial <> 99) AS summary_rows FROM requests"""
)
def record_counts(spark, sf_dir):
    """Rows under each loading rule."""
    return summary.record_counts(log(spark, sf_dir))


# --- intervals -------------------------------------------------------------------------

_T = "[" + ", ".join(f"{t}e0" for t in intervals.T_975) + "]"
_HALF = f"CASE WHEN n > 31 THEN 1.96e0 ELSE ({_T})[n - 1] END * s / sqrt(n)"


@query(
    f"""{REQ} SELECT gpu_type, task, system, concurrency, n, {r('m')} AS mean,
    CASE WHEN n > 1 THEN {r(f'm - {_HALF}')} END AS ci_low, CASE WHEN n > 1 THEN {r(f'm + {_HALF}')} END AS ci_high
    FROM (SELECT gpu_type, task, system, concurrency, count(tokens_per_sec) AS n, avg(tokens_per_sec) AS m,
    stddev_samp(tokens_per_sec) AS s FROM counted WHERE tokens_per_sec IS NOT NULL
    GROUP BY gpu_type, task, system, concurrency)"""
)
def ci_normal(spark, sf_dir):
    """Mean throughput with a t interval per cell."""
    return tidy(intervals.normal_interval(counted(spark, sf_dir), "tokens_per_sec"))


_DRAW = " + ".join(f"CAST(u >= {cut} AS INT)" for cut in poisson_cuts())
_NUMBERS = ", ".join(f"({b}, {x}, {y})" for b, (x, y) in enumerate(draw_numbers(100, S.SAMPLE_SEED)))


@query(
    f"""{REQ}, numbers AS (SELECT * FROM (VALUES {_NUMBERS}) t(b, x, y)),
    hashed AS (SELECT gpu_type, task, system, concurrency, tokens_per_sec AS v,
      CAST('0x' || substr(md5(request_id), 1, 8) AS BIGINT) % {PRIME} AS h FROM counted WHERE tokens_per_sec IS NOT NULL),
    plain AS (SELECT gpu_type, task, system, concurrency, count(*) AS n, avg(v) AS mean FROM hashed GROUP BY ALL),
    drawn AS (SELECT *, {_DRAW} AS w FROM (SELECT hashed.* EXCLUDE (h), b, (h * x + y) % {PRIME} AS u FROM hashed, numbers)),
    means AS (SELECT gpu_type, task, system, concurrency, b, sum(w * v) / sum(w) AS m FROM drawn WHERE w > 0 GROUP BY ALL)
    SELECT gpu_type, task, system, concurrency, n, {r('any_value(mean)')} AS mean, count(*) AS replicates,
    {r('quantile_cont(coalesce(m, mean), 0.025)')} AS ci_low, {r('quantile_cont(coalesce(m, mean), 0.975)')} AS ci_high
    FROM plain CROSS JOIN (SELECT b FROM numbers) LEFT JOIN means USING (gpu_type, task, system, concurrency, b)
    GROUP BY gpu_type, task, system, concurrency, n"""
)
def ci_bootstrap(spark, sf_dir):
    """Mean throughput with a seeded bootstrap interval per cell."""
    return tidy(intervals.bootstrap_interval(counted(spark, sf_dir), summary.TPS))


# --- comparison of the arms --------------------------------------------------------------

_CELLS = f"""{WITH_ARM}, cells AS (SELECT gpu_type, task, concurrency, {n_of('base')} AS n_base,
  {n_of('spec')} AS n_spec, {avg_of('tokens_per_sec', 'base')} AS b, {avg_of('tokens_per_sec', 'spec')} AS s,
  {avg_of('acceptance_rate', 'spec')} AS alpha, {avg_of('ttft_ms', 'base')} AS ttft_b,
  {avg_of('ttft_ms', 'spec')} AS ttft_s FROM armed WHERE {VALID} GROUP BY gpu_type, task, concurrency),
  aligned AS (SELECT *, s / nullif(b, 0) AS speedup, (1 + alpha * 5) / (1 + alpha) AS theory
  FROM cells WHERE n_base > 0 AND n_spec > 0)"""
_GRID = f"""(SELECT * FROM (SELECT unnest({list(GPUS)}) AS gpu_type),
  (SELECT unnest({list(S.TASKS)}) AS task), (SELECT CAST(unnest({list(S.CONCURRENCIES)}) AS INT) AS concurrency))"""


@query(
    f"""{_CELLS} SELECT gpu_type, task, concurrency, {r('speedup')} AS speedup,
    CASE WHEN speedup > 1 THEN 'faster' WHEN speedup < 1 THEN 'slower' WHEN speedup = 1 THEN 'equal' END AS class
    FROM {_GRID} LEFT JOIN aligned USING (gpu_type, task, concurrency)"""
)
def speedup_ratio(spark, sf_dir):
    """Speedup per cell on the full grid; a cell without both arms is NULL."""
    cells = compare.speedups(counted(spark, sf_dir)).select(*S.PAIR_CELL, "speedup")
    grid = compare.on_grid(coverage.comparison_grid(spark, GPUS), cells)
    return tidy(grid.withColumn("class", compare.break_even(F.col("speedup"))))


@query(
    f"""{_CELLS} SELECT gpu_type, task, concurrency, {r('speedup')} AS speedup, {r('theory')} AS theory,
    {r('(1 - power(alpha, 6)) / nullif(1 - alpha, 0)')} AS expected_tokens,
    {r('(1 - speedup / nullif(theory, 0)) * 100', 4)} AS overhead_pct FROM aligned"""
)
def theory_vs_actual(spark, sf_dir):
    """Measured speedup against both theory formulas."""
    rows = compare.speedups(counted(spark, sf_dir))
    return tidy(
        rows.select(
            *S.PAIR_CELL,
            "speedup",
            "theory",
            compare.expected_tokens(F.col("alpha")).alias("expected_tokens"),
            "overhead_pct",
        ),
        overhead_pct=4,
    )


@query(
    f"""{_CELLS} SELECT gpu_type AS gpu, task, concurrency, {r('b', 2)} AS baseline_tps, {r('s', 2)} AS spec_tps,
    {r('speedup', 3)} AS speedup_actual, {r('theory', 3)} AS speedup_theoretical, {r('alpha', 3)} AS acceptance_rate,
    {r('(1 - speedup / nullif(theory, 0)) * 100', 1)} AS overhead_vs_theory_pct FROM aligned"""
)
def ab_extended_summary(spark, sf_dir):
    """The A/B summary table."""
    return compare.extended_summary(counted(spark, sf_dir))


@query(
    f"""{_CELLS} SELECT gpu_type, task, concurrency, n_base, n_spec, {r('b')} AS base_tps, {r('s')} AS spec_tps,
    {r('(1 - speedup / nullif(theory, 0)) * 100', 4)} AS overhead_pct FROM aligned"""
)
def aligned_cells(spark, sf_dir):
    """Cells both arms have, with their row counts."""
    rows = compare.speedups(counted(spark, sf_dir))
    return tidy(
        rows.select(
            *S.PAIR_CELL,
            "n_base",
            "n_spec",
            F.col("tokens_per_sec_base").alias("base_tps"),
            F.col("tokens_per_sec_spec").alias("spec_tps"),
            "overhead_pct",
        ),
        overhead_pct=4,
    )


_TPS_CELLS = f"""{WITH_ARM}, tps AS (SELECT gpu_type, task, concurrency, arm, system, avg(tokens_per_sec) AS t
  FROM armed GROUP BY ALL)"""


@query(
    f"""{_TPS_CELLS}, merged AS (SELECT b.gpu_type, b.task, b.concurrency, b.system AS bs, s.system AS ss
      FROM tps b JOIN tps s USING (gpu_type, task, concurrency) WHERE b.arm = 'base' AND s.arm = 'spec' AND b.t > s.t),
    crossed AS (SELECT gpu_type, task, min(concurrency) AS c, arg_min(ss, (bs, concurrency, ss)) AS system
      FROM merged GROUP BY gpu_type, task),
    arms AS (SELECT gpu_type, task, min(CASE WHEN arm = 'spec' THEN system END) AS any_spec FROM tps
      GROUP BY gpu_type, task HAVING count(CASE WHEN arm = 'spec' THEN 1 END) > 0
      AND count(CASE WHEN arm = 'base' THEN 1 END) > 0)
    SELECT gpu_type, task, coalesce(system, any_spec) AS speculative_system, c AS crossover_concurrency,
    c IS NOT NULL AS crossed, coalesce(CAST(c AS VARCHAR), '>32 (Never Crossed)') AS label
    FROM arms LEFT JOIN crossed USING (gpu_type, task)"""
)
def crossover(spark, sf_dir):
    """Smallest concurrency at which the baseline is faster."""
    return compare.crossover(counted(spark, sf_dir))


@query(
    f"""{_TPS_CELLS} SELECT b.gpu_type, b.task, b.concurrency, b.system AS system_base, s.system AS system_spec,
    {r('b.t')} AS tokens_per_sec_base, {r('s.t')} AS tokens_per_sec_spec
    FROM tps b JOIN tps s USING (gpu_type, task, concurrency) WHERE b.arm = 'base' AND s.arm = 'spec'"""
)
def paired_tps(spark, sf_dir):
    """Baseline and treatment throughput joined on the cell."""
    return tidy(compare.paired_tps(counted(spark, sf_dir)))


_PCT = "printf('%.0f%%', {})"


@query(
    f"""{WITH_ARM}, v AS (SELECT gpu_type, concurrency, {avg_of('tpot_ms', 'base')} AS tb,
      {avg_of('tpot_ms', 'spec')} AS ts, {avg_of('tokens_per_sec', 'base')} AS pb,
      {avg_of('tokens_per_sec', 'spec')} AS ps, {avg_of('acceptance_rate', 'spec')} AS alpha,
      sum(CASE WHEN arm = 'base' THEN gpu_cost_usd END) AS cb, sum(CASE WHEN arm = 'spec' THEN gpu_cost_usd END) AS cs
      FROM armed GROUP BY gpu_type, concurrency HAVING {n_of('base')} > 0 AND {n_of('spec')} > 0),
    w AS (SELECT *, tb / ts AS tpot, ps / pb AS tps, (1 - cs / nullif(cb, 0)) * 100 AS saving FROM v
      WHERE tb > 0 AND ts > 0)
    SELECT gpu_type, concurrency, {r('tpot')} AS tpot_speedup, {r('tps')} AS tps_speedup,
    {r('saving', 4)} AS cost_saving_pct, {r('alpha')} AS alpha,
    CASE WHEN tpot > 1 THEN 'faster' WHEN tpot < 1 THEN 'slower' ELSE 'equal' END AS class, tpot >= 1 AS win,
    CASE WHEN tpot >= 1 THEN concat_ws(' | ', printf('%.2f×', tpot) || ' per token',
      printf('%.2f×', tps) || ' throughput',
      CASE WHEN saving > 0 THEN {_PCT.format('round_even(saving, 0)')} || ' cheaper' END,
      CASE WHEN alpha > 0 THEN {_PCT.format('round_even(alpha * 100, 0)')} || ' accepted' END)
    ELSE 'no gain over the baseline, ' || printf('%.2f×', tpot) END AS headline FROM w"""
)
def ab_verdict(spark, sf_dir):
    """Speedups, cost saving and a headline per hardware and concurrency."""
    return tidy(compare.verdict(counted(spark, sf_dir)), cost_saving_pct=4)


@query(
    f"""{WITH_ARM}, c AS (SELECT gpu_type, task, concurrency,
      {', '.join(f"{avg_of(m, a)} AS {m}_{a}" for m in ('tpot_ms', 'tokens_per_sec', 'ttft_ms') for a in ('base', 'spec'))}
      FROM armed GROUP BY gpu_type, task, concurrency HAVING {n_of('base')} > 0 AND {n_of('spec')} > 0),
    u AS ({' UNION ALL '.join(f"SELECT gpu_type, task, concurrency, '{m}' AS metric, {m}_base AS base, {m}_spec AS spec, {up} AS up FROM c" for m, up in (('tpot_ms', 'false'), ('tokens_per_sec', 'true'), ('ttft_ms', 'false')))})
    SELECT gpu_type, task, concurrency, metric, {r('base')} AS base, {r('spec')} AS spec, {r('spec - base')} AS delta,
    CASE WHEN up THEN spec - base > 0 ELSE spec - base < 0 END AS improved,
    CASE metric WHEN 'ttft_ms' THEN printf('%+.0f ms', spec - base) WHEN 'tpot_ms' THEN printf('%+.1f ms', spec - base)
    ELSE printf('%+.1f tok/s', spec - base) END AS label FROM u"""
)
def metric_deltas(spark, sf_dir):
    """Treatment minus baseline per metric."""
    return tidy(compare.metric_deltas(counted(spark, sf_dir)))


@query(
    f"""{WITH_ARM}, one AS (SELECT gpu_type, task, prompt_id, concurrency, trial, arm, total_latency_ms AS ms,
      row_number() OVER (PARTITION BY gpu_type, task, prompt_id, concurrency, trial, arm ORDER BY request_id) AS attempt
      FROM armed WHERE error IS NULL AND arm IS NOT NULL AND gpu_type IS NOT NULL AND task IS NOT NULL)
    SELECT gpu_type, task, prompt_id, concurrency, trial, {r('b.ms')} AS total_latency_ms_base,
    {r('s.ms')} AS total_latency_ms_spec, {r(div('b.ms', 's.ms'))} AS speedup,
    CASE WHEN b.ms / nullif(s.ms, 0) > 1 THEN 'spec' WHEN b.ms > 0 AND s.ms > 0 THEN 'base' END AS winner
    FROM one b JOIN one s USING (gpu_type, task, prompt_id, concurrency, trial, attempt)
    WHERE b.arm = 'base' AND s.arm = 'spec'"""
)
def race_winner(spark, sf_dir):
    """Which arm finished the same request first."""
    return tidy(compare.race(counted(spark, sf_dir)))


@query(
    f"""{WITH_ARM}, seen AS (SELECT gpu_type, task, prompt_id, concurrency, trial, count(*) FILTER (arm = 'base') AS b,
      count(*) FILTER (arm = 'spec') AS s FROM armed WHERE gpu_type IS NOT NULL AND task IS NOT NULL GROUP BY ALL)
    SELECT gpu_type, task, prompt_id, concurrency, trial, greatest(b - s, 0) AS base_unpaired,
    greatest(s - b, 0) AS spec_unpaired FROM seen WHERE b <> s"""
)
def unpaired_requests(spark, sf_dir):
    """Attempts of a request that have no partner in the other arm."""
    return compare.unpaired_requests(counted(spark, sf_dir), compare.PAIR_KEY)


@query(
    f"""{_CELLS} SELECT gpu_type, task, concurrency, {r(div('ttft_s', 'ttft_b'))} AS ttft_ratio,
    {r('ttft_s - ttft_b')} AS ttft_extra_ms FROM aligned"""
)
def ttft_overhead(spark, sf_dir):
    """What the treatment adds to the time to the first token."""
    return tidy(compare.ttft_overhead(counted(spark, sf_dir)))


@query(
    f"""{REQ}, p AS (SELECT gpu_type, system, avg(tokens_per_sec) AS tps, avg(gpu_cost_usd) AS cost FROM counted
      WHERE {VALID} GROUP BY gpu_type, system)
    SELECT gpu_type, system, {r('tps')} AS tps, {r('cost')} AS cost, NOT EXISTS (SELECT 1 FROM p q
      WHERE q.tps >= p.tps AND q.cost <= p.cost AND (q.tps > p.tps OR q.cost < p.cost)) AS on_frontier FROM p"""
)
def cost_frontier(spark, sf_dir):
    """Configurations not beaten in throughput and cost."""
    found = compare.cost_frontier(counted(spark, sf_dir))
    return tidy(found.withColumnsRenamed({"tokens_per_sec": "tps", "gpu_cost_usd": "cost"}))


@query(
    f"""{_CELLS}, t AS (SELECT gpu_type, task, concurrency, speedup,
      lag(speedup) OVER (PARTITION BY gpu_type, task ORDER BY concurrency) AS previous FROM aligned)
    SELECT gpu_type, task, concurrency, {r('speedup')} AS speedup, {r('previous')} AS previous,
    {r('speedup - previous')} AS change FROM t"""
)
def speedup_trend(spark, sf_dir):
    """Change of the speedup along concurrency."""
    return tidy(compare.speedup_trend(counted(spark, sf_dir)))


@query(
    f"""{WITH_ARM} SELECT task, concurrency, {r('l')} AS alpha_left, {r('q')} AS alpha_right, {r('l - q')} AS alpha_gap,
    {r(div('rs', 'lb'))} AS right_spec_vs_left_base FROM (SELECT task, concurrency,
      avg(CASE WHEN gpu_type = 'A100' AND arm = 'spec' THEN acceptance_rate END) AS l,
      avg(CASE WHEN gpu_type = 'L4' AND arm = 'spec' THEN acceptance_rate END) AS q,
      avg(CASE WHEN gpu_type = 'A100' AND arm = 'base' THEN tokens_per_sec END) AS lb,
      avg(CASE WHEN gpu_type = 'L4' AND arm = 'spec' THEN tokens_per_sec END) AS rs
      FROM armed WHERE {VALID} AND gpu_type IN ('A100', 'L4') GROUP BY task, concurrency)"""
)
def cross_hardware(spark, sf_dir):
    """The same metrics across two kinds of hardware."""
    return tidy(compare.cross_hardware(counted(spark, sf_dir)))


# --- grid and coverage ---------------------------------------------------------------------

_FULL_GRID = f"""grid AS (SELECT * FROM (SELECT unnest({list(GPUS)}) AS gpu_type),
  (SELECT unnest({list(S.SYSTEMS)}) AS system), (SELECT unnest({list(S.TASKS)}) AS task),
  (SELECT CAST(unnest({list(S.CONCURRENCIES)}) AS INT) AS concurrency),
  (SELECT CAST(unnest([1, 2, 3]) AS INT) AS trial) WHERE (gpu_type = 'mac') = (system LIKE 'mlx%'))"""
_OBSERVED = (
    "observed AS (SELECT system, gpu_type, task, concurrency, trial, count(*) AS n FROM requests"
    " GROUP BY system, gpu_type, task, concurrency, trial)"
)


@query(
    f"""{REQ}, {_FULL_GRID}, {_OBSERVED} SELECT gpu_type, system, task, concurrency, trial,
    CAST(concurrency AS BIGINT) AS expected_requests, coalesce(n, 0) AS observed_requests,
    CASE WHEN n IS NULL THEN 'missing' WHEN n < concurrency THEN 'short' ELSE 'done' END AS status
    FROM grid LEFT JOIN observed USING (system, gpu_type, task, concurrency, trial)"""
)
def experiment_grid(spark, sf_dir):
    """Every expected cell with what was observed."""
    return coverage.coverage(coverage.experiment_grid(spark, GPUS), log(spark, sf_dir))


@query(
    f"""{REQ}, {_FULL_GRID}, {_OBSERVED} SELECT gpu_type, system, count(*) FILTER (n >= concurrency) AS done_cells,
    count(*) AS total_cells, count(*) FILTER (n IS NULL) AS missing_cells,
    {r('count(*) FILTER (n >= concurrency) / count(*)')} AS share_done
    FROM grid LEFT JOIN observed USING (system, gpu_type, task, concurrency, trial) GROUP BY gpu_type, system"""
)
def coverage_gaps(spark, sf_dir):
    """Progress of the sweep per hardware and system."""
    covered = coverage.coverage(coverage.experiment_grid(spark, GPUS), log(spark, sf_dir))
    return tidy(coverage.progress(covered))


@query(
    f"""{REQ}, {_FULL_GRID}, {_OBSERVED}
    SELECT 'missing' AS kind, system, gpu_type, task, concurrency, trial FROM grid
      ANTI JOIN observed USING (system, gpu_type, task, concurrency, trial)
    UNION ALL SELECT 'unexpected', system, gpu_type, task, concurrency, trial FROM observed
      ANTI JOIN grid USING (system, gpu_type, task, concurrency, trial)"""
)
def grid_minus_observed(spark, sf_dir):
    """Expected cells not observed, and observed cells not expected."""
    rows, grid = log(spark, sf_dir), coverage.experiment_grid(spark, GPUS)
    missing = coverage.missing_cells(grid, rows).withColumn("kind", F.lit("missing"))
    extra = coverage.unexpected_cells(grid, rows).withColumn("kind", F.lit("unexpected"))
    return missing.unionByName(extra)


# --- charts and labels -------------------------------------------------------------------------


def _chart(name, metric, value, where="true", task="task", system="system", ci=False):
    mean = f"avg({value})"
    half = f"CASE WHEN n > 31 THEN 1.96e0 ELSE ({_T})[n - 1] END * s / sqrt(n)"
    low, high = (
        (f"CASE WHEN n > 1 THEN {r(f'm - {half}')} END", f"CASE WHEN n > 1 THEN {r(f'm + {half}')} END")
        if ci
        else ("CAST(NULL AS DOUBLE)", "CAST(NULL AS DOUBLE)")
    )
    return f"""SELECT '{name}' AS series, '{metric}' AS metric, gpu_type, {task} AS task, {system} AS system,
      concurrency, n, {r('m' if name != 'theory' else '(1 + m * 5) / (1 + m)', 5)} AS mean, {low} AS ci_low,
      {high} AS ci_high FROM (SELECT gpu_type, {task} AS task, {system} AS system, concurrency,
      count({value}) AS n, {mean} AS m, stddev_samp({value}) AS s FROM armed WHERE {value} IS NOT NULL AND {where}
      GROUP BY ALL)"""


_NONE = "CAST(NULL AS VARCHAR)"
_CHARTS = [
    _chart("throughput", "tokens_per_sec", "tokens_per_sec", ci=True),
    _chart("first_token", "ttft_ms", "ttft_ms", ci=True),
    _chart("per_token", "tpot_ms", "tpot_ms", ci=True),
    _chart("cost_per_1m", "cost_usd", "gpu_cost_usd / nullif(output_tokens, 0) * 1000000"),
    _chart("valid_acceptance", "acceptance_rate", "acceptance_rate", f"{VALID} AND arm = 'spec'", system=_NONE),
    _chart("theory", "speedup", "acceptance_rate", f"{VALID} AND arm = 'spec'", system=_NONE),
    _chart("cost_per_1k", "cost_usd", "gpu_cost_usd / nullif(output_tokens, 0) * 1000", VALID, task=_NONE),
    _chart("acceptance", "acceptance_rate", "acceptance_rate", system=_NONE, ci=True),
    f"""SELECT 'speedup', 'speedup', gpu_type, task, {_NONE}, concurrency, count(*),
      {r("avg(CASE WHEN arm = 'spec' THEN tokens_per_sec END) / avg(CASE WHEN arm = 'base' THEN tokens_per_sec END)", 5)},
      NULL, NULL FROM armed WHERE {VALID} AND arm IS NOT NULL GROUP BY gpu_type, task, concurrency""",
]


@query(f"{WITH_ARM} " + " UNION ALL ".join(f"SELECT * FROM ({c})" for c in _CHARTS))
def chart_series(spark, sf_dir):
    """All chart series in long format."""
    return tidy(series.chart_series(counted(spark, sf_dir)), mean=5)


@query(
    f"""{REQ}, d AS (SELECT gpu_type, task, system, concurrency, avg(ttft_ms) AS f, avg(tokens_per_sec) AS t
      FROM counted WHERE ttft_ms IS NOT NULL GROUP BY gpu_type, task, system, concurrency)
    SELECT gpu_type, task, system, concurrency, 'ttft_ms' AS metric, {r('f')} AS mean FROM d
    UNION ALL SELECT gpu_type, task, system, concurrency, 'tokens_per_sec', {r('t')} FROM d"""
)
def dashboard_series(spark, sf_dir):
    """The dashboard's two line charts."""
    return tidy(series.dashboard_series(counted(spark, sf_dir)))


@query(
    f"""{_CELLS} SELECT gpu_type, concurrency, task, {r('speedup')} AS speedup FROM aligned
    WHERE gpu_type = 'A100' ORDER BY task, concurrency"""
)
def series_slice(spark, sf_dir):
    """One hardware's speedup series in order."""
    rows = compare.speedups(counted(spark, sf_dir)).filter(F.col("gpu_type") == "A100")
    return tidy(rows.select("gpu_type", "concurrency", "task", "speedup")).orderBy("task", "concurrency")


@query(
    f"""{_CELLS}, s AS (SELECT gpu_type, task, concurrency, {r('speedup', 3)} AS sp, {r('alpha', 3)} AS a,
      {r('(1 - speedup / nullif(theory, 0)) * 100', 1)} AS o FROM aligned)
    SELECT gpu_type AS gpu, upper(task[1]) || task[2:] AS task, concurrency, printf('%.2f×', {r('sp', 2)}) AS speedup,
    printf('%.0f%%', round_even(a * 100, 0)) AS acceptance, printf('%+.1f%%', o) AS overhead FROM s"""
)
def report_labels(spark, sf_dir):
    """Readable labels of the A/B summary."""
    table = compare.extended_summary(counted(spark, sf_dir))
    rounded = table.withColumn("speedup_actual", F.rint(F.col("speedup_actual") * 100) / 100)
    return report.summary_labels(rounded)


@query(
    f"""{REQ} SELECT gpu_type, system, concurrency, printf('$%.4f', {r('c', 8)}) AS label FROM (SELECT gpu_type, system,
    concurrency, avg(gpu_cost_usd / output_tokens * 1000) AS c FROM counted WHERE {VALID} AND output_tokens > 0
    GROUP BY gpu_type, system, concurrency)"""
)
def cost_labels(spark, sf_dir):
    """Cost labels of the per-1 000 chart."""
    rows = views.valid_requests(counted(spark, sf_dir))
    costs = summary.mean_cost(rows, ["gpu_type", "system", "concurrency"], 1e3, "cost_per_1k")
    return report.cost_labels(tidy(costs, 8)).drop("cost_per_1k")


@query(
    f"""{REQ} SELECT gpu_type, system, {r('sum(gpu_cost_usd)', 4)} AS total_cost_usd, count(*) AS total_requests,
    CASE WHEN gpu_type = 'mac' THEN CAST(NULL AS VARCHAR) ELSE system END AS note FROM counted
    GROUP BY gpu_type, system"""
)
def summary_csv(spark, sf_dir):
    """The cost table written as CSV and read back; a missing value stays missing."""
    path = shared_dir(spark, "table")
    table = tidy(summary.cost_summary(counted(spark, sf_dir)), 4).withColumn(
        "note", F.when(F.col("gpu_type") != "mac", F.col("system"))
    )
    tables.write_table(table, path)
    return tables.read_table(spark, path, table.schema)


# --- written cells and streams -------------------------------------------------------------------


@query(
    f"""{REQ} SELECT system, gpu_type, task, concurrency, trial, count(*) AS n,
    {r("sum(CASE WHEN gpu_type = 'L4' AND trial = 2 THEN 2 ELSE 1 END * total_latency_ms)", 3)} AS latency_ms
    FROM requests GROUP BY system, gpu_type, task, concurrency, trial"""
)
def cells_roundtrip(spark, sf_dir):
    """Write all cells, replace some of them by a second run, read everything back."""
    path = shared_dir(spark, "cells")
    rows = log(spark, sf_dir).select(*[f.name for f in S.REQUEST.fields])
    source.write_cells(rows, path)
    again = rows.filter((F.col("gpu_type") == "L4") & (F.col("trial") == 2))
    source.write_cells(again.withColumn("total_latency_ms", F.col("total_latency_ms") * 2), path)
    stored = source.read_cells(spark, path)
    return tidy(
        stored.groupBy(*S.CELL).agg(
            F.count(F.lit(1)).alias("n"), F.sum("total_latency_ms").alias("latency_ms")
        ),
        3,
    )


@query(
    f"""{REQ} SELECT system, gpu_type, count(*) AS n, CAST(sum(output_tokens) AS BIGINT) AS tokens
    FROM requests GROUP BY system, gpu_type"""
)
def stream_ingest(spark, sf_dir):
    """Load result files as a stream into a table."""
    root = shared_dir(spark, "ingest")
    source.write_request_lines(log(spark, sf_dir), f"{root}/in")
    stream = source.stream_requests(spark, f"{root}/in", max_files=4)
    jobs.append_to(stream, f"{root}/out", f"{root}/checkpoint")
    stored = spark.read.schema(S.REQUEST).parquet(f"{root}/out")
    return stored.groupBy("system", "gpu_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("output_tokens").alias("tokens")
    )


@query(
    f"""{REQ} SELECT system, gpu_type, task, concurrency, {r('avg(ttft_ms)', 4)} AS ttft_ms,
    {r('avg(tpot_ms)', 4)} AS tpot_ms, {r('avg(tokens_per_sec)', 4)} AS tokens_per_sec,
    {r('avg(gpu_cost_usd)', 8)} AS gpu_cost_usd FROM requests WHERE ttft_ms IS NOT NULL
    GROUP BY system, gpu_type, task, concurrency"""
)
def stream_summary(spark, sf_dir):
    """The dashboard table kept current while result files arrive."""
    root = shared_dir(spark, "summary")
    source.write_request_lines(log(spark, sf_dir), f"{root}/in")
    jobs.keep_summary(source.stream_requests(spark, f"{root}/in", max_files=4), f"{root}/out", f"{root}/checkpoint")
    return tidy(jobs.kept_means(spark, f"{root}/out"), 4, gpu_cost_usd=8)
