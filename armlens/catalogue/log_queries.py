"""Queries over chunk and counter logs (adapter: events)."""

from pyspark.sql import functions as F

from armlens import schema as S
from armlens.catalogue import adapters as A
from armlens.catalogue.registry import exact_r, query, r, tidy
from armlens.operators import chunks, counters
from armlens.session import shared_dir
from armlens.sources import logs
from armlens.streaming import jobs, stateful

# Test events are sparse: a request is a user's day, so its timeout is half a day.
TIMEOUT_S = 12 * 3600
DAY_GAP = "25 hours"

# trim() with its characters, since DuckDB's strips blanks only.
_PARSED = f"""WITH log AS ({A.CHUNK_LOG_SQL}),
  split AS (SELECT request_id, system, gpu_type, seq, epoch_us(ts) AS micros,
    CASE WHEN starts_with(line, 'data: ') THEN substr(line, 7) END AS payload,
    CASE WHEN starts_with(line, 'error: ') THEN substr(line, 8) END AS error FROM log),
  json AS (SELECT *, coalesce(payload = '[DONE]', false) AS is_done,
    TRY_CAST(CASE WHEN payload <> '[DONE]' THEN payload END AS JSON) AS j FROM split),
  parsed AS (SELECT request_id, system, gpu_type, seq, micros, error, is_done,
    nullif(json_extract_string(j, '$.choices[0].delta.content'), '') AS content,
    CAST(json_extract_string(j, '$.usage.completion_tokens') AS INT) AS usage_tokens FROM json)"""
_LIVE = f"""{_PARSED},
  ends AS (SELECT request_id, min((micros, seq)) AS e FROM parsed WHERE is_done OR error IS NOT NULL GROUP BY request_id),
  live AS (SELECT parsed.* FROM parsed LEFT JOIN ends USING (request_id) WHERE e IS NULL OR (micros, seq) <= e)"""


def _fold_sql(require_terminal: bool = False, estimate: bool = False) -> str:
    late = f"end_us - start_us > {TIMEOUT_S * 1_000_000}" + (" OR NOT closed" if require_terminal else "")
    tokens = (
        "coalesce(nullif(CAST(usage_tokens AS BIGINT), 0), greatest(chars // 4, 1))"
        if estimate
        else "coalesce(CAST(usage_tokens AS BIGINT), chunks)"
    )
    return f"""{_LIVE},
  folded AS (SELECT request_id, min(system) AS system, min(gpu_type) AS gpu_type, min(micros) AS start_us,
    min(CASE WHEN content IS NOT NULL THEN micros END) AS first_us, max(micros) AS end_us,
    count(content) AS chunks, CAST(sum(coalesce(length(content), 0)) AS BIGINT) AS chars,
    arg_max(usage_tokens, CASE WHEN usage_tokens IS NOT NULL THEN micros END) AS usage_tokens,
    bool_or(is_done OR error IS NOT NULL) AS closed, max(error) AS error FROM live GROUP BY request_id),
  timed AS (SELECT * REPLACE (CASE WHEN {late} THEN 'timeout' ELSE error END AS error),
    CASE WHEN {late} THEN {TIMEOUT_S}e0 ELSE (end_us - start_us) / 1e6 END AS latency_s, {tokens} AS tokens,
    (first_us - start_us) / 1e6 AS ttft FROM folded),
  rated AS (SELECT *, nullif(ttft, 0) * 1000 AS ttft_raw,
    CASE WHEN tokens > 1 THEN nullif((end_us - first_us) / 1e6 / (tokens - 1), 0) END * 1000 AS tpot_raw,
    latency_s * 1000 AS latency_raw, CASE WHEN latency_s > 0 THEN tokens / latency_s END AS tps_raw,
    CASE gpu_type WHEN 'T4' THEN 0.35e0 WHEN 'L4' THEN 0.70e0 WHEN 'A100' THEN 3.67e0 END / 3600 * latency_s AS cost_raw
    FROM timed),
  metrics AS (SELECT request_id, system, gpu_type,
    CASE WHEN error IS NULL THEN {exact_r('ttft_raw', 2)} END AS ttft_ms,
    CASE WHEN error IS NULL THEN {exact_r('tpot_raw', 2)} END AS tpot_ms,
    {exact_r('latency_raw', 2)} AS total_latency_ms,
    CASE WHEN error IS NULL THEN tokens ELSE 0 END AS output_tokens,
    CASE WHEN error IS NULL THEN {exact_r('tps_raw', 2)} END AS tokens_per_sec,
    {exact_r('cost_raw', 8)} AS gpu_cost_usd, chunks, chars, error, end_us FROM rated)"""


def _mean(c: str) -> str:
    return f"CAST(sum(CAST({c} AS DECIMAL(20, 2))) AS DOUBLE) / nullif(count({c}), 0)"


_METRICS = (
    "request_id, system, gpu_type, ttft_ms, tpot_ms, total_latency_ms, output_tokens, tokens_per_sec,"
    " gpu_cost_usd, chunks, chars, error"
)


@query(
    f"{_PARSED} SELECT request_id, seq, micros, is_done, error, content, usage_tokens FROM parsed"
)
def sse_parse(spark, sf_dir):
    """What each logged line of a token stream says."""
    parsed = chunks.parse_lines(A.chunk_log(spark, sf_dir))
    return parsed.select("request_id", "seq", "micros", "is_done", "error", "content", "usage_tokens")


@query(f"{_fold_sql()} SELECT {_METRICS} FROM metrics")
def fold_chunks(spark, sf_dir):
    """One metrics row per request from its chunk log."""
    return chunks.fold(A.chunk_log(spark, sf_dir), TIMEOUT_S)


@query(f"{_fold_sql(estimate=True)} SELECT {_METRICS} FROM metrics")
def fold_estimated(spark, sf_dir):
    """The same fold where a missing token count is estimated from the text length."""
    return chunks.fold(A.chunk_log(spark, sf_dir), TIMEOUT_S, estimate=True)


@query(f"{_fold_sql(require_terminal=True)} SELECT {_METRICS} FROM metrics WHERE error = 'timeout'")
def timeouts(spark, sf_dir):
    """Requests that ran too long or never ended, with the cost of the wait."""
    folded = chunks.fold(A.chunk_log(spark, sf_dir), TIMEOUT_S, require_terminal=True)
    return chunks.timeouts(folded)


@query(
    f"""{_LIVE} SELECT request_id, string_agg(content, '' ORDER BY micros, seq) AS output_text FROM live
    WHERE content IS NOT NULL GROUP BY request_id"""
)
def output_texts(spark, sf_dir):
    """The text of each request put together from its chunks."""
    return chunks.output_texts(A.chunk_log(spark, sf_dir))


@query(
    f"""{_LIVE}, run AS (SELECT *, sum(coalesce(length(content), 0)) OVER w AS chars, min(micros) OVER w AS start_us
      FROM live WINDOW w AS (PARTITION BY request_id ORDER BY micros, seq))
    SELECT request_id, system, seq, CAST(chars // 4 AS BIGINT) AS est_tokens, {r('(micros - start_us) / 1e6')} AS elapsed_s,
    CASE WHEN micros > start_us THEN {r('chars // 4 / ((micros - start_us) / 1e6)')} END AS est_tokens_per_sec
    FROM run WHERE content IS NOT NULL"""
)
def race_progress(spark, sf_dir):
    """Estimated tokens and speed at each chunk."""
    return tidy(chunks.race_progress(A.chunk_log(spark, sf_dir)))


@query(
    f"""{_fold_sql()} SELECT system, {r('avg(chars / nullif(chunks, 0))')} AS chars_per_chunk, count(*) AS requests
    FROM metrics GROUP BY system"""
)
def chars_per_chunk(spark, sf_dir):
    """Characters per chunk, the sanity check of chunk-counted tokens."""
    return tidy(chunks.chars_per_chunk(chunks.fold(A.chunk_log(spark, sf_dir), TIMEOUT_S)))


@query(
    f"""{_PARSED}, slices AS (SELECT *, (micros - {12 * 3600 * 1_000_000}) // {5 * 86_400 * 1_000_000} AS slice FROM parsed),
    ends AS (SELECT slice, max(micros) AS last FROM slices GROUP BY slice),
    late AS (SELECT count(*) AS n FROM slices JOIN ends USING (slice) WHERE seq % 3 = 0
      AND micros <= last - 120000000 AND slice + 2 <= (SELECT max(slice) FROM ends))
    SELECT system, count(*) AS lines, count(content) AS content_lines FROM parsed GROUP BY system
    UNION ALL SELECT '(late)', n, 0 FROM late"""
)
def dedup_chunks(spark, sf_dir):
    """A log with re-sent lines over several triggers, read as a stream that drops the copies, and how many
    copies came behind the watermark."""
    root = shared_dir(spark, "dedup")
    jobs.stage(A.chunk_log(spark, sf_dir), f"{root}/in", again=F.col("seq") % 3 == 0)
    stream = logs.stream_log(spark, f"{root}/in", S.CHUNK_LOG, max_files=2)
    late = jobs.append_to(jobs.without_duplicates(stream), f"{root}/out", f"{root}/checkpoint")
    kept = spark.read.schema(S.CHUNK_LOG).parquet(f"{root}/out").filter(F.col("request_id") != jobs.DRAIN_ID)
    counted = chunks.parse_lines(kept).groupBy("system").agg(
        F.count(F.lit(1)).alias("lines"), F.count("content").alias("content_lines")
    )
    extra = spark.range(1).select(F.lit("(late)").alias("system"), F.lit(late).cast("long").alias("lines"), F.lit(0).cast("long").alias("content_lines"))
    return counted.unionByName(extra)


def _stage(spark, sf_dir, name: str):
    """The raw log, staged in slices that cut requests in two, and a stream that reads one slice a trigger."""
    root = shared_dir(spark, name)
    jobs.stage(A.chunk_log(spark, sf_dir), f"{root}/in")
    return root, logs.stream_log(spark, f"{root}/in", S.CHUNK_LOG, max_files=2)


def _finished(spark, stream, root: str):
    jobs.append_to(stream, f"{root}/out", f"{root}/checkpoint")
    out = spark.read.schema(stream.schema).parquet(f"{root}/out")
    return out.filter(F.col("request_id") != jobs.DRAIN_ID)


@query(f"{_fold_sql()} SELECT {_METRICS} FROM metrics")
def stream_fold(spark, sf_dir):
    """The fold as a stream: a request leaves when its session closes."""
    root, stream = _stage(spark, sf_dir, "fold")
    folded = jobs.fold_sessions(stream, gap=DAY_GAP, timeout_s=TIMEOUT_S)
    return _finished(spark, folded, root)


@query(f"{_fold_sql(require_terminal=True)} SELECT {_METRICS} FROM metrics")
def stream_fold_stateful(spark, sf_dir):
    """The fold with own state: a request leaves at its end or at its timeout."""
    root, stream = _stage(spark, sf_dir, "state")
    return _finished(spark, stateful.fold_stateful(stream, timeout_s=TIMEOUT_S, window_s=24 * 3600), root)


@query(
    f"""{_LIVE} SELECT request_id, system, CAST(sum(coalesce(length(content), 0)) AS BIGINT) AS chars,
    min(micros) AS start_us, max(micros) AS last_us, CAST(sum(coalesce(length(content), 0)) // 4 AS BIGINT) AS est_tokens
    FROM live GROUP BY request_id, system"""
)
def stream_progress(spark, sf_dir):
    """Progress of all requests, kept by a running stream."""
    root, stream = _stage(spark, sf_dir, "progress")
    totals = jobs.live_totals(stream)
    jobs.keep_progress(totals, f"{root}/out", f"{root}/checkpoint")
    progress = jobs.request_progress(jobs.newest(spark, f"{root}/out"))
    return progress.filter(F.col("request_id") != jobs.DRAIN_ID)


@query(
    f"""{_fold_sql()} SELECT strftime(date_trunc('day', make_timestamp(end_us)), '%Y-%m-%d') AS day,
    CASE WHEN system = 'baseline' THEN 'base' ELSE 'spec' END AS arm, count(*) AS requests,
    {r(_mean('tokens_per_sec'), 4)} AS avg_tps, {r(_mean('ttft_ms'), 4)} AS avg_ttft_ms, {r(_mean('tpot_ms'), 4)} AS avg_tpot_ms,
    {r('CAST(sum(CAST(coalesce(gpu_cost_usd, 0) AS DECIMAL(20, 8))) AS DOUBLE)')} AS cost_usd FROM metrics GROUP BY ALL"""
)
def stream_window_ab(spark, sf_dir):
    """Both arms' averages per day over a stream of finished requests."""
    root, lines = _stage(spark, sf_dir, "windows")
    folded = jobs.fold_sessions(lines, gap=DAY_GAP, timeout_s=TIMEOUT_S, keep=["end_us"])
    done = folded.withColumn("ended_at", F.timestamp_micros("end_us"))
    jobs.write_batches(done, f"{root}/done", f"{root}/done_checkpoint", "append")
    drain = spark.range(1).select(
        F.lit(jobs.DRAIN_ID).alias("request_id"), F.lit(jobs.DRAIN_TS).cast("timestamp").alias("ended_at")
    )
    drain.write.parquet(f"{root}/done/batch=-1")
    stream = spark.readStream.schema(done.schema).parquet(f"{root}/done")
    stream = stream.filter((F.col("request_id") != jobs.DRAIN_ID) | F.col("end_us").isNull())
    windows = jobs.window_averages(stream, "1 day")
    jobs.append_to(windows, f"{root}/out", f"{root}/checkpoint")
    out = spark.read.schema(windows.schema).parquet(f"{root}/out").filter(F.col("arm").isNotNull())
    return tidy(
        out.withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd")).withColumnRenamed(
            "window_start", "day"
        ),
        4,
        cost_usd=6,
    )


# --- counters ----------------------------------------------------------------------

_COUNTERS = f"WITH wide AS ({A.WIDE_SQL}), log AS ({A.COUNTER_LOG_SQL})"
_RATES = f"""{_COUNTERS}, parsed AS (SELECT server, scrape_ts, line_no,
    regexp_extract(line, '^([A-Za-z_:][A-Za-z0-9_:]*)', 1) AS name,
    regexp_extract(line, '\\{{([^}}]*)\\}}', 1) AS labels,
    TRY_CAST(regexp_extract(line, '(\\S+)\\s*$', 1) AS DOUBLE) AS value FROM log WHERE NOT starts_with(line, '#')),
  counted AS (SELECT server, epoch_us(scrape_ts) AS micros,
    arg_min(value, CASE WHEN contains(name, '{S.GAUGE_NAME}') THEN line_no END) AS gauge,
    arg_max(value, CASE WHEN contains(name, '{S.ACCEPTED_NAME}') THEN line_no END) AS accepted,
    arg_max(value, CASE WHEN contains(name, '{S.DRAFTED_NAME}') THEN line_no END) AS drafted
    FROM parsed GROUP BY server, scrape_ts),
  raw AS (SELECT *, coalesce(gauge, accepted / nullif(drafted, 0)) AS raw_rate FROM counted),
  rates AS (SELECT * EXCLUDE (raw_rate), {exact_r('raw_rate', 4)} AS acceptance_rate FROM raw)"""


@query(
    f"{_RATES} SELECT server, epoch_us(scrape_ts) AS micros, line_no, name, labels, value FROM parsed"
)
def counter_parse(spark, sf_dir):
    """Name, labels and value of each counter line."""
    parsed = counters.parse_counters(A.counter_log(spark, sf_dir))
    return parsed.withColumn("micros", F.unix_micros("scrape_ts")).drop("scrape_ts")


@query(
    f"""{_RATES}, steps AS (SELECT *, lag(accepted) OVER w AS a0, lag(drafted) OVER w AS d0 FROM rates
      WINDOW w AS (PARTITION BY server ORDER BY micros)),
    deltas AS (SELECT *, CASE WHEN drafted < d0 THEN accepted ELSE accepted - a0 END AS accepted_step,
      CASE WHEN drafted < d0 THEN drafted ELSE drafted - d0 END AS drafted_step FROM steps),
    raws AS (SELECT *, accepted_step / nullif(drafted_step, 0) AS raw_step FROM deltas)
    SELECT server, micros, acceptance_rate, accepted_step, drafted_step, {exact_r('raw_step', 4)} AS step_rate FROM raws"""
)
def counter_rate(spark, sf_dir):
    """Acceptance rate of each scrape since start and since the scrape before."""
    scraped = counters.scrape_rates(A.counter_log(spark, sf_dir))
    rates = counters.counter_rates(scraped)
    return rates.select(
        "server", "micros", "acceptance_rate", "accepted_step", "drafted_step", "step_rate"
    )


@query(
    f"""{_RATES}, cells AS (SELECT CAST(user_id AS VARCHAR) AS server, epoch_us(ts) AS end_us, event_id AS cell_id
      FROM events WHERE event_type = 'signup'),
    points AS (SELECT server, micros, acceptance_rate FROM rates WHERE acceptance_rate IS NOT NULL)
    SELECT cells.server, cell_id, end_us, micros AS scrape_us, acceptance_rate FROM cells
    ASOF LEFT JOIN points ON cells.server = points.server AND cells.end_us <= points.micros"""
)
def acceptance_asof(spark, sf_dir):
    """The first scrape at or after the end of each cell."""
    rates = counters.scrape_rates(A.counter_log(spark, sf_dir))
    return counters.acceptance_after(A.cell_ends(spark, sf_dir), rates).select(
        "server", "cell_id", "end_us", "scrape_us", "acceptance_rate"
    )


@query(
    f"""{_RATES}, per_cell AS (SELECT CAST(server AS BIGINT) % 5 AS c, max(acceptance_rate) AS rate FROM rates
      GROUP BY ALL),
    log2 AS ({A.REQUESTS_SQL})
    SELECT system, gpu_type, task, concurrency, trial, count(*) AS n, max(CASE WHEN system = 'eagle3' THEN rate END)
    AS acceptance_rate FROM log2 LEFT JOIN per_cell ON c = l_partkey % 5 GROUP BY ALL"""
)
def cell_acceptance(spark, sf_dir):
    """Copy each cell's scraped rate onto its treatment requests."""
    rates = counters.scrape_rates(A.counter_log(spark, sf_dir))
    place = F.expr("get(array(1, 4, 8, 16, 32), CAST(server AS INT) % 5)")
    per_cell = rates.groupBy(place.alias("concurrency")).agg(
        F.max("acceptance_rate").alias("acceptance_rate")
    )
    rows = A.requests(spark, sf_dir).drop("acceptance_rate")
    cells = rows.select(*S.CELL).distinct().join(per_cell, "concurrency")
    return (
        counters.attach_cell_acceptance(rows, cells)
        .groupBy(*S.CELL)
        .agg(F.count(F.lit(1)).alias("n"), F.max("acceptance_rate").alias("acceptance_rate"))
    )


@query(
    f"""{_COUNTERS} SELECT server, count(*) AS lines, count(DISTINCT scrape_ts) AS scrapes FROM log GROUP BY server"""
)
def log_roundtrip(spark, sf_dir):
    """Write the counter log as text and read it back."""
    path = shared_dir(spark, "counters")
    logs.write_log(A.counter_log(spark, sf_dir), path, S.COUNTER_LOG)
    back = logs.read_log(spark, path, S.COUNTER_LOG)
    per_scrape = back.groupBy("server", "scrape_ts").agg(F.count("line").alias("lines"))
    return per_scrape.groupBy("server").agg(
        F.sum("lines").alias("lines"), F.count("scrape_ts").alias("scrapes")
    )
