import datetime as dt
import json
import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from armlens import schema as S
from armlens.operators import chunks, counters
from armlens.sources import logs
from armlens.streaming import jobs, stateful

START = dt.datetime(2026, 1, 1)


def say(text):
    return f'data: {{"choices": [{{"delta": {{"content": "{text}"}}}}]}}'


def usage(n):
    return f'data: {{"choices": [], "usage": {{"completion_tokens": {n}}}}}'


DONE = "data: [DONE]"

# request -> (seconds, line); the cases of the chunk log.
CASES = {
    "one_token_per_chunk": [(0, ": open"), (1, say("Hello")), (2, say(" you")), (3, DONE)],
    "many_tokens_with_usage": [(0, ": open"), (0.5, say("Hello you")), (2.5, usage(9)), (2.5, DONE)],
    "no_content": [(0, ": open"), (1, usage(0)), (2, DONE)],
    "bad_json": [(0, say("a")), (1, 'data: {"choices": [{"delta"'), (2, 'data: {"choices": []}'), (4, DONE)],
    "after_done": [(0, say("abc")), (1, DONE), (2, say("late")), (3, usage(99))],
    "error": [(0, say("abc")), (5, "error: reset"), (6, say("x"))],
    "too_long": [(0, say("abc")), (200, say("d")), (201, DONE)],
    "never_ends": [(0, say("abcdefgh")), (10, say("i"))],
    "spaces": [(0, "  " + say("ab") + " \r"), (2, DONE + "\r")],
}


def log_rows():
    out, seq = [], 0
    for request, lines in CASES.items():
        for second, line in lines:
            out.append((request, "eagle3", "L4", seq, START + dt.timedelta(seconds=second), line))
            seq += 1
    return out


@pytest.fixture(scope="module")
def log(spark):
    return spark.createDataFrame(log_rows(), S.CHUNK_LOG).repartition(4)


def by_request(df):
    return {r.request_id: r for r in df.collect()}


def test_fold(log):
    got = by_request(chunks.fold(log))
    one = got["one_token_per_chunk"]
    assert (one.ttft_ms, one.tpot_ms, one.total_latency_ms) == (1000.0, 2000.0, 3000.0)
    assert (one.output_tokens, one.tokens_per_sec, one.chars) == (2, round(2 / 3, 2), 9)
    assert one.gpu_cost_usd == round(0.70 / 3600 * 3, 8)
    many = got["many_tokens_with_usage"]
    assert (many.output_tokens, many.tpot_ms, many.chunks) == (9, 250.0, 1)
    none = got["no_content"]
    assert (none.ttft_ms, none.tpot_ms, none.output_tokens) == (None, None, 0)
    assert got["bad_json"].output_tokens == 1 and got["bad_json"].ttft_ms is None
    after = got["after_done"]
    assert (after.total_latency_ms, after.output_tokens, after.chars) == (1000.0, 1, 3)
    failed = got["error"]
    assert (failed.error, failed.output_tokens, failed.tokens_per_sec) == ("reset", 0, None)
    assert failed.gpu_cost_usd == round(0.70 / 3600 * 5, 8)
    late = got["too_long"]
    assert (late.error, late.total_latency_ms) == ("timeout", 120000.0)
    assert got["never_ends"].error is None and got["spaces"].chars == 2


def test_fold_with_terminal_and_estimate(log):
    assert by_request(chunks.fold(log, require_terminal=True))["never_ends"].error == "timeout"
    got = by_request(chunks.fold(log, estimate=True))
    assert got["no_content"].output_tokens == 1
    assert got["one_token_per_chunk"].output_tokens == 2
    assert chunks.timeouts(chunks.fold(log)).count() == 1


def test_texts_and_progress(log):
    texts = by_request(chunks.output_texts(log))
    assert texts["one_token_per_chunk"].output_text == "Hello you" and "no_content" not in texts
    got = [r for r in chunks.race_progress(log).collect() if r.request_id == "one_token_per_chunk"]
    assert sorted((r.est_tokens, r.elapsed_s, r.est_tokens_per_sec) for r in got) == [(1, 1.0, 1.0), (2, 2.0, 1.0)]


def test_long_text_stays_one_row(spark, monkeypatch):
    monkeypatch.setattr(chunks, "LINES_PER_BLOCK", 3)
    data = [("r", "baseline", "L4", i if i else None, START, 'data: {"choices": [{"delta": {"content": "%d,"}}]}' % i) for i in range(20)]
    data += [("r", "baseline", "L4", 20, START, "data: [DONE]"), ("r", "baseline", "L4", 21, START, data[1][-1])]
    got = chunks.output_texts(spark.createDataFrame(data, S.CHUNK_LOG)).collect()
    assert [r.output_text for r in got] == ["".join(f"{i}," for i in range(20))]


@pytest.mark.parametrize("size", [1, 2, 4096])
def test_fold_does_not_depend_on_blocks(spark, log, monkeypatch, size):
    want = by_request(chunks.fold(log))
    monkeypatch.setattr(chunks, "LINES_PER_BLOCK", size)
    assert by_request(chunks.fold(log)) == want
    lines = chunks.until_terminal(chunks.sized(chunks.parse_lines(log)))
    keys = ["request_id", "system", "gpu_type"]
    plain = lines.groupBy(*keys).agg(*chunks.line_totals(), F.max("closed").alias("closed"), F.max("error").alias("error"))
    assert by_request(plain) == by_request(chunks.folded(log))


def test_duplicates_do_not_count(log):
    twice = log.unionByName(log)
    assert by_request(chunks.fold(chunks.without_duplicates(twice))) == by_request(chunks.fold(log))


def staged(spark, log, path):
    """The raw log in slices of 40 seconds, one per trigger."""
    jobs.stage(log, path, "40 seconds", "0 seconds", 1)
    return logs.stream_log(spark, path, S.CHUNK_LOG, max_files=1)


@pytest.mark.parametrize("form", ["sessions", "stateful"])
def test_streaming_fold_equals_batch(spark, log, tmp_path, form):
    stream = staged(spark, log, f"{tmp_path}/in")
    if form == "sessions":
        folded = jobs.fold_sessions(stream, gap="300 seconds", require_terminal=True)
    else:
        folded = stateful.fold_stateful(stream)
    jobs.append_to(folded, f"{tmp_path}/out", f"{tmp_path}/ck")
    got = by_request(spark.read.schema(folded.schema).parquet(f"{tmp_path}/out"))
    want = by_request(chunks.fold(log, require_terminal=True))
    got.pop(jobs.DRAIN_ID, None)
    assert set(got) == set(want)
    for request, row in want.items():
        assert got[request].asDict() == row.asDict(), request


def test_join_of_a_stream_keeps_one_store_a_task(spark, log, tmp_path):
    """A trigger's commits grow with the stores it opens, four of them a task in older formats of the state."""
    folded = jobs.fold_sessions(staged(spark, log, f"{tmp_path}/in"), gap="300 seconds")
    query = folded.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    query.awaitTermination()
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    stores = {op.operatorName: op.numStateStoreInstances for p in query.recentProgress for op in p.stateOperators}
    assert stores["symmetricHashJoin"] == tasks and set(stores.values()) == {tasks}
    assert list((tmp_path / "ck" / "state").rglob("*.changelog"))


def test_state_values_do_not_grow_with_a_request(spark):
    """The stateful fold adds totals of any split of a request's lines to what the batch fold has."""
    data = 'data: {"choices": [{"delta": {"content": "abcd"}}]}'
    usage = 'data: {"choices": [], "usage": {"completion_tokens": %d}}'
    lines = [usage % k if k % 5 == 0 else data for k in range(300)] + ["data: [DONE]"]
    rows = [("r", "baseline", "L4", k, START + dt.timedelta(seconds=k), line) for k, line in enumerate(lines)]
    log = spark.createDataFrame(rows, S.CHUNK_LOG)
    usage_seq = F.max(F.when(F.col("usage_tokens").isNotNull(), F.col("seq"))).alias("usage_seq")
    parsed = chunks.sized(chunks.parse_lines(log)).withColumn("part", F.col("seq") % 7)
    parts = parsed.groupBy("part").agg(F.min("system").alias("system"), F.min("gpu_type").alias("gpu_type"), *chunks.line_totals(), usage_seq, *chunks.closing())
    both, *rest = [{k: r[k] for k in stateful.FIELDS} for r in parts.collect()]
    for other in rest:
        both = stateful.together(both, other)
        assert len(repr(both)) < 400
    (want,) = chunks.folded(log).collect()
    assert all(both[c] == want[c] for c in ("start_us", "first_us", "end_us", "chunks", "chars", "usage_tokens", "closed", "error"))


def test_a_trigger_writes_a_group_of_requests_once(spark, tmp_path):
    """Calls to the state are what a request costs, so many requests share one; a row and a timer each had 60 here."""
    lines = [(0, ": open"), (1, say("Hello")), (2, usage(7)), (3, DONE), (4, say("late"))]
    rows = [(f"r{k}", "baseline", "L4", seq, START + dt.timedelta(seconds=20 * (k % 6) + seq), line) for k in range(60) for seq, line in lines[: 5 if k % 4 else 2]]
    rows += [(None, "baseline", "L4", 0, START, say("no id"))]
    log = spark.createDataFrame(rows, S.CHUNK_LOG).repartition(4)
    folded = stateful.fold_stateful(staged(spark, log, f"{tmp_path}/in"), groups=3)
    query = folded.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    query.awaitTermination()
    written = [op.numRowsUpdated for p in query.recentProgress for op in p.stateOperators if op.operatorName.startswith("transformWithState")]
    assert 0 < max(written) <= 3
    got = [r.asDict() for r in spark.read.schema(folded.schema).parquet(f"{tmp_path}/out").collect() if r.request_id != jobs.DRAIN_ID]
    want = [r.asDict() for r in chunks.fold(log, require_terminal=True).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and len(got) == 61


class State:
    """A state of one value per group, and the timers."""

    def __init__(self):
        self.key, self.values, self.timers = None, {}, set()

    def getValueState(self, *_):
        return SimpleNamespace(get=lambda: self.values.get(self.key), update=lambda v: self.values.update({self.key: v}), clear=lambda: self.values.pop(self.key, None))

    def registerTimer(self, time):
        self.timers.add((time, self.key))

    def deleteTimer(self, time):
        self.timers.remove((time, self.key))


def departures(batches, group):
    """What leaves in each batch of (watermark, rows), and how many values and timers are left."""
    state, fold, out = State(), stateful.ChunkFold(100, 10), []
    fold.init(state)
    for watermark, rows in batches:
        now, gone, parts = SimpleNamespace(getCurrentWatermarkInMs=lambda w=watermark: w), [], {}
        for row in rows:
            parts.setdefault(group(row["request_id"]), []).append((0, json.dumps({k: v for k, v in row.items() if v is not None})))
        for state.key, part in parts.items():
            gone += fold.handleInputRows((state.key,), iter(part), now)
        for time, state.key in sorted(t for t in state.timers if t[0] <= watermark):
            gone += fold.handleExpiredTimer((state.key,), now, SimpleNamespace(getExpiryTimeInMs=lambda t=time: t))
            state.timers.remove((time, state.key))
        out.append(sorted((r["request_id"], r["start_us"], r["chars"], r["closed"]) for row in gone for r in json.loads(row.requests)))
    return out, len(state.values), len(state.timers)


@pytest.mark.parametrize("seed", range(20))
def test_a_request_does_not_depend_on_its_group(seed):
    """Requests leave in the same batches alone and in a group: at the end, at the timeout, late lines ignored, forgotten later."""
    rand, watermark, batches = random.Random(seed), 0, []
    for _ in range(12):
        rows = []
        for _ in range(rand.randint(0, 12)):
            start = rand.randint(max(0, watermark - 20_000), watermark + 200_000) * 1000
            row = {"system": "baseline", "start_us": rand.choice([start, start, None]), "end_us": start + rand.randint(0, 9_000_000)}
            rows.append({**dict.fromkeys(stateful.FIELDS), **row, "request_id": rand.choice("abcd"), "chunks": 1, "chars": rand.randint(0, 9), "closed": rand.random() < 0.3})
        batches.append((watermark, rows))
        watermark += rand.randint(0, 120_000)
    batches += [(watermark + 10**6, []), (watermark + 10**7, [])]
    alone, *left = departures(batches, lambda request: request)
    assert any(alone) and left == [0, 0]
    assert departures(batches, lambda request: 0) == departures(batches, lambda request: request in "ab") == (alone, 0, 0)


def test_live_totals_hold_one_block_a_value(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(chunks, "LINES_PER_BLOCK", 4)
    data = 'data: {"choices": [{"delta": {"content": "abcd"}}]}'
    lines = [(k if k % 7 else None, data) for k in range(40)] + [(30, "data: [DONE]")]
    rows = [("r", "baseline", "L4", seq, START + dt.timedelta(seconds=3 * k), line) for k, (seq, line) in enumerate(lines)]
    log = spark.createDataFrame(rows, S.CHUNK_LOG)
    totals = jobs.live_totals(staged(spark, log, f"{tmp_path}/in"))
    jobs.keep_progress(totals, f"{tmp_path}/out", f"{tmp_path}/ck")
    blocks = jobs.newest(spark, f"{tmp_path}/out")
    assert 0 < max(len(r.lines) for r in blocks.collect()) <= 5  # a block and the terminal line
    (got,) = jobs.request_progress(blocks.filter(F.col("request_id") == "r")).collect()
    cut = chunks.until_terminal(chunks.sized(chunks.parse_lines(log))).agg(F.sum("size"), F.min("micros"), F.max("micros")).first()
    assert (got.chars, got.start_us, got.last_us) == tuple(cut)


def test_log_text_roundtrip(spark, log, tmp_path):
    logs.write_log(log, f"{tmp_path}/log", S.CHUNK_LOG)
    back = logs.read_log(spark, f"{tmp_path}/log", S.CHUNK_LOG)
    assert sorted(back.collect()) == sorted(log.collect())


def test_missing_fields_come_back(spark, tmp_path):
    rows = [("r", None, "", None, START, "data: [DONE]"), ("r", "eagle3", None, 2, None, None)]
    logs.write_log(spark.createDataFrame(rows, S.CHUNK_LOG), f"{tmp_path}/log", S.CHUNK_LOG)
    assert sorted(map(repr, map(tuple, logs.read_log(spark, f"{tmp_path}/log", S.CHUNK_LOG).collect()))) == sorted(map(repr, rows))


def test_lines_without_seq_stay(spark):
    data = 'data: {"choices": [{"delta": {"content": "abcd"}}]}'
    rows = [("r", "baseline", "L4", seq, START, line) for seq, line in ((None, data), (1, data), (2, "data: [DONE]"), (3, data))]
    assert [r.chars for r in chunks.fold(spark.createDataFrame(rows, S.CHUNK_LOG)).collect()] == [8]


@pytest.fixture(scope="module")
def scrapes(spark):
    def lines(server, second, *texts):
        return [(server, START + dt.timedelta(seconds=second), i, t) for i, t in enumerate(texts)]

    accepted = "vllm:spec_decode_num_accepted_tokens_total"
    drafted = "vllm:spec_decode_num_draft_tokens_total"
    data = (
        lines("a", 0, "# HELP x", f'{accepted}{{e="0"}} 10.0', f'{drafted}{{e="0"}} 40.0')
        + lines("a", 5, f"{accepted} 40.0", f"{drafted} 100.0")
        + lines("a", 10, f"{accepted} 5.0", f"{drafted} 10.0")
        + lines("b", 0, f"{accepted} 0.0", f"{drafted} 0.0")
        + lines("b", 5, "vllm:spec_decode_draft_acceptance_rate 0.33337", f"{accepted} 1", f"{drafted} 4")
        + lines("b", 9, f"{accepted.removeprefix('vllm:')} 7")
        + lines("c", 1, "up 1")
    )
    return spark.createDataFrame(data, S.COUNTER_LOG)


def test_rates(scrapes):
    rates = counters.counter_rates(counters.scrape_rates(scrapes))
    got = {(r.server, r.scrape_ts.second): (r.acceptance_rate, r.step_rate) for r in rates.collect()}
    assert got == {
        ("a", 0): (0.25, None), ("a", 5): (0.4, 0.5), ("a", 10): (0.5, 0.5),
        ("b", 0): (None, None), ("b", 5): (0.3334, 0.25), ("b", 9): (None, None), ("c", 1): (None, None),
    }


def test_first_scrape_after_cell(spark, scrapes):
    base = int(START.replace(tzinfo=dt.timezone.utc).timestamp()) * 1_000_000
    ends = spark.createDataFrame(
        [("a", base, 1), ("a", base + 1, 2), ("a", base + 20_000_000, 3), ("b", base, 4)],
        "server string, end_us bigint, cell_id int",
    )
    out = counters.acceptance_after(ends, counters.scrape_rates(scrapes))
    got = {r.cell_id: (r.acceptance_rate, r.scrape_us and (r.scrape_us - base) // 1_000_000) for r in out.collect()}
    assert got == {1: (0.25, 0), 2: (0.4, 5), 3: (None, None), 4: (0.3334, 5)}


def test_cell_rate_reaches_treatment_rows_only(requests_of, spark):
    log = requests_of({"system": "eagle3"}, {"system": "baseline"}, {"system": "eagle3", "concurrency": 4})
    cells = log.select(*S.CELL).distinct().filter("concurrency = 1").withColumn("acceptance_rate", F.lit(0.4))
    got = counters.attach_cell_acceptance(log, cells).select("system", "concurrency", "acceptance_rate").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(
        map(str, [("eagle3", 1, 0.4), ("baseline", 1, None), ("eagle3", 4, None)])
    )


def test_parsed_counter_line(scrapes):
    row = counters.parse_counters(scrapes).filter("server = 'a' and line_no = 1").orderBy("scrape_ts").first()
    assert (row.name, row.labels, row.value) == ("vllm:spec_decode_num_accepted_tokens_total", 'e="0"', 10.0)
