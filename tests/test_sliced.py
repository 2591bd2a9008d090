import random

import pytest
from pyspark.sql import functions as F

from armlens.operators import chunks
from armlens.plans.sliced import Slices, next_known, previous, running



@pytest.fixture(scope="module")
def events(spark):
    rng = random.Random(1)
    data = [("hot", i // 3 if i < 90 else i * 50, i, rng.randrange(100)) for i in range(400)]
    data += [(f"k{i % 40}", rng.randrange(1000), 1000 + i, None if i % 3 else rng.randrange(9)) for i in range(120)]
    rng.shuffle(data)
    return spark.createDataFrame(data, "k string, t bigint, seq bigint, v int").repartition(5)


def by_key(events):
    groups = {}
    for r in sorted(events.collect(), key=lambda r: (r.t, r.seq)):
        groups.setdefault(r.k, []).append(r)
    return groups


def test_running(events):
    out = running(
        events, ["k"], ["t", "seq"], sums={"total": F.coalesce("v", F.lit(0))}, minima={"start": F.col("t")}
    )
    got = {r.seq: (r.total, r.start) for r in out.collect()}
    for rows in by_key(events).values():
        total = 0
        for r in rows:
            total += r.v or 0
            assert got[r.seq] == (total, rows[0].t)
    assert len(got) == 520


def test_previous(events):
    out = previous(events, ["k"], ["t", "seq"], {"pv": "v", "pt": "t"})
    got = {r.seq: (r.pv, r.pt) for r in out.collect()}
    for rows in by_key(events).values():
        before = [(None, None)] + [(r.v, r.t) for r in rows]
        assert [got[r.seq] for r in rows] == before[:-1]


def test_next_known(events):
    sparse = events.withColumn("x", F.when((F.col("k") != "hot") | (F.col("seq") % 37 == 0), F.col("v")))
    out = next_known(sparse, ["k"], ["t", "seq"], {"nx": "x"})
    got = {r.seq: r.nx for r in out.collect()}
    for rows in by_key(sparse).values():
        ahead = None
        for r in reversed(rows):
            ahead = r.x if r.x is not None else ahead
            assert got[r.seq] == ahead


def test_missing_keys_and_order(spark):
    """A NULL key is a key, a NULL order value comes first, and a burst at one time is cut."""
    data = [(None, None, 0, 5), (None, 7, 1, 1), (None, 7, 2, 2), ("a", None, 3, 5), *[("a", 7, 4 + i, 1) for i in range(300)]]
    rows = spark.createDataFrame(data, "k string, t bigint, seq bigint, v int")
    out = running(rows, ["k"], ["t", "seq"], sums={"total": F.col("v")})
    got = {r.seq: r.total for r in out.collect()}
    assert [got[i] for i in range(3)] == [5, 6, 8] and [got[3 + i] for i in range(301)] == list(range(5, 306))
    out = previous(rows, ["k"], ["t", "seq"], {"before": "seq"})
    got = {r.seq: r.before for r in out.collect()}
    assert got == {i: None if i in (0, 3) else i - 1 for i in range(304)}


def test_half_of_all_rows_at_one_instant(spark):
    """Rows of one key and one time are cut by their hash, and every one follows another."""
    data = [("hot", 7, i, i % 5) for i in range(3000)] + [(f"k{i % 50}", i, 3000 + i, i % 3) for i in range(3000)]
    rows = spark.createDataFrame(data, "k string, t bigint, seq bigint, v int")
    slices = Slices(rows, ["k"], ["t"])
    assert slices.rows.filter("k = 'hot'").select("_slice").distinct().count() >= 3
    assert slices.of_cut_keys().select("k").distinct().count() <= 8
    out = running(rows, ["k"], ["t"], sums={"total": F.col("v") * 0 + 1}).filter("k = 'hot'")
    assert sorted(r.total for r in out.collect()) == list(range(1, 3001))
    before = [r.before for r in previous(rows, ["k"], ["t"], {"before": "seq"}).filter("k = 'hot'").collect()]
    assert before.count(None) == 1 and len(set(before)) == 3000
    ahead = next_known(rows.withColumn("x", F.when(F.col("seq") == 17, 1)), ["k"], ["t"], {"nx": "x"}).filter("k = 'hot'")
    assert 0 < ahead.filter("nx = 1").count() <= 3000 and ahead.filter("seq = 17 and nx = 1").count() == 1


def test_hot_request_is_folded_by_blocks(spark):
    """One reading of the log, and the lines of a hot request meet block by block."""
    n = 100_000
    ident = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("r"), (F.col("id") % 5000).cast("string")))
    log = spark.range(0, n, 1, 16).select(
        ident.alias("request_id"),
        F.lit("baseline").alias("system"),
        F.lit("L4").alias("gpu_type"),
        F.col("id").alias("seq"),
        F.timestamp_micros("id").alias("ts"),
        F.when(F.col("id") == 90_000, "data: [DONE]").otherwise('data: {"choices": [{"delta": {"content": "ab"}}]}').alias("line"),
    )
    folded = chunks.fold(log)
    got = {r.request_id: r.chunks for r in folded.collect()}
    plan = folded._jdf.queryExecution().executedPlan().toString()
    assert got["hot"] == 30_000 and len(got) == 5001
    assert "SortMergeJoin" not in plan and plan.split("Initial Plan")[-1].count("Range (") == 1
    blocks = chunks.block_totals(chunks.sized(chunks.parse_lines(log)), ["request_id"]).filter("request_id = 'hot'")
    assert blocks.count() == -(-n // chunks.LINES_PER_BLOCK)
