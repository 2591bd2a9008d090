import json
import statistics

import pytest
from conftest import rows
from pyspark.sql import functions as F

from armlens import schema as S
from armlens import session
from armlens.operators import coverage, summary
from armlens.sources import requests as source
from armlens.sources import tables
from armlens.streaming import jobs


def line(**values):
    base = {"request_id": "chat_0000_c1_t1", "task": "chat", "concurrency": 1, "system": "baseline", "gpu_type": "L4", "trial": 1, "ttft_ms": 5.0, "output_tokens": 3, "tokens_per_sec": 2.0}
    return json.dumps({**base, **values})


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "baseline_L4_chat_c01_t1.jsonl").write_text(
        "\n".join([line(), "", line(ttft_ms=float("nan")), '{"request_id": "x", broken', line(error="down", ttft_ms=None)]) + "\n"
    )
    (tmp_path / "baseline_L4_chat_c01_t99.jsonl").write_text(line(trial=99) + "\n")
    (tmp_path / "mlx_spec_mac_code_c08_t2.jsonl").write_text(line(system="mlx_spec", gpu_type="mac", task="code", concurrency=16, trial=2) + "\n")
    return str(tmp_path)


def test_read_requests(spark, folder):
    got = source.read_requests(spark, folder)
    assert got.count() == 4 and set(got.columns) == {f.name for f in S.REQUEST.fields}
    assert got.filter("ttft_ms is null").count() == 2 and got.filter("isnan(ttft_ms)").count() == 0
    assert source.read_requests(spark, folder, exclude_trials=()).count() == 5
    assert source.read_requests(spark, folder, exclude_trials=(1, 99)).count() == 1


def test_malformed_lines(spark, folder, tmp_path_factory):
    target = str(tmp_path_factory.mktemp("sorted") / "out")
    source.sort_out(spark, folder, target)
    (bad,) = source.quarantined(spark, target).collect()
    assert rows(source.read_sorted(spark, target), "trial", "ttft_ms") == rows(source.read_requests(spark, folder), "trial", "ttft_ms")
    assert (bad.file_name, bad.line) == ("baseline_L4_chat_c01_t1.jsonl", '{"request_id": "x", broken')
    assert source.read_requests(spark, folder, mode="DROPMALFORMED").count() == 4
    with pytest.raises(Exception, match="Malformed|MALFORMED|FAILED_READ"):
        source.read_requests(spark, folder, mode="FAILFAST").collect()


def test_file_names_against_rows(spark, folder):
    named = source.with_file_name(spark, folder).filter("system is not null")
    assert rows(coverage.cell_name_mismatches(named)) == [("mlx_spec_mac_code_c08_t2.jsonl", 1)]


def test_written_result_files_have_their_cells_names(spark, requests_of, tmp_path):
    log = requests_of({"trial": 1}, {"trial": 2, "system": "eagle3"}, {"trial": 2, "concurrency": 16})
    source.write_result_files(log, f"{tmp_path}/out")
    names = sorted(r.file_name for r in source.with_file_name(spark, f"{tmp_path}/out").collect())
    assert names == ["baseline_L4_chat_c01_t1.jsonl", "baseline_L4_chat_c16_t2.jsonl", "eagle3_L4_chat_c01_t2.jsonl"]
    assert source.read_requests(spark, f"{tmp_path}/out").count() == 3


def test_cells_are_replaced_one_by_one(spark, requests_of, tmp_path):
    path = f"{tmp_path}/cells"
    log = requests_of({"trial": 1}, {"trial": 1}, {"trial": 2}, {"system": "eagle3"})
    source.write_cells(log, path)
    source.write_cells(requests_of({"trial": 1, "ttft_ms": 1.0}), path)
    got = rows(source.read_cells(spark, path).select("system", "trial", "ttft_ms"), "system", "trial")
    assert got == [("baseline", 1, 1.0), ("baseline", 2, 50.0), ("eagle3", 1, 50.0)]
    plan = source.read_cells(spark, path).filter("trial = 2")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(trial" in plan


def test_csv_keeps_missing_values(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5, None), ("b", None, "x")], "k string, v double, s string")
    tables.write_table(df, f"{tmp_path}/t")
    assert rows(tables.read_table(spark, f"{tmp_path}/t", df.schema), "k") == rows(df, "k")


def test_streamed_files_and_summary(spark, requests_of, tmp_path):
    log = requests_of({"ttft_ms": 1.0}, {"ttft_ms": 3.0}, {"system": "eagle3"}, {"error": "x", "ttft_ms": None})
    source.write_request_lines(log.limit(2), f"{tmp_path}/in")

    def newest():
        stream = source.stream_requests(spark, f"{tmp_path}/in", max_files=1)
        jobs.keep_summary(stream, f"{tmp_path}/out", f"{tmp_path}/ck")
        return rows(jobs.kept_means(spark, f"{tmp_path}/out"), "system")

    assert [r[4] for r in newest()] == [2.0]
    for _ in range(3):
        log.filter("system = 'eagle3' or error is not null").write.mode("append").json(f"{tmp_path}/in")
    whole = log.union(log.filter("system = 'eagle3'")).union(log.filter("system = 'eagle3'"))
    assert newest() == rows(summary.dashboard_means(whole), "system")
    assert len(list((tmp_path / "out").glob("version=*"))) == 2


def test_a_repeated_batch_changes_nothing(spark, requests_of, tmp_path):
    values = [1.0, 5.0, 9.0, 2.0]
    log = requests_of(*({"ttft_ms": v} for v in values))
    parts = [summary.partial_stats(log.filter(F.col("ttft_ms") < x), summary.DASHBOARD_KEY, summary.DASHBOARD) for x in (3, 9)]
    both = summary.merged_stats(parts[0].union(parts[1]), summary.DASHBOARD_KEY, summary.DASHBOARD)
    got = summary.means_of_stats(both, summary.DASHBOARD_KEY, summary.DASHBOARD, deviation=True).first()
    seen = [1.0, 2.0, 1.0, 5.0, 2.0]
    assert got.ttft_ms == pytest.approx(statistics.mean(seen)) and got.ttft_ms_std == pytest.approx(statistics.stdev(seen))
    source.write_request_lines(log, f"{tmp_path}/in")
    for number in (1, 2):  # the second run has no checkpoint and starts from the first batch again
        jobs.keep_summary(source.stream_requests(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/ck{number}")
        assert jobs.kept_means(spark, f"{tmp_path}/out").first().ttft_ms == statistics.mean(values)


def test_written_intermediates_can_be_removed(spark, monkeypatch):
    monkeypatch.setattr(session, "_made", {})
    paths = [session.shared_dir(spark, name) for name in ("one", "two")]
    for path in paths:
        spark.range(3).write.parquet(path)
    assert [spark.read.parquet(p).count() for p in paths] == [3, 3]
    assert session.release(spark) == 2 and session.release(spark) == 0
    for path in paths:
        with pytest.raises(Exception, match="PATH_NOT_FOUND"):
            spark.read.parquet(path)


def test_line_files_are_packed_and_read_back(spark, requests_of, tmp_path):
    """Written lines take a fraction of their plain size, and rows, broken lines and names come back."""
    log = requests_of(*[{"system": s, "request_id": f"{s}_{i:06d}_c1_t1"} for s in ("baseline", "eagle3") for i in range(2_000)]).coalesce(2)
    plain = sum(len(r[0]) + 1 for r in log.select(F.to_json(F.struct(*log.columns))).collect())
    lines = log.select(F.to_json(F.struct(*log.columns)).alias("value")).unionByName(spark.createDataFrame([("{broken",), ("",)], "value string"))
    source.write_request_lines(log, f"{tmp_path}/rows")
    source.write_result_files(log, f"{tmp_path}/files")
    source.write_raw_lines(lines, f"{tmp_path}/lines")
    for folder in ("rows", "files", "lines"):
        written = sum(f.stat().st_size for f in (tmp_path / folder).rglob("part-*"))
        assert 0 < written < plain / 4
        assert source.read_requests(spark, f"{tmp_path}/{folder}", ()).select("request_id").distinct().count() == 4_000
    named = source.with_file_name(spark, f"{tmp_path}/files").select("file_name").distinct()
    assert rows(named, "file_name") == [("baseline_L4_chat_c01_t1.jsonl",), ("eagle3_L4_chat_c01_t1.jsonl",)]
    source.sort_out(spark, f"{tmp_path}/lines", f"{tmp_path}/sorted")
    assert [r.line for r in source.quarantined(spark, f"{tmp_path}/sorted").collect()] == ["{broken"]
