"""Structured Streaming forms of the chunk fold and the summaries."""

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from armlens import schema as S
from armlens.functions.numeric import exact_mean
from armlens.operators import chunks, summary, views
from armlens.session import remove
from armlens.sources import logs

# A stage's last row: it moves the watermark past all real ones, so that the
# final windows of a finite input close. It never leaves its own window.
DRAIN_ID = "~drain"
DRAIN_TS = "2200-01-01 00:00:00"


def without_duplicates(log: DataFrame, delay: str = "120 seconds") -> DataFrame:
    """Drop re-sent chunks that arrive within the watermark delay."""
    return log.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["request_id", "seq"])


def until_terminal(parsed: DataFrame, delay: str = "120 seconds", span: str = "600 seconds") -> DataFrame:
    """Drop lines after a request's first terminal line, as ``chunks.until_terminal`` does in batch.

    A line goes if the request has a terminal line with a smaller ``seq`` that is at most ``span``
    older and ``delay`` newer than it. Each line waits as a row of its own until the watermark has
    passed it by ``delay``, and the terminal lines wait for ``span``, once per salt, so that neither
    a value of the state nor a task grows with a request.
    """
    lines = parsed.withColumn("_salt", chunks.salt())
    ends = parsed.filter(chunks.is_terminal() & F.col("seq").isNotNull()).select(
        F.col("request_id").alias("_id"),
        F.col("seq").alias("_end"),
        F.col("ts").alias("_end_ts"),
        F.explode(F.sequence(F.lit(0), F.lit(chunks.SALTS - 1))).alias("_end_salt"),
    )
    cut = (
        (F.col("request_id") == F.col("_id"))
        & (F.col("_salt") == F.col("_end_salt"))
        & (F.col("seq") > F.col("_end"))
        & F.expr(f"_end_ts <= ts + interval {delay}")
        & F.expr(f"_end_ts >= ts - interval {span}")
    )
    return lines.join(ends, cut, "left").filter("_id is null").drop("_salt", *ends.columns)


def fold_sessions(
    log: DataFrame,
    delay: str = "120 seconds",
    gap: str = "120 seconds",
    timeout_s: float = S.REQUEST_TIMEOUT_S,
    require_terminal: bool = False,
    keep: Sequence[str] = (),
) -> DataFrame:
    """One metrics row per request once its session has closed.

    The lines are cut at the terminal one first, so what a session keeps are its totals: the state
    has one small row per open request. A terminal line ends its session, so its reach is ``gap``.
    """
    parsed = chunks.sized(chunks.parse_lines(log.withWatermark("ts", delay)))
    lines = until_terminal(parsed, delay, gap)
    sessions = lines.groupBy("request_id", "system", "gpu_type", F.session_window("ts", gap))
    totals = sessions.agg(*chunks.line_totals(), *chunks.closing())
    return chunks.request_metrics(totals, timeout_s, require_terminal=require_terminal, keep=keep)


def live_totals(log: DataFrame, delay: str = "120 seconds", span: str = "1 hour") -> DataFrame:
    """Lines of every running request per time span and block of ``seq``, as numbers, for update mode.

    A value holds the lines of one block, and a trigger writes only the blocks it changed; lines
    without a ``seq`` always count and are sums. Spans behind the watermark leave the state, so it
    holds live requests only.
    """
    parsed = chunks.sized(chunks.parse_lines(log.withWatermark("ts", delay)))
    block = F.floor(F.col("seq") / chunks.LINES_PER_BLOCK).alias("block")
    spans = parsed.groupBy("request_id", "system", F.window("ts", span), block).agg(
        F.collect_list(F.when(F.col("seq").isNotNull(), F.struct("seq", "micros", "size", "is_done", "error"))).alias("lines"),
        *(f.alias(c) for c, f in _sums(F.col("seq").isNull()).items()),
    )
    return spans.select("request_id", "system", F.col("window.start").alias("span"), "block", "lines", "chars", "start_us", "last_us")


def _sums(where: Column) -> dict[str, Column]:
    micros = F.when(where, F.col("micros"))
    size = F.when(where, F.coalesce("size", F.lit(0)).cast("bigint"))
    return {"chars": F.sum(size), "start_us": F.min(micros), "last_us": F.max(micros)}


def keep_progress(totals: DataFrame, path: str, checkpoint: str) -> None:
    """The blocks of all running requests as a table in the sink: a changed block replaces the one
    that was there."""
    key = ["request_id", "system", "span", "block"]

    def merged(batch: DataFrame, before: DataFrame | None) -> DataFrame:
        if before is None:
            return batch
        both = before.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)))
        values = [c for c in batch.columns if c not in key]
        return both.groupBy(*key).agg(F.max_by(F.struct(*values), "_new").alias("_v")).select(*key, "_v.*")

    fold_batches(totals, path, checkpoint, "update", merged)


def request_progress(current: DataFrame) -> DataFrame:
    """Current progress per request: all its blocks together up to the request's end."""
    lines = chunks.until_terminal(current.select("request_id", "system", F.inline("lines")))
    placed = lines.groupBy("request_id", "system").agg(*(f.alias(c) for c, f in _sums(F.lit(True)).items()))
    unplaced = current.filter(F.col("start_us").isNotNull()).select("request_id", "system", "chars", "start_us", "last_us")
    return (
        placed.unionByName(unplaced)
        .groupBy("request_id", "system")
        .agg(F.sum("chars").alias("chars"), F.min("start_us").alias("start_us"), F.max("last_us").alias("last_us"))
        .withColumn("est_tokens", F.expr("chars div 4"))
    )


def keep_summary(requests: DataFrame, path: str, checkpoint: str) -> None:
    """The dashboard's statistics kept up to date: each batch's partial ones are merged by key into
    the table of the batch before. The stream keeps no state of its own."""
    key, metrics = summary.DASHBOARD_KEY, summary.DASHBOARD

    def merged(batch: DataFrame, before: DataFrame | None) -> DataFrame:
        parts = summary.partial_stats(views.weakly_valid_requests(batch), key, metrics)
        return summary.merged_stats(parts if before is None else before.unionByName(parts), key, metrics)

    fold_batches(requests, path, checkpoint, "append", merged)


def kept_means(spark: SparkSession, path: str, deviation: bool = False) -> DataFrame:
    """The dashboard table after the last batch."""
    return summary.means_of_stats(newest(spark, path), summary.DASHBOARD_KEY, summary.DASHBOARD, deviation)


def window_averages(
    completed: DataFrame, window: str = "1 minute", delay: str = "120 seconds"
) -> DataFrame:
    """Both arms' averages per tumbling window over request rows with ``ended_at``."""
    return (
        completed.withWatermark("ended_at", delay)
        .withColumn("arm", views.arm())
        .groupBy(F.window("ended_at", window), "arm")
        .agg(
            F.count(F.lit(1)).alias("requests"),
            exact_mean("tokens_per_sec").alias("avg_tps"),
            exact_mean("ttft_ms").alias("avg_ttft_ms"),
            exact_mean("tpot_ms").alias("avg_tpot_ms"),
            F.sum(F.coalesce(F.col("gpu_cost_usd"), F.lit(0.0)).cast("decimal(20,8)"))
            .cast("double")
            .alias("cost_usd"),
        )
        .select(F.col("window.start").alias("window_start"), "arm", "requests", "avg_tps", "avg_ttft_ms", "avg_tpot_ms", "cost_usd")
    )


def stage(
    log: DataFrame, path: str, cut: str = "5 days", shift: str = "12 hours", files: int = 2, again: Column | None = None
) -> None:
    """Write a log in slices of time, one after the other, each in ``files`` files with its rows in no
    order, and the closing row last: a stream of ``files`` files per trigger reads slice by slice.

    Rows where ``again`` holds come again in their own slice, in the next and in the one after that.
    """
    spark = log.sparkSession
    sliced = log.withColumn("_slice", F.window("ts", cut, startTime=shift)["start"])
    times = [row[0] for row in sliced.select("_slice").distinct().orderBy("_slice").collect()]  # one per slice of time
    for k, time in enumerate(times):
        some = sliced.filter(F.col("_slice") == F.lit(time))
        if again is not None:
            some = some.unionByName(sliced.filter(F.col("_slice").isin(times[max(k - 2, 0) : k + 1])).filter(again))
        logs.write_log(some.drop("_slice").repartition(files), path, S.CHUNK_LOG)
    logs.write_log(drain_row(spark), path, S.CHUNK_LOG)


def append_to(stream: DataFrame, path: str, checkpoint: str) -> int:
    """Process what is there, write finished rows, stop, and say how many rows came behind the watermark
    and were left out. Exactly once per checkpoint."""
    query = stream.writeStream.format("parquet").option("path", path).option(
        "checkpointLocation", checkpoint
    ).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators)


def write_batches(stream: DataFrame, path: str, checkpoint: str, mode: str) -> None:
    """Write what each batch changed (update mode) or the whole small result
    (complete mode) to a folder of its own. A repeated batch replaces its folder."""

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(
            f"{path}/batch={number}"
        )

    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).outputMode(
        mode
    ).trigger(availableNow=True).start().awaitTermination()


def fold_batches(
    stream: DataFrame, path: str, checkpoint: str, mode: str, merged: Callable[[DataFrame, DataFrame | None], DataFrame]
) -> None:
    """A table kept in the sink: ``merged`` makes its next version from a batch and the version
    before, None at first. A repeated batch starts from the same version again, so it changes nothing."""

    def each(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = spark.read.parquet(f"{path}/version={number - 1}") if number else None
        merged(batch, before).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{path}/version={number}")
        if number > 1:  # the version before stays, for the case that this batch is repeated
            remove(spark, f"{path}/version={number - 2}")

    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).outputMode(
        mode
    ).trigger(availableNow=True).start().awaitTermination()


def newest(spark: SparkSession, path: str) -> DataFrame:
    """The last version of a table that ``fold_batches`` keeps."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    folders = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(hadoop)
    last = max(int(f.getPath().getName().removeprefix("version=")) for f in folders)
    return spark.read.parquet(f"{path}/version={last}")


def drain_row(spark: SparkSession) -> DataFrame:
    """The closing row of a staged chunk log."""
    empty = spark.range(1)
    values = {"request_id": F.lit(DRAIN_ID), "ts": F.lit(DRAIN_TS).cast("timestamp"), "line": F.lit(":")}
    return empty.select(
        *[
            values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name)
            for f in S.CHUNK_LOG.fields
        ]
    )
