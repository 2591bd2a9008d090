"""Token-chunk logs: parse event-stream lines and fold them to request metrics."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from armlens import schema as S
from armlens.functions.numeric import exact_round, ratio
from armlens.functions.text import strip
from armlens.operators import views
from armlens.plans.sliced import running

# The marks of the line grammar.
DATA_MARK = "data: "
DONE_MARK = "[DONE]"
ERROR_MARK = "error: "

MICROS = 1_000_000
# Tasks that the lines of one hot request are dealt to, and lines put together at a time.
SALTS = 16
LINES_PER_BLOCK = 4096


def parse_lines(log: DataFrame) -> DataFrame:
    """Add what each line says. Other lines, bad JSON and empty chunks say nothing."""
    line = strip("line")
    is_data = line.startswith(DATA_MARK)
    payload = F.when(is_data, F.substr(line, F.lit(len(DATA_MARK) + 1)))
    chunk = F.from_json(
        F.when(payload != DONE_MARK, payload),
        S.CHUNK,
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"},
    )
    good = F.col("_chunk._corrupt").isNull()
    content = F.get("_chunk.choices", F.lit(0))["delta"]["content"]
    return (
        log.withColumn("_chunk", chunk)
        .withColumns(
            {
                "micros": F.unix_micros(F.col("ts").cast("timestamp")),
                "is_done": F.coalesce(payload == DONE_MARK, F.lit(False)),
                "error": F.when(
                    line.startswith(ERROR_MARK), F.substr(line, F.lit(len(ERROR_MARK) + 1))
                ),
                "content": F.when(good & (content != ""), content),
                "usage_tokens": F.when(good, F.col("_chunk.usage.completion_tokens")),
            }
        )
        .drop("_chunk")
    )


def is_terminal() -> Column:
    return F.col("is_done") | F.col("error").isNotNull()


def salt() -> Column:
    """The task, of those that a hot request's lines are dealt to; 0 for a line without ``seq``."""
    return F.coalesce(F.pmod("seq", F.lit(SALTS)), F.lit(0)).cast("int")


def until_terminal(parsed: DataFrame) -> DataFrame:
    """Drop lines after a request's first [DONE] or error line; a client stops there.

    ``seq`` orders a request's lines; a line without one has no place after the end and stays.
    Adds ``closed``, and ``error`` becomes that of the request. Only requests with a terminal
    line are on the right side, once per salt, so a hot request is joined by several tasks.
    """
    ends = (
        parsed.filter(is_terminal())
        .groupBy("request_id")
        .agg(F.min("seq").alias("_end"), F.min_by("error", "seq").alias("_error"), F.lit(True).alias("_closed"))
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    )
    return (
        parsed.withColumn("_salt", salt())
        .join(ends, ["request_id", "_salt"], "left")
        .filter(F.coalesce(F.col("seq") <= F.col("_end"), F.lit(True)))
        .withColumns({"closed": F.coalesce("_closed", F.lit(False)), "error": F.col("_error")})
        .drop("_end", "_error", "_closed", "_salt")
    )


def sized(parsed: DataFrame) -> DataFrame:
    """Parsed lines as numbers: the content's length for the content, no text of the line."""
    return parsed.withColumn("size", F.length("content")).drop("content", "line")


def line_totals() -> list[Column]:
    """What one request needs from its lines: numbers only, so that each task folds
    its lines in a hash map before they are shuffled."""
    has_content = F.col("size").isNotNull()
    return [
        F.min("micros").alias("start_us"),
        F.min(F.when(has_content, F.col("micros"))).alias("first_us"),
        F.max("micros").alias("end_us"),
        F.count_if(has_content).alias("chunks"),
        F.sum(F.coalesce("size", F.lit(0)).cast("bigint")).alias("chars"),
        F.max_by("usage_tokens", F.when(F.col("usage_tokens").isNotNull(), F.col("seq"))).alias(
            "usage_tokens"
        ),
    ]


def closing() -> list[Column]:
    """Whether lines that are cut at the terminal one hold it, and what error it names."""
    return [F.max(is_terminal()).alias("closed"), F.max("error").alias("error")]


def _summed(lines: Column) -> Column:
    """The totals of an array of lines as one struct of numbers."""

    def of(condition, value):
        return F.transform(F.filter(lines, condition), value)

    content = of(lambda x: x["size"].isNotNull(), lambda x: x["micros"])
    sizes = of(lambda x: x["size"].isNotNull(), lambda x: x["size"].cast("bigint"))
    usage = of(lambda x: x["usage_tokens"].isNotNull() & x["seq"].isNotNull(), lambda x: F.struct(x["seq"], x["usage_tokens"]))
    micros = F.transform(lines, lambda x: x["micros"])
    return F.struct(
        F.array_min(micros).alias("start_us"),
        F.array_min(content).alias("first_us"),
        F.array_max(micros).alias("end_us"),
        F.size(content).cast("bigint").alias("chunks"),
        F.aggregate(sizes, F.lit(0).cast("bigint"), lambda acc, x: acc + x).alias("chars"),
        F.array_max(usage).alias("usage"),
    )


def block_totals(parsed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A request's lines in blocks of ``LINES_PER_BLOCK`` numbers of ``seq``, each as its totals up to its own
    first terminal line: ``block``, ``totals``, ``closed`` and ``error``.

    A block's lines meet in one value of bounded size. Lines without a ``seq`` have no place after an
    end: they are sums, in a row without a block.
    """
    block = F.floor(F.col("seq") / LINES_PER_BLOCK).alias("block")
    line = F.struct("seq", "micros", "size", "usage_tokens", is_terminal().alias("ends"), "error")
    found = parsed.groupBy(*keys, block).agg(
        F.collect_list(F.when(F.col("seq").isNotNull(), line)).alias("_lines"), *line_totals(), F.max(is_terminal()).alias("closed")
    )
    end = F.array_min(F.transform(F.filter("_lines", lambda x: x["ends"]), lambda x: F.struct(x["seq"], x["error"])))
    found = found.withColumn("_end", end)
    kept = F.filter("_lines", lambda x: F.coalesce(x["seq"] <= F.col("_end.seq"), F.lit(True)))
    no_usage = F.lit(None).cast("struct<seq:bigint,usage_tokens:int>").alias("usage")
    loose = F.struct("start_us", "first_us", "end_us", "chunks", "chars", no_usage)
    return found.withColumn("_kept", kept).select(
        *keys, "block", F.when(F.col("block").isNull(), loose).otherwise(_summed(F.col("_kept"))).alias("totals"), "closed", F.col("_end.error").alias("error")
    )


def together(blocks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A request's totals from its blocks: those before the first that holds an end, and that one."""
    part = F.struct("block", "closed", "error", "totals")
    found = blocks.groupBy(*keys).agg(F.collect_list(part).alias("_blocks"))
    ends = F.filter("_blocks", lambda x: x["closed"] & x["block"].isNotNull())
    found = found.withColumn("_end", F.array_min(F.transform(ends, lambda x: F.struct(x["block"], x["error"]))))
    live = F.filter("_blocks", lambda x: F.coalesce(x["block"] <= F.col("_end.block"), F.lit(True)))
    found = found.withColumn("_live", F.transform(live, lambda x: x["totals"]))

    def each(name: str) -> Column:
        return F.transform("_live", lambda x: x[name])

    def total(name: str) -> Column:
        return F.aggregate(each(name), F.lit(0).cast("bigint"), lambda acc, x: acc + x).alias(name)

    return found.select(
        *keys,
        F.array_min(each("start_us")).alias("start_us"),
        F.array_min(each("first_us")).alias("first_us"),
        F.array_max(each("end_us")).alias("end_us"),
        total("chunks"),
        total("chars"),
        F.array_max(each("usage"))["usage_tokens"].alias("usage_tokens"),
        F.exists("_blocks", lambda x: x["closed"]).alias("closed"),
        F.col("_end.error").alias("error"),
    )


def folded(log: DataFrame) -> DataFrame:
    """One row of totals per request, from one reading of the log. Arm and hardware are the same on all lines."""
    keys = ["request_id", "system", "gpu_type"]
    return together(block_totals(sized(parse_lines(log)), keys), keys)


def token_count(estimate: bool = False) -> Column:
    """The server's count, else the content chunks; or, as an estimate where the
    count is missing or 0, a quarter of the characters and at least one."""
    if estimate:
        guess = F.greatest(F.expr("chars div 4"), F.lit(1).cast("bigint"))
        return F.coalesce(F.nullif(F.col("usage_tokens"), F.lit(0)).cast("bigint"), guess)
    return F.coalesce(F.col("usage_tokens").cast("bigint"), F.col("chunks"))


def request_metrics(
    totals: DataFrame,
    timeout_s: float = S.REQUEST_TIMEOUT_S,
    estimate: bool = False,
    rates: DataFrame | None = None,
    require_terminal: bool = False,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Metrics of the request log from the folded lines; late requests fail.

    With ``require_terminal`` a request that never logged its end is late too.
    """
    late = (F.col("end_us") - F.col("start_us")) > F.lit(int(timeout_s * MICROS))
    if require_terminal:
        late = late | ~F.col("closed")
    seconds = lambda a, b: (F.col(b) - F.col(a)) / float(MICROS)
    out = totals.withColumns(
        {
            "error": F.when(late, F.lit("timeout")).otherwise(F.col("error")),
            "latency_s": F.when(late, F.lit(float(timeout_s))).otherwise(
                seconds("start_us", "end_us")
            ),
            "output_tokens": token_count(estimate),
        }
    )
    tokens = F.col("output_tokens")
    ttft = seconds("start_us", "first_us")
    tpot = F.when(tokens > 1, ratio(seconds("first_us", "end_us"), tokens - 1))
    raw = {
        "ttft_ms": F.nullif(ttft, F.lit(0.0)) * 1000,
        "tpot_ms": F.nullif(tpot, F.lit(0.0)) * 1000,
        "total_latency_ms": F.col("latency_s") * 1000,
        "tokens_per_sec": ratio(tokens.cast("double"), "latency_s"),
    }
    # Values first, rounding on top: the rounding names its input many times.
    out = out.withColumns(raw).withColumns({c: exact_round(c, 2) for c in raw})
    out = views.with_cost(out, rates)
    out = views.as_failed_where(out, F.col("error").isNotNull())
    return out.select(
        "request_id",
        "system",
        "gpu_type",
        "ttft_ms",
        "tpot_ms",
        "total_latency_ms",
        "output_tokens",
        "tokens_per_sec",
        "gpu_cost_usd",
        "chunks",
        "chars",
        "error",
        *keep,
    )


def fold(
    log: DataFrame,
    timeout_s: float = S.REQUEST_TIMEOUT_S,
    estimate: bool = False,
    rates: DataFrame | None = None,
    require_terminal: bool = False,
) -> DataFrame:
    """One metrics row per request from its logged lines."""
    return request_metrics(folded(log), timeout_s, estimate, rates, require_terminal)


def output_texts(log: DataFrame) -> DataFrame:
    """The output text of each request, put together from its chunks: first blocks of lines
    that follow each other, then the blocks. Lines without a ``seq`` come first."""
    lines = until_terminal(parse_lines(log)).filter(F.col("content").isNotNull())

    def joined(order: str, text: str) -> Column:
        ordered = F.sort_array(F.collect_list(F.struct(order, text)))
        return F.concat_ws("", F.transform(ordered, lambda c: c[text]))

    block = F.floor(F.col("seq") / LINES_PER_BLOCK)
    blocks = lines.groupBy("request_id", block.alias("block")).agg(joined("seq", "content").alias("text"))
    return blocks.groupBy("request_id").agg(joined("block", "text").alias("output_text"))


def timeouts(metrics: DataFrame) -> DataFrame:
    return metrics.filter(F.col("error") == "timeout")


def race_progress(log: DataFrame) -> DataFrame:
    """Estimated tokens and speed at every content chunk of a running request."""
    lines = until_terminal(sized(parse_lines(log))).select("request_id", "system", "micros", "seq", "size")
    run = running(
        lines,
        ["request_id"],
        ["seq"],
        sums={"chars": F.coalesce("size", F.lit(0)).cast("bigint")},
        minima={"start_us": F.col("micros")},
    ).filter(F.col("size").isNotNull())
    elapsed = (F.col("micros") - F.col("start_us")) / float(MICROS)
    return run.select(
        "request_id",
        "system",
        "seq",
        F.expr("chars div 4").alias("est_tokens"),
        elapsed.alias("elapsed_s"),
        F.when(elapsed > 0, F.expr("chars div 4") / elapsed).alias("est_tokens_per_sec"),
    )


def chars_per_chunk(metrics: DataFrame) -> DataFrame:
    """Mean characters per content chunk: near one token's length only when each
    chunk carries one token."""
    return metrics.groupBy("system").agg(
        F.avg(ratio(F.col("chars").cast("double"), F.col("chunks").cast("double"))).alias(
            "chars_per_chunk"
        ),
        F.count(F.lit(1)).alias("requests"),
    )


def without_duplicates(log: DataFrame) -> DataFrame:
    """One line per (request, seq); re-sent lines are equal."""
    return log.dropDuplicates(["request_id", "seq"])
