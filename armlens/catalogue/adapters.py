"""The driver's test tables in the shapes the operators read.

Each adapter is a list of SQL expressions that both engines accept, so a query and
its check start from the same rows. ``as_sql`` gives the text for the check.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from armlens.plans.sliced import running


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def apply(df: DataFrame, *stages: Sequence[str]) -> DataFrame:
    for exprs in stages:
        df = df.selectExpr(*exprs)
    return df


def as_sql(source: str, *stages: Sequence[str]) -> str:
    text = source
    for exprs in stages:
        text = f"SELECT {', '.join(exprs)} FROM ({text})" if text != source else (
            f"SELECT {', '.join(exprs)} FROM {source}"
        )
    return text


# --- request log from lineitem ------------------------------------------------

REQUEST_FACTS = [
    "CASE l_returnflag WHEN 'A' THEN 'chat' WHEN 'N' THEN 'code' ELSE 'summarization' END AS task",
    "CASE WHEN l_suppkey % 10 = 9 THEN 'V100' WHEN l_suppkey % 4 = 0 THEN 'A100'"
    " WHEN l_suppkey % 4 = 1 THEN 'L4' WHEN l_suppkey % 4 = 2 THEN 'T4' ELSE 'mac' END AS gpu_type",
    "l_linestatus = 'F' AS is_spec",
    "CAST(CASE l_partkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 4 WHEN 2 THEN 8 WHEN 3 THEN 16 ELSE 32 END"
    " AS INT) AS concurrency",
    "CAST(CASE WHEN l_linenumber = 7 THEN 99 ELSE l_linenumber % 3 + 1 END AS INT) AS trial",
    "concat_ws('_', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING),"
    " CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING)) AS row_key",
    "l_orderkey",
    "l_partkey",
    "CASE WHEN l_tax <= 0 THEN 'timeout' END AS error",
    "l_extendedprice / 10 AS total_latency_ms",
    "CASE WHEN l_tax > 0 THEN nullif(l_extendedprice * l_discount / 10, 0) END AS ttft_ms",
    "CASE WHEN l_tax <= 0 THEN 0 ELSE CAST(l_quantity AS INT) * 5 - 4 END AS output_tokens",
    "CASE WHEN l_linestatus = 'F' AND l_partkey % 7 <> 0 THEN l_discount * 5 END AS acceptance_rate",
]

REQUESTS = [
    "concat(task, '_', row_key, '_c', CAST(concurrency AS STRING), '_t', CAST(trial AS STRING))"
    " AS request_id",
    "concat(task, '_', CAST(l_orderkey AS STRING)) AS prompt_id",
    "task",
    "concurrency",
    "CASE WHEN gpu_type = 'mac' THEN CASE WHEN is_spec THEN 'mlx_spec' ELSE 'mlx_baseline' END"
    " WHEN is_spec THEN 'eagle3' ELSE 'baseline' END AS system",
    "gpu_type",
    "trial",
    "ttft_ms",
    "CASE WHEN output_tokens > 1 THEN (total_latency_ms - ttft_ms) / (output_tokens - 1) END"
    " AS tpot_ms",
    "total_latency_ms",
    "output_tokens",
    "CASE WHEN error IS NULL AND total_latency_ms > 0 THEN output_tokens / (total_latency_ms / 1000)"
    " END AS tokens_per_sec",
    "CASE gpu_type WHEN 'T4' THEN 0.35e0 WHEN 'L4' THEN 0.70e0 WHEN 'A100' THEN 3.67e0 ELSE 0e0 END"
    " / 3600 * (total_latency_ms / 1000) AS gpu_cost_usd",
    "CAST(NULL AS STRING) AS output_text",
    "acceptance_rate",
    "error",
    "l_partkey",
]


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply(table(spark, sf_dir, "lineitem"), REQUEST_FACTS, REQUESTS)


REQUESTS_SQL = as_sql("lineitem", REQUEST_FACTS, REQUESTS)

# --- chunk log from events ----------------------------------------------------

EVENT_FACTS = [
    "event_id",
    "ts",
    "user_id",
    "event_type",
    "value",
    "CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS k",
    "replace(CAST(CAST(ts AS DATE) AS STRING), '-', '') AS day",
]


def _content(text: str) -> str:
    return f"concat('data: {{\"choices\": [{{\"delta\": {{\"content\": \"', {text}, '\"}}}}]}}')"


CHUNK_LOG = [
    "concat('turn_chat_u', CAST(user_id AS STRING), '_', day, '_c1_t1') AS request_id",
    "CASE WHEN user_id % 2 = 0 THEN 'baseline' ELSE 'eagle3' END AS system",
    "CASE user_id % 3 WHEN 0 THEN 'A100' WHEN 1 THEN 'L4' ELSE 'T4' END AS gpu_type",
    "event_id AS seq",
    "ts",
    "CASE"
    " WHEN event_type = 'click' AND k % 10 = 1 THEN ': keep-alive'"
    f" WHEN event_type = 'click' THEN {_content("concat('click ', CAST(k AS STRING))")}"
    " WHEN event_type = 'view' AND k % 10 = 0 THEN 'data: {\"choices\": [{\"delta\"'"
    f" WHEN event_type = 'view' AND k % 10 = 2 THEN {_content("''")}"
    " WHEN event_type = 'view' AND k % 10 = 3 THEN 'data: {\"choices\": [{\"delta\": {}}]}'"
    f" WHEN event_type = 'view' THEN {_content("concat('vu é ', CAST(k * k AS STRING))")}"
    " WHEN event_type = 'purchase' AND k % 10 = 4 THEN 'data: {\"choices\": [], \"usage\": null}'"
    " WHEN event_type = 'purchase' THEN concat('data: {\"choices\": [], \"usage\":"
    " {\"completion_tokens\": ', CAST(k AS STRING), '}}')"
    " WHEN event_type = 'signup' AND k % 2 = 0 THEN 'data: [DONE]'"
    f" WHEN event_type = 'signup' THEN {_content("'signup'")}"
    " WHEN k % 2 = 0 THEN 'error: connection reset'"
    " ELSE 'event: ping' END AS line",
]


def chunk_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = apply(table(spark, sf_dir, "events"), EVENT_FACTS, CHUNK_LOG)
    return log.withColumn("ts", F.col("ts").cast("timestamp"))


CHUNK_LOG_SQL = as_sql("events", EVENT_FACTS, CHUNK_LOG)

# --- counter scrapes from events ----------------------------------------------
# Counters run per user and day, so each new day starts with a reset.

SCRAPES = [
    "CAST(user_id AS STRING) AS server",
    "ts",
    "event_id",
    "event_type",
    "CAST(user_id AS STRING) || day AS run",
    "k",
    "k + CAST(floor(value) AS BIGINT) AS drafted_step",
]
SCRAPE_LINES = [
    "server",
    "ts AS scrape_ts",
    "'# HELP vllm:spec_decode_num_accepted_tokens_total accepted draft tokens' AS line_0",
    "concat('vllm:spec_decode_num_accepted_tokens_total{engine=\"0\"} ',"
    " CAST(accepted AS STRING), '.0') AS line_1",
    "CASE WHEN k % 10 <> 9 THEN concat('vllm:spec_decode_num_draft_tokens_total{engine=\"0\"} ',"
    " CAST(drafted AS STRING), '.0') END AS line_2",
    "CASE WHEN k % 10 = 5 THEN concat('spec_decode_draft_acceptance_rate 0.',"
    " lpad(CAST(k AS STRING), 3, '0')) END AS line_3",
]


def counter_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = apply(table(spark, sf_dir, "events"), EVENT_FACTS, SCRAPES)
    steps = events.filter("event_type <> 'signup'").withColumn(
        "micros", F.unix_micros(F.col("ts").cast("timestamp"))
    )
    counted = running(
        steps,
        ["run"],
        ["micros", "event_id"],
        sums={"accepted": F.col("k"), "drafted": F.col("drafted_step")},
    )
    wide = counted.selectExpr(*SCRAPE_LINES)
    return (
        wide.select(
            "server",
            F.col("scrape_ts").cast("timestamp").alias("scrape_ts"),
            F.posexplode(F.array(*[F.col(f"line_{i}") for i in range(4)])).alias("line_no", "line"),
        )
        .filter(F.col("line").isNotNull())
        .withColumn("line_no", F.col("line_no").cast("bigint"))
    )


_COUNTED = (
    "SELECT *, CAST(sum(k) OVER w AS BIGINT) AS accepted, CAST(sum(drafted_step) OVER w AS BIGINT)"
    f" AS drafted FROM ({as_sql('events', EVENT_FACTS, SCRAPES)}) WHERE event_type <> 'signup'"
    " WINDOW w AS (PARTITION BY run ORDER BY ts, event_id)"
)
COUNTER_LOG_SQL = (
    "SELECT server, scrape_ts, line_no, line FROM ("
    + " UNION ALL ".join(
        f"SELECT server, scrape_ts, CAST({i} AS BIGINT) AS line_no, line_{i} AS line FROM wide"
        for i in range(4)
    )
    + ") WHERE line IS NOT NULL"
)
WIDE_SQL = f"SELECT {', '.join(SCRAPE_LINES)} FROM ({_COUNTED})"

# A cell of a server ends with each signup; its scrape follows.
CELL_ENDS = ["CAST(user_id AS STRING) AS server", "ts", "event_id AS cell_id", "event_type"]


def cell_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = apply(table(spark, sf_dir, "events"), CELL_ENDS).filter("event_type = 'signup'")
    return rows.select(
        "server", F.unix_micros(F.col("ts").cast("timestamp")).alias("end_us"), "cell_id"
    )


# --- outputs and prompts from conversations, benchmark and documents -------------

OUTPUTS = [
    "concat('chat_', CAST(conv_id AS STRING), '_', CAST(CASE WHEN role = 'assistant' THEN turn - 1"
    " ELSE turn END AS STRING)) AS prompt_id",
    "CASE WHEN role = 'assistant' THEN 'eagle3' ELSE 'baseline' END AS system",
    "CASE WHEN conv_id % 2 = 0 THEN 'A100' ELSE 'L4' END AS gpu_type",
    "CASE conv_id % 3 WHEN 0 THEN 'chat' WHEN 1 THEN 'code' ELSE 'summarization' END AS task",
    "1 AS concurrency",
    "99 AS trial",
    "text AS output_text",
    "role",
]


def outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user turn is the baseline's output, the assistant turn after it the treatment's."""
    rows = apply(table(spark, sf_dir, "conversations"), OUTPUTS).filter("role <> 'system'")
    return rows.drop("role").withColumn(
        "request_id", F.concat_ws("_", "prompt_id", F.lit("c1"), F.lit("t99"))
    )


OUTPUTS_SQL = f"SELECT * FROM ({as_sql('conversations', OUTPUTS)}) WHERE role <> 'system'"
PAIRS_SQL = (
    "SELECT b.gpu_type, b.task, b.prompt_id, b.concurrency, b.trial, b.output_text AS baseline_text,"
    " s.output_text AS spec_text FROM outputs b JOIN outputs s ON b.prompt_id = s.prompt_id"
    " AND b.system = 'baseline' AND s.system = 'eagle3'"
)

# The whole text as the reference, its last two thirds before its first third: no prefix of an output.
SUMMARY_OUTPUTS = [
    "concat('summarization_', CAST(doc_id AS STRING)) AS prompt_id",
    "text",
    "CASE WHEN doc_id % 10 <> 7 THEN concat(substr(text, CAST(floor(length(text) / 3) AS INT) + 1), ' ',"
    " substr(text, 1, CAST(floor(length(text) / 3) AS INT))) END AS reference_summary",
    "CASE WHEN doc_id % 13 = 0 THEN '' ELSE substr(text, 101) END AS shorter",
]


def _both_systems(rows: DataFrame, *carried: str) -> DataFrame:
    """A row per system; ``carried`` columns go along."""
    arms = F.array(
        *[
            F.struct(F.lit(system).alias("system"), F.col(text).alias("hyp"))
            for system, text in (("baseline", "text"), ("eagle3", "shorter"))
        ]
    )
    return rows.select("prompt_id", *carried, F.inline(arms))


def summary_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _both_systems(apply(table(spark, sf_dir, "documents"), SUMMARY_OUTPUTS))


def summary_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply(table(spark, sf_dir, "documents"), SUMMARY_OUTPUTS).select(
        F.col("prompt_id").alias("id"), "reference_summary"
    )


def whole_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs of both systems for every text of any length, with a whole reference, row by row."""
    rows = apply(table(spark, sf_dir, "documents"), SUMMARY_OUTPUTS)
    rows = rows.withColumn("ref", F.coalesce("reference_summary", F.lit("")))
    return _both_systems(rows, "ref").withColumn("pair_id", F.concat_ws("/", "prompt_id", "system"))


SUMMARIES_SQL = (
    f"SELECT *, 'baseline' AS system, text AS hyp FROM ({as_sql('documents', SUMMARY_OUTPUTS)})"
    f" UNION ALL SELECT *, 'eagle3' AS system, shorter AS hyp FROM ({as_sql('documents', SUMMARY_OUTPUTS)})"
)
SCORABLE_SQL = (
    "SELECT * FROM (SELECT prompt_id || '/' || system AS pair_id, system, coalesce(reference_summary, '')"
    f" AS ref, hyp FROM ({SUMMARIES_SQL})) WHERE length(ref) > 0 AND length(hyp) > 0"
)

DOC_PAIRS = [
    "concat('summarization_', CAST(doc_id AS STRING)) AS prompt_id",
    "lang AS task",
    "text AS baseline_text",
    "CASE WHEN doc_id % 3 = 0 THEN text ELSE replace(text, 'the ', 'a ') END AS spec_text",
]


def doc_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply(table(spark, sf_dir, "documents"), DOC_PAIRS)


def _answer(variant: str) -> str:
    return (
        f"CASE {variant}"
        " WHEN 0 THEN concat('Here is the code:\n```python\ndef f():\n    return \"', words, '\"\n```\nDone.')"
        " WHEN 1 THEN concat('```\nx = \"', words, '\"\n```')"
        " WHEN 2 THEN concat('x = \"', words, '\"')"
        " WHEN 3 THEN concat('```python\nx = \"', words, '\"\n')"
        " ELSE concat('```python\ndef f(:\n    return \"', words, '\"\n```') END"
    )


ANSWERS = [
    "concat('code_', CAST(doc_id AS STRING)) AS prompt_id",
    "lang AS task",
    "doc_id % 5 AS base_variant",
    "(doc_id % 17) % 5 AS spec_variant",
    f"{_answer('doc_id % 5')} AS baseline_text",
    f"{_answer('(doc_id % 17) % 5')} AS spec_text",
]
WORDS_SPARK = ["doc_id", "lang", "regexp_replace(lower(text), '[^a-z]+', ' ') AS words"]
WORDS_SQL = ["doc_id", "lang", "regexp_replace(lower(text), '[^a-z]+', ' ', 'g') AS words"]


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code answers of known validity around each document's words."""
    return apply(table(spark, sf_dir, "documents"), WORDS_SPARK, ANSWERS)


ANSWERS_SQL = as_sql("documents", WORDS_SQL, ANSWERS)

CODE_ITEMS = [
    "item_id",
    "text AS prompt",
    "concat('return ', CAST(item_id AS STRING)) AS canonical_solution",
    "concat('item_', CAST(item_id AS STRING)) AS entry_point",
]
ARTICLES = ["doc_id", "text AS article", "substr(text, 1, 300) AS highlights"]


def code_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply(table(spark, sf_dir, "benchmark"), CODE_ITEMS)


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply(table(spark, sf_dir, "documents"), ARTICLES)


