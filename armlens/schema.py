"""Table schemas and the fixed values of the benchmark's data model."""

from pyspark.sql import types as T

# --- Fixed values -----------------------------------------------------------
# Accepted values of the request log, rates, limits and thresholds. Results
# only agree with existing logs and tables when these stay as they are.
SYSTEMS = ("baseline", "eagle3", "mlx_baseline", "mlx_spec")
GPU_TYPES = ("T4", "L4", "A100", "mac")
TASKS = ("chat", "code", "summarization")
CONCURRENCIES = (1, 4, 8, 16, 32)
TRIALS = (1, 2, 3)
QUALITY_TRIAL = 99
BASE_PATTERN = "baseline"
SPEC_PATTERN = "eagle3|mlx_spec"
USD_PER_HOUR = {"T4": 0.35, "L4": 0.70, "A100": 3.67, "mac": 0.00}
DRAFT_TOKENS = 5
REQUEST_TIMEOUT_S = 120
MIN_CHAT_CHARS = 20
MAX_CHAT_CHARS = 1500
MIN_ARTICLE_CHARS = 200
MAX_ARTICLE_CHARS = 2000
SUMMARY_INSTRUCTION = "Summarize the following article in 3-4 sentences:\n\n"
SAMPLE_SEED = 42
ROUGE_PASS = 0.70
ROUGE_WARN = 0.50
GAUGE_NAME = "spec_decode_draft_acceptance_rate"
ACCEPTED_NAME = "spec_decode_num_accepted_tokens_total"
DRAFTED_NAME = "spec_decode_num_draft_tokens_total"
# -----------------------------------------------------------------------------

CELL = ["system", "gpu_type", "task", "concurrency", "trial"]
SERIES_KEY = ["gpu_type", "task", "system", "concurrency"]
PAIR_CELL = ["gpu_type", "task", "concurrency"]

REQUEST = T.StructType(
    [
        T.StructField("request_id", T.StringType()),
        T.StructField("task", T.StringType()),
        T.StructField("concurrency", T.IntegerType()),
        T.StructField("system", T.StringType()),
        T.StructField("gpu_type", T.StringType()),
        T.StructField("trial", T.IntegerType()),
        T.StructField("ttft_ms", T.DoubleType()),
        T.StructField("tpot_ms", T.DoubleType()),
        T.StructField("total_latency_ms", T.DoubleType()),
        T.StructField("output_tokens", T.IntegerType()),
        T.StructField("tokens_per_sec", T.DoubleType()),
        T.StructField("gpu_cost_usd", T.DoubleType()),
        T.StructField("output_text", T.StringType()),
        T.StructField("acceptance_rate", T.DoubleType()),
        T.StructField("error", T.StringType()),
    ]
)

PROMPT = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("task", T.StringType()),
        T.StructField("prompt", T.StringType()),
        T.StructField("canonical_solution", T.StringType()),
        T.StructField("entry_point", T.StringType()),
        T.StructField("reference_summary", T.StringType()),
    ]
)

TURN = T.StructType(
    [T.StructField("from", T.StringType()), T.StructField("value", T.StringType())]
)

DIALOGUE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("conversations", T.ArrayType(TURN)),
    ]
)

CHUNK = T.StructType(
    [
        T.StructField(
            "choices",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField(
                            "delta",
                            T.StructType([T.StructField("content", T.StringType())]),
                        )
                    ]
                )
            ),
        ),
        T.StructField(
            "usage", T.StructType([T.StructField("completion_tokens", T.IntegerType())])
        ),
        T.StructField("_corrupt", T.StringType()),
    ]
)

CHUNK_LOG = T.StructType(
    [
        T.StructField("request_id", T.StringType()),
        T.StructField("system", T.StringType()),
        T.StructField("gpu_type", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("line", T.StringType()),
    ]
)

COUNTER_LOG = T.StructType(
    [
        T.StructField("server", T.StringType()),
        T.StructField("scrape_ts", T.TimestampType()),
        T.StructField("line_no", T.LongType()),
        T.StructField("line", T.StringType()),
    ]
)
