"""The experiment grid: expected cells, what is missing, what breaks the rules."""

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from armlens import schema as S


def product(spark: SparkSession, **dims: Sequence) -> DataFrame:
    """All combinations of short literal lists, by exploding one row."""
    out = spark.range(1).select()
    for name, values in dims.items():
        out = out.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    return out


def experiment_grid(
    spark: SparkSession,
    gpu_types: Sequence[str] = ("A100", "L4", "T4", "mac"),
    tasks: Sequence[str] = S.TASKS,
    concurrencies: Sequence[int] = S.CONCURRENCIES,
    trials: Sequence[int] = S.TRIALS,
) -> DataFrame:
    """Every cell of a sweep; a mac runs the mlx systems, other hardware the rest."""
    grid = product(
        spark,
        gpu_type=gpu_types,
        system=S.SYSTEMS,
        task=tasks,
        concurrency=concurrencies,
        trial=trials,
    )
    on_mac = F.col("gpu_type") == "mac"
    return grid.filter(on_mac == F.col("system").startswith("mlx")).withColumn(
        "expected_requests", F.col("concurrency").cast("bigint")
    )


def comparison_grid(spark: SparkSession, gpu_types: Sequence[str]) -> DataFrame:
    return product(spark, gpu_type=gpu_types, task=S.TASKS, concurrency=S.CONCURRENCIES)


def observed_cells(df: DataFrame) -> DataFrame:
    return df.groupBy(*S.CELL).agg(F.count(F.lit(1)).alias("observed_requests"))


def coverage(grid: DataFrame, df: DataFrame) -> DataFrame:
    """Expected against observed requests per cell with a status."""
    seen = F.coalesce(F.col("observed_requests"), F.lit(0).cast("bigint"))
    return (
        grid.join(observed_cells(df), S.CELL, "left")
        .withColumn("observed_requests", seen)
        .withColumn(
            "status",
            F.when(F.col("observed_requests") == 0, "missing")
            .when(F.col("observed_requests") < F.col("expected_requests"), "short")
            .otherwise("done"),
        )
    )


def progress(covered: DataFrame) -> DataFrame:
    """Done and total cells per system and hardware."""
    done = F.count_if(F.col("status") == "done")
    return covered.groupBy("gpu_type", "system").agg(
        done.alias("done_cells"),
        F.count(F.lit(1)).alias("total_cells"),
        F.count_if(F.col("status") == "missing").alias("missing_cells"),
        (done / F.count(F.lit(1))).alias("share_done"),
    )


def missing_cells(grid: DataFrame, df: DataFrame) -> DataFrame:
    return grid.select(*S.CELL).join(observed_cells(df), S.CELL, "left_anti")


def unexpected_cells(grid: DataFrame, df: DataFrame) -> DataFrame:
    """Observed cells outside the grid."""
    seen = observed_cells(df).select(*S.CELL)
    return seen.exceptAll(grid.select(*S.CELL))


def missing_inputs(prompts: DataFrame, tasks: Sequence[str] = S.TASKS) -> DataFrame:
    """Tasks without a single prompt."""
    wanted = product(prompts.sparkSession, task=tasks)
    return wanted.join(prompts.select("task").distinct(), "task", "left_anti")


def domain_violations(df: DataFrame, rules: Mapping[str, Sequence] | None = None) -> DataFrame:
    """Values outside their accepted lists with the number of rows that hold them."""
    rules = rules or {
        "system": S.SYSTEMS,
        "gpu_type": S.GPU_TYPES,
        "task": S.TASKS,
        "concurrency": S.CONCURRENCIES,
    }
    broken = F.array(
        *[
            F.when(
                F.col(c).isNull() | ~F.col(c).isin(list(values)),
                F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")),
            )
            for c, values in rules.items()
        ]
    )
    return (
        df.select(F.explode(F.filter(broken, lambda b: b.isNotNull())).alias("b"))
        .groupBy("b.column", "b.value")
        .agg(F.count(F.lit(1)).alias("rows"))
    )


CELL_FILE = r"^(.+)_([^_]+)_([^_]+)_c(\d+)_t(\d+)\.jsonl$"


def cell_of_name(name) -> dict:
    """The cell key encoded in a result file name."""
    parts = [F.regexp_extract(name, CELL_FILE, i + 1) for i in range(5)]
    return {
        "system": parts[0],
        "gpu_type": parts[1],
        "task": parts[2],
        "concurrency": parts[3].try_cast("int"),
        "trial": parts[4].try_cast("int"),
    }


def cell_file_name() -> Column:
    """The file name of a row's cell."""
    level = F.col("concurrency").cast("string")
    return F.concat(
        F.concat_ws("_", "system", "gpu_type", "task"),
        F.lit("_c"),
        F.lpad(level, F.greatest(F.length(level), F.lit(2)), F.lit("0")),
        F.lit("_t"),
        F.col("trial").cast("string"),
        F.lit(".jsonl"),
    )


def cell_name_mismatches(df: DataFrame, name: str = "file_name") -> DataFrame:
    """Files whose name disagrees with their rows."""
    key = cell_of_name(F.col(name))
    agree = F.lit(True)
    for c in S.CELL:
        agree = agree & F.col(c).eqNullSafe(key[c])
    # Most names are the expected ones; only others are taken apart.
    suspect = ~F.col(name).eqNullSafe(cell_file_name())
    return df.filter(suspect & ~agree).groupBy(name).agg(F.count(F.lit(1)).alias("rows"))
