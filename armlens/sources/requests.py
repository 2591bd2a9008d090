"""Request logs: JSON lines as written by a load test, and partitioned cells."""

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from armlens import schema as S
from armlens.functions.numeric import not_nan
from armlens.operators.coverage import cell_file_name
from armlens.operators.views import without_trials

BAD = "_malformed"
LOGGED = T.StructType([*S.REQUEST.fields, T.StructField(BAD, T.StringType())])
#: JSON lines repeat their field names in every row, so files hold them compressed. A reader takes a file whole.
PACKED = {"compression": "gzip"}
NUMBERS = [f.name for f in S.REQUEST.fields if f.dataType == T.DoubleType()]


def _logged(reader, path: str, mode: str) -> DataFrame:
    return (
        reader.schema(LOGGED)
        .option("mode", mode)
        .option("columnNameOfCorruptRecord", BAD)
        .json(path)
    )


def _clean(rows: DataFrame) -> DataFrame:
    """Well-formed rows; a NaN token becomes a missing value.

    Spark refuses to read the malformed-line column alone, which a plain count
    would do, so the test names a second column.
    """
    bad_line = F.concat(BAD, F.coalesce("system", F.lit("")))
    return (
        rows.filter(bad_line.isNull())
        .drop(BAD)
        .withColumns({c: not_nan(c) for c in NUMBERS})
    )


def read_requests(
    spark: SparkSession,
    path: str,
    exclude_trials: Iterable[int] = (S.QUALITY_TRIAL,),
    mode: str = "PERMISSIVE",
) -> DataFrame:
    """All result files below ``path``. Blank lines are skipped; a malformed line
    is left out (PERMISSIVE, DROPMALFORMED) or ends the job (FAILFAST).

    Excluded trials are pruned by file name before a file is opened, and again by
    column for files with another name.
    """
    rows = _logged(spark.read, path, mode)
    exclude = list(exclude_trials)
    if exclude:
        ends = "|".join(str(t) for t in exclude)
        rows = rows.filter(~F.col("_metadata.file_name").rlike(rf"_t({ends})\.jsonl$"))
    return without_trials(_clean(rows), exclude)


def sort_out(spark: SparkSession, path: str, target: str) -> None:
    """Read result files once and write well-formed rows and malformed lines apart, below ``target``;
    ``read_sorted`` and ``quarantined`` read them. Blank lines are neither."""
    rows = _logged(spark.read, path, "PERMISSIVE").withColumn("file_name", _file_name())
    rows.withColumn("kind", F.when(F.col(BAD).isNull(), "row").otherwise("line")).write.partitionBy("kind").parquet(target)


def _sorted(spark: SparkSession, target: str, kind: str) -> DataFrame:
    stored = T.StructType([*LOGGED.fields, T.StructField("file_name", T.StringType()), T.StructField("kind", T.StringType())])
    return spark.read.schema(stored).parquet(target).filter(F.col("kind") == kind)


def read_sorted(
    spark: SparkSession, target: str, exclude_trials: Iterable[int] = (S.QUALITY_TRIAL,)
) -> DataFrame:
    """The rows that ``sort_out`` found well-formed, as ``read_requests`` gives them."""
    rows = _sorted(spark, target, "row").select(*[f.name for f in S.REQUEST.fields])
    return without_trials(rows.withColumns({c: not_nan(c) for c in NUMBERS}), list(exclude_trials))


def quarantined(spark: SparkSession, target: str) -> DataFrame:
    """The malformed lines that ``sort_out`` found, with the file they stand in."""
    return _sorted(spark, target, "line").select("file_name", F.col(BAD).alias("line"))


def _file_name() -> Column:
    """The name of a result file: the file's own, or that of the folder that holds its parts."""
    of_folder = F.regexp_extract("_metadata.file_path", r"/file=([^/]+)/[^/]+$", 1)
    return F.when(of_folder != "", of_folder).otherwise(F.col("_metadata.file_name"))


def with_file_name(spark: SparkSession, path: str) -> DataFrame:
    """Each row's cell next to the name of the file it stands in."""
    return _logged(spark.read, path, "PERMISSIVE").select(*S.CELL, _file_name().alias("file_name"))


def write_result_files(df: DataFrame, path: str, name: Column | None = None) -> None:
    """JSON lines, one result file per name, that of a row's cell by default. A file is a folder of parts,
    so the rebalance can split a large one over several tasks."""
    named = df.select(*[f.name for f in S.REQUEST.fields if f.name in df.columns], (cell_file_name() if name is None else name).alias("file"))
    named.hint("rebalance", "file").write.partitionBy("file").json(path, **PACKED)


def write_cells(df: DataFrame, path: str) -> None:
    """Write cells as partitioned Parquet; a cell present in ``df`` replaces the
    stored one and other cells stay.

    Rows are gathered by cell, so small cells get one file each; the rebalance
    splits a large cell over as many tasks as its size asks for.
    """
    (
        df.hint("rebalance", *S.CELL)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*S.CELL)
        .parquet(path)
    )


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """Cells written by ``write_cells``; cell filters prune folders."""
    return spark.read.schema(S.REQUEST).parquet(path)


def write_request_lines(df: DataFrame, path: str) -> None:
    """JSON lines in the shape of the log, compressed."""
    df.select(*[f.name for f in S.REQUEST.fields if f.name in df.columns]).write.mode(
        "overwrite"
    ).json(path, **PACKED)


def write_raw_lines(lines: DataFrame, path: str) -> None:
    """Lines of any content as they are, one file per task, compressed."""
    lines.write.text(path, **PACKED)


def stream_requests(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """New result files as they arrive."""
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return _clean(_logged(reader, path, "PERMISSIVE"))
