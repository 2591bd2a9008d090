"""Chunk and counter logs as tab-separated text, the raw line last."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: How a missing field is written.
MISSING = "\\N"


def _fields(lines: DataFrame, schema: T.StructType) -> DataFrame:
    parts = F.split("value", "\t", len(schema.fields))

    def field(i: int, kind: T.DataType):
        text = F.nullif(F.get(parts, F.lit(i)), F.lit(MISSING))
        return text if kind == T.StringType() else text.try_cast(kind)

    return lines.select(*[field(i, f.dataType).alias(f.name) for i, f in enumerate(schema.fields)])


def read_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A chunk log (``schema.CHUNK_LOG``) or counter log (``schema.COUNTER_LOG``)."""
    return _fields(spark.read.text(path, lineSep="\n"), schema)


def stream_log(
    spark: SparkSession, path: str, schema: T.StructType, max_files: int | None = None
) -> DataFrame:
    reader = spark.readStream
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return _fields(reader.text(path, lineSep="\n"), schema)


def log_lines(df: DataFrame, schema: T.StructType) -> DataFrame:
    cells = [F.coalesce(F.col(f.name).cast("string"), F.lit(MISSING)) for f in schema.fields]
    return df.select(F.concat_ws("\t", *cells).alias("value"))


def write_log(df: DataFrame, path: str, schema: T.StructType) -> None:
    log_lines(df, schema).write.mode("append").text(path, lineSep="\n")
