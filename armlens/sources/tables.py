"""Report tables as CSV."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def write_table(df: DataFrame, path: str) -> None:
    """CSV files with a header, one per partition; a small result is one file, since the
    adaptive optimiser merges its partitions. A missing value is an empty cell."""
    df.write.mode("overwrite").option("header", True).option(
        "emptyValue", ""
    ).option("nullValue", "").csv(path)


def read_table(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)
