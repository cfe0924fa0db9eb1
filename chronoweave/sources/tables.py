"""Tables and files: named tables, views, CSV in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from chronoweave.operators.ordered import add_row_id


def read_table(spark: SparkSession, name: str, order: list[str] | None = None) -> DataFrame:
    """A catalog table or view, sorted if `order` is given; it stays on the cluster."""
    df = spark.table(name)
    return df.orderBy(*[F.col(c).asc_nulls_first() for c in order]) if order else df


def read_parquet(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(path)


def as_view(df: DataFrame, name: str) -> DataFrame:
    df.createOrReplaceTempView(name)
    return df


def save_table(df: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = "overwrite") -> DataFrame:
    """Write as parquet and go on from the stored copy."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_csv(spark: SparkSession, path: str | list[str], schema: StructType | None = None) -> DataFrame:
    """CSV with a header; types are inferred only when no schema is given."""
    reader = spark.read.option("header", True)
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    return reader.schema(schema).option("enforceSchema", False).csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header; times keep their microseconds."""
    times = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    df.write.mode(mode).options(header=True, **times).csv(path)


def write_rows_csv(df: DataFrame, path: str, order: list[str], name: str = "rn") -> None:
    """CSV with a gap-free row number in `order` as its first column."""
    numbered = add_row_id(df.drop(name), order, name)
    write_csv(numbered.select(name, *[c for c in numbered.columns if c != name]), path)
