"""Readers: JSON documents, envelopes, folders of site files, Parquet, reference tables, logs."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_json(spark: SparkSession, path: str, schema: StructType | str, strict: bool = True) -> DataFrame:
    """Whole-file JSON documents; strict: a malformed one fails the query, else it is a row of nulls."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)


def read_optional_json(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The same, with no rows if there is no such file."""
    try:
        return read_json(spark, path, schema)
    except (AnalysisException, Py4JJavaError) as e:
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
            return spark.createDataFrame([], schema)
        raise


def unwrap(envelope: DataFrame, rows: str) -> DataFrame:
    """The rows of an envelope {_metadata, rows: [...]}."""
    return envelope.select(F.inline(F.col(rows)))


def read_site_folder(spark: SparkSession, folder: str, schema: StructType | str, pattern: str = "*.json") -> DataFrame:
    """One document for each site file, with its file name as site_file."""
    return spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", pattern).json(folder).withColumn("site_file", F.col("_metadata.file_name"))


def read_parquet(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def spread(table: DataFrame, *keys: str) -> DataFrame:
    """A stored table of fewer splits than cores dealt over the cores by its keys; a larger one as it is.

    For costly work on each row of small files: a file of one row group is one split.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(cores, F.xxhash64(*keys)) if table.rdd.getNumPartitions() < cores else table


def read_log(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A line-wise JSON log; corrupt lines are left out."""
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    kept = spark.read.schema(kind.add("_corrupt", "string")).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return kept.where(F.col("_corrupt").isNull()).drop("_corrupt")


def first_by_key(reference: DataFrame, key: str, order: str) -> DataFrame:
    """A dimension with one row for each key, the first in the given order."""
    others = [c for c in reference.columns if c != key]
    return reference.groupBy(key).agg(F.min_by(F.struct(*others), order).alias("r")).select(key, "r.*")


def register(spark: SparkSession, tables: dict[str, DataFrame]) -> None:
    """A catalog of temporary views; a missing table is an error at once."""
    missing = [name for name, df in tables.items() if df is None]
    if missing:
        raise ValueError(f"tables not loaded: {', '.join(missing)}")
    for name, df in tables.items():
        df.createOrReplaceTempView(name)


def records_from_text(lines: DataFrame, column: str, schema: str) -> DataFrame:
    """The rows of the first JSON array found inside a text; a text without one has no rows."""
    array = F.from_json(F.regexp_extract(F.col(column), r"(?s)(\[.*\])", 1), f"array<struct<{schema}>>")
    return lines.select("*", F.explode(F.coalesce(array, F.array().cast(f"array<struct<{schema}>>"))).alias("record"))
