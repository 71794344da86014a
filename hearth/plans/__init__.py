"""The library's operators bound to the driver's tables, with the same queries in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth.session import own_session, stored_bytes

Query = Callable[[SparkSession, str], DataFrame]


def plain(query: Query) -> Query:
    """The query with its dates as ISO text, which every client reads alike."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = query(spark, sf_dir)
        dates = [name for name, kind in df.dtypes if kind == "date"]
        return df.withColumns({c: F.col(c).cast("string") for c in dates}) if dates else df

    run.__name__, run.__doc__ = query.__name__, query.__doc__
    return run


#: Stored bytes for each shuffle partition, and the stored or shuffled bytes that one task may read.
STORED, TASK = 1 << 20, "8m"
#: Rows that a Python worker holds at a time.
ROWS = "1024"


def small_tasks(*tables: str) -> Callable[[Query], Query]:
    """The query in a session of its own, whose tasks read 8 MB at most; its shuffles have a partition for each MB of these tables.

    A task's sorts and sums then take as much memory at any size of the input.
    """

    def wrap(query: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), stored_bytes(spark, *(f"{sf_dir}/{t}.parquet" for t in tables)) // STORED)
            own = own_session(spark, **{"spark.sql.files.maxPartitionBytes": TASK, "spark.sql.adaptive.advisoryPartitionSizeInBytes": TASK, "spark.sql.adaptive.coalescePartitions.initialPartitionNum": str(parts)})
            return query(own, sf_dir)

        run.__name__, run.__doc__ = query.__name__, query.__doc__
        return run

    return wrap


def few_rows(query: Query) -> Query:
    """The query in a session of its own, whose Python workers are given ROWS rows at a time."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(own_session(spark, **{"spark.sql.execution.arrow.maxRecordsPerBatch": ROWS}), sf_dir)

    run.__name__, run.__doc__ = query.__name__, query.__doc__
    return run


def dated(sql: str, *columns: str) -> str:
    """The SQL with the same columns as ISO text."""
    return f"SELECT * REPLACE ({', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in columns)}) FROM ({sql})"
