"""Writers: JSON with metadata, Parquet, per-site partitions, bundles, graph export, capped logs."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_json(rows: DataFrame, path: str, summary: DataFrame | None = None) -> None:
    """Rows as line-wise JSON under path/rows and an optional summary under path/summary."""
    rows.write.mode("overwrite").json(f"{path}/rows")
    if summary is not None:
        summary.write.mode("overwrite").json(f"{path}/summary")


def write_parquet(rows: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = rows.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_sites(rows: DataFrame, path: str, site: str = "site_id") -> None:
    """A store partitioned by site, so that a read of one site prunes the others; each site is dealt over the tasks that hold it."""
    rows.where(F.col(site).isNotNull()).write.mode("overwrite").partitionBy(site).parquet(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def bundle(tables: dict[str, DataFrame]) -> DataFrame:
    """All tables as (table, row) with each row as JSON."""
    parts = [df.select(F.lit(name).alias("table"), F.to_json(F.struct(*df.columns)).alias("row")) for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def as_json(*columns: str) -> Column:
    return F.to_json(F.struct(*columns))


def latest(log: DataFrame, time: str, tie: str, n: int) -> DataFrame:
    """The newest n rows of an append-only log, newest first (a bounded top-n, not a global sort)."""
    return log.orderBy(F.desc(time), F.desc(tie)).limit(n)


def append(log: DataFrame, path: str) -> None:
    log.write.mode("append").parquet(path)
