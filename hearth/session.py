"""A session with the settings that the operators expect."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Adaptive execution re-plans joins and splits skewed partitions; UTC keeps dates the same everywhere.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
#: What operators with state of their own, and sources that take filters, ask of a session.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
PUSHED_FILTERS = {"spark.sql.python.filterPushdown.enabled": "true"}


def session(name: str = "hearth", master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **STATE_STORE, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def own_session(spark: SparkSession, **settings: str) -> SparkSession:
    """A session with the same SQL settings but for these, so that the caller's stay as they are."""
    own = spark.newSession()
    for key, value in {**spark.conf.getAll, **settings}.items():
        if key.startswith("spark.sql.") and own.conf.isModifiable(key):
            own.conf.set(key, value)
    return own


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a temporary one only on a local master."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared:
        return shared.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    shared = tempfile.mkdtemp(prefix="hearth-")
    spark.sparkContext.setCheckpointDir(f"file://{shared}")
    return f"file://{shared}"


def removed(spark: SparkSession, *paths: str) -> None:
    """Deletes folders of intermediate tables that nothing reads any more."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def stored_bytes(spark: SparkSession, *paths: str) -> int:
    """The size of stored tables."""
    found = [spark._jvm.org.apache.hadoop.fs.Path(p) for p in paths]
    return sum(p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength() for p in found)


def stored(rows: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: computed once, and not lost with an executor."""
    path = f"{scratch_dir(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
