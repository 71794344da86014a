"""A store with a folder for each site as a data source: filters on the site decide which folders are opened.

    opened(spark, path, "event_id long, site_id string").where("site_id = 'S1'")

The session needs PUSHED_FILTERS.  Open the store anew for each question: Spark
keeps the partitions that one question's filters left with the opened frame, and a
later question without such filters would be given the same.  The folder is one that pyarrow opens on the
driver and on the executors (local or mounted, HDFS, object stores).
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

SITE = "site_id"


class SitePartition(InputPartition):
    def __init__(self, site: str, folder: str):
        super().__init__(site)
        self.site, self.folder = site, folder


def _opened(path: str) -> tuple[pafs.FileSystem, str]:
    if local := re.fullmatch(r"(?:file:/*(?=/))?(/.*)", path):
        return pafs.LocalFileSystem(), local[1]
    return pafs.FileSystem.from_uri(path)


class SiteReader(DataSourceReader):
    """One partition for each site that the filters leave."""

    def __init__(self, path: str, schema: StructType):
        self.path, self.schema = path.rstrip("/"), schema
        self.asked: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if isinstance(f, IsNotNull) and f.attribute == (SITE,):  # a folder's site is never null
                continue
            if getattr(f, "attribute", None) == (SITE,) and isinstance(f, (EqualTo, EqualNullSafe, In)) and None not in (values := set(f.value) if isinstance(f, In) else {f.value}):
                self.asked = values if self.asked is None else self.asked & values
            else:
                yield f  # Spark's own

    def partitions(self) -> list[SitePartition]:
        system, folder = _opened(self.path)
        if self.asked is not None:
            named = [(s, f"{folder}/{SITE}={quote(s, safe=' ')}") for s in sorted(self.asked)]
            found = system.get_file_info([p for _, p in named])
            return [SitePartition(s, p) for (s, p), info in zip(named, found) if info.type == pafs.FileType.Directory]
        return [SitePartition(unquote(i.base_name.partition("=")[2]), i.path) for i in system.get_file_info(pafs.FileSelector(folder)) if i.base_name.startswith(f"{SITE}=")]

    def read(self, partition: SitePartition | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no site is left
            return
        system, _ = _opened(self.path)
        kinds = to_arrow_schema(self.schema)
        columns = [f.name for f in self.schema if f.name != SITE]
        stored = ds.dataset(partition.folder, format="parquet", filesystem=system, exclude_invalid_files=False)
        for batch in stored.to_batches(columns=columns):
            made = [pa.array([partition.site] * batch.num_rows, pa.string()) if f.name == SITE else batch.column(f.name).cast(f.type) for f in kinds]
            yield pa.RecordBatch.from_arrays(made, schema=kinds)


class SiteStore(DataSource):
    @classmethod
    def name(cls) -> str:
        return "site_store"

    def schema(self) -> str:
        return self.options["schema"]

    def reader(self, schema: StructType) -> SiteReader:
        return SiteReader(self.options["path"], schema)


def opened(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The store as a frame, for one question."""
    spark.dataSource.register(SiteStore)
    return spark.read.format(SiteStore.name()).option("schema", schema).load(path)
