"""What the operators of this subpackage share: the scratch folder, table access, components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth.session import removed, scratch_dir
from hearth.sources.readers import spread


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder: its lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def apart(spark: SparkSession, **settings: str) -> SparkSession:
    """A session of its own with the same SQL settings but for these, so that the caller's stay as they are."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and own.conf.isModifiable(key):
            own.conf.set(key, value)
    for key, value in settings.items():
        own.conf.set(key, value)
    return own


def reopened(table: DataFrame, spark: SparkSession) -> DataFrame:
    """A written table as a frame of another session."""
    out = spark.read.schema(table.schema).parquet(table.scratch_path)
    out.scratch_path = table.scratch_path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes written tables that no later result reads."""
    for t in tables:
        removed(t.sparkSession, t.scratch_path)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A stored table; with columns, only these, and rows of a table with few splits dealt over the cores by the first."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df.select(*columns), columns[0]) if columns else df


def unused(name: str, *frames: DataFrame) -> str:
    """A column name like this one that none of the frames has."""
    taken = {c.lower() for f in frames for c in f.columns}
    return next(x for x in (name, *(f"{name}_{i}" for i in range(len(taken) + 1))) if x.lower() not in taken)


def hex_digest_base32(hex_digest: Column, digits: int = 40) -> Column:
    """Upper-case base32 of a hexadecimal digest of a whole number of five-digit groups (SHA-1 has eight)."""
    plain, coded = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    groups = [F.lpad(F.conv(F.substring(hex_digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(digits // 5)]
    return F.translate(F.upper(F.concat(*groups)), plain, coded)


def met(rows: DataFrame, sums: DataFrame, *keys: str, how: str = "inner") -> DataFrame:
    """Rows joined with what an aggregate gives for their keys, so that adaptive execution can split a key that many rows bear.

    An aggregate's rows lie where its keys put them, and a join on the same keys
    would take them from there, past the exchange that splitting needs.  A hash of
    the keys as one more key asks for an exchange of both sides.
    """
    mark = unused("met", rows, sums)
    hashed = F.xxhash64(*keys)
    return rows.withColumn(mark, hashed).join(merged(sums.withColumn(mark, hashed)), [*keys, mark], how).drop(mark)


def merged(side: DataFrame) -> DataFrame:
    """A side of a join that grows with the input: joined by a sort and a merge, as a broadcast would pass it whole through the driver."""
    return side.hint("merge")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) for every id on an edge; component is the least id reachable.

    edges has integer columns a and b.  Alternates large-star and small-star
    steps: every step is an aggregate of a minimum (combined before the shuffle)
    and an equality join, and each round is written to the shared folder.  A hub
    is a key of the minimum's aggregate only; the join that uses it is a plain
    shuffled join, which adaptive execution can split.  Only a count and a sum
    reach the driver.
    """
    now = written(edges.where("a != b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct(), "edges")
    before = None
    for _ in range(rounds):
        # large star: every larger neighbour of u points at the least of u and its neighbours
        both = now.selectExpr("lo u", "hi v").union(now.selectExpr("hi u", "lo v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = met(now.withColumnRenamed("lo", "u"), least, "u").select(F.col("m").alias("lo"), "hi").where("lo != hi").distinct()
        # small star: u and every smaller neighbour of u point at the least of them
        under = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = met(large, under, "hi").select(F.explode(F.array(F.struct(F.col("m").alias("lo"), F.col("hi")), F.struct(F.col("m").alias("lo"), F.col("lo").alias("hi")))).alias("e")).select("e.lo", "e.hi").where("lo != hi").distinct()
        last, now = now, written(small, "edges")
        dropped(last)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    pairs = now.groupBy("hi").agg(F.min("lo").alias("component")).select(F.col("hi").alias("id"), "component")
    return pairs.union(now.select(F.col("lo").alias("id"), F.col("lo").alias("component")).distinct())
