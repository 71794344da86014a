"""Synthetic rows from keyed hashes: the same for any partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearth.functions.numbers import keyed_uniform


def weighted_pick(rows: DataFrame, key: str, choices: DataFrame, value: str, weight: str, seed: int = 42) -> DataFrame:
    """Each row with one of the choices, picked by weight (choices are few: their running shares are one array)."""
    shares = choices.agg(F.sort_array(F.collect_list(F.struct(value, F.col(weight).cast("double").alias("w")))).alias("c"))
    total = F.aggregate("c", F.lit(0.0), lambda a, x: a + x["w"])
    u = keyed_uniform(F.col(key), seed=seed)
    joined = rows.crossJoin(F.broadcast(shares))  # one row
    pick = F.aggregate("c", F.struct((u * total).alias("left"), F.lit(None).cast(dict(choices.dtypes)[value]).alias("got")), lambda a, x: F.struct((a["left"] - x["w"]).alias("left"), F.when((a["left"] >= 0) & (a["left"] < x["w"]) & a["got"].isNull(), x[value]).otherwise(a["got"]).alias("got")))
    return joined.withColumn(value, pick["got"]).drop("c")


def groups(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    return dealt_groups(spark.range(n).withColumnRenamed("id", "group_id"), seed)


def dealt_groups(base: DataFrame, seed: int = 42) -> DataFrame:
    """Groups (group_id) with one to four members of the first kind and none to three of the second."""
    u, v = keyed_uniform(F.col("group_id"), F.lit("a"), seed=seed), keyed_uniform(F.col("group_id"), F.lit("b"), seed=seed)
    return base.withColumn("n_first", (1 + F.floor(u * 4)).cast("int")).withColumn("n_second", F.floor(v * 4).cast("int"))


def group_members(base: DataFrame) -> DataFrame:
    first = base.select("group_id", F.explode(F.sequence(F.lit(1), "n_first")).alias("i"), F.lit("person").alias("kind"))
    second = base.where("n_second > 0").select("group_id", F.explode(F.sequence(F.lit(1), "n_second")).alias("i"), F.lit("animal").alias("kind"))
    return first.unionByName(second).select("group_id", F.concat_ws("/", "kind", "group_id", "i").alias("ref"), "kind")


def series(spark: SparkSession, regions: int, periods: int, base: float = 10.0, spike: tuple[int, int, float] | None = None, seed: int = 42) -> DataFrame:
    return series_of(spark.range(regions).withColumnRenamed("id", "region"), periods, base, spike, seed)


def series_of(regions: DataFrame, periods: int, base: float = 10.0, spike: tuple[int, int, float] | None = None, seed: int = 42) -> DataFrame:
    """(region, period, value): noise about a base, with the last periods of one region multiplied."""
    rows = regions.withColumn("period", F.explode(F.sequence(F.lit(1), F.lit(periods))))
    value = F.round(base * (0.8 + 0.4 * keyed_uniform(F.col("region"), F.col("period"), seed=seed)), 3)
    if spike:
        region, last, times = spike
        value = F.when((F.col("region") == region) & (F.col("period") > periods - last), value * times).otherwise(value)
    return rows.withColumn("value", value)


def assigned_cases(members: DataFrame, share: Column, codes: list[str], most: int = 2, seed: int = 42) -> DataFrame:
    """Members dealt up to `most` codes each, in a sample whose share may depend on the row."""
    every = members.withColumn("code", F.explode(F.array(*map(F.lit, codes))))
    u = keyed_uniform(F.col("ref"), F.col("code"), seed=seed)
    turn = F.row_number().over(Window.partitionBy("ref").orderBy("_u", "code"))
    return every.withColumn("_u", u).where(F.col("_u") < share).withColumn("_t", turn).where(F.col("_t") <= most).drop("_u", "_t")
