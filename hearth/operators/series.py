"""Time series of stations and regions: trends, trailing means, alert bands."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearth.functions.numbers import banded

#: The public air-quality index bands.
AQI_BOUNDS = [50, 100, 150, 200, 300]
AQI_LABELS = ["Good", "Moderate", "Unhealthy for Sensitive Groups", "Unhealthy", "Very Unhealthy", "Hazardous"]


def trailing_mean(rows: DataFrame, key: str, period: str, value: str, n: int = 7, digits: int = 1) -> DataFrame:
    w = Window.partitionBy(key).orderBy(period).rowsBetween(-(n - 1), 0)
    return rows.withColumn("trailing_mean", F.round(F.avg(value).over(w), digits))


def trend(rows: DataFrame, key: str, period: str, value: str, last: int = 7, before: int = 14) -> DataFrame:
    """Means of the last rows and of those before them, and rising, falling or stable (beyond a tenth)."""
    rn = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(period)))
    sums = rows.withColumn("rn", rn).where(F.col("rn") <= last + before).groupBy(key).agg(F.avg(F.when(F.col("rn") <= last, F.col(value))).alias("recent"), F.avg(F.when(F.col("rn") > last, F.col(value))).alias("prior"))
    return sums.withColumn("trend", F.when(F.col("recent") > 1.1 * F.col("prior"), "rising").when(F.col("recent") < 0.9 * F.col("prior"), "falling").otherwise("stable"))


def latest_by_key(rows: DataFrame, key: str, period: str, value: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(value, period).alias(value), F.max(period).alias(period))


def air_quality(rows: DataFrame, value: str) -> DataFrame:
    """Stations by index, highest first (none counts as zero), with their bands."""
    return rows.withColumn("category", banded(F.col(value), AQI_BOUNDS, AQI_LABELS)).orderBy(F.desc(F.coalesce(F.col(value), F.lit(0))))


def last_sum(rows: DataFrame, keys: list[str], period: str, value: str, n: int = 8) -> DataFrame:
    """The sum over the last n rows of each key; the limit also holds before the shuffle."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(period)))
    return rows.withColumn("_rn", rn).where(F.col("_rn") <= n).groupBy(*keys).agg(F.sum(value).alias("total"), F.count("*").alias("n"))


def region_series(rows: DataFrame, region: str, name: str, period: str, least: int = 2) -> DataFrame:
    """One region's series in order; no rows if it has fewer points than a line needs."""
    own = rows.where(F.col(region) == name)
    return own.withColumn("_n", F.count("*").over(Window.partitionBy(region))).where(F.col("_n") >= least).drop("_n").orderBy(period)
