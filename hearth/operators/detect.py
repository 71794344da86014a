"""Detectors: each gives alerts with a common set of columns; anomalies of series also come in full."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearth.functions.numbers import clipped, keyed_uniform, laplace_count, z_score
from hearth.operators import numbering

ALERT = ["kind", "severity", "confidence", "group_id", "code", "summary", "count", "detector_ord"]
SEVERITY = {"action": 0, "watch": 1, "info": 2}


def severity_rank(c: Column) -> Column:
    out = F.lit(len(SEVERITY))
    for name, rank in SEVERITY.items():
        out = F.when(c == name, rank).otherwise(out)
    return out


def last_n_against_rest(series: DataFrame, region: str, period: str, value: str, n: int = 4, least: int = 8) -> DataFrame:
    """z of the mean of the last n rows of each region against all earlier rows (sample deviation).

    Null where there are fewer than `least` rows or the earlier ones do not vary.
    """
    ranked = series.withColumn("rn", F.row_number().over(Window.partitionBy(region).orderBy(F.desc(period))))
    last, rest = F.when(F.col("rn") <= n, F.col(value)), F.when(F.col("rn") > n, F.col(value))
    sums = ranked.groupBy(region).agg(F.count("*").alias("n"), F.avg(last).alias("last_mean"), F.avg(rest).alias("rest_mean"), F.stddev_samp(rest).alias("rest_sd"), F.sum(last).alias("last_total"))
    return sums.withColumn("z", F.when(F.col("n") >= least, z_score(F.col("last_mean"), F.col("rest_mean"), F.col("rest_sd"))))


def last_against_previous(series: DataFrame, keys: list[str], period: str, value: str, back: int = 11, least: int = 6) -> DataFrame:
    """z of the last row of each key against the up to `back` rows before it (sample deviation)."""
    w = Window.partitionBy(*keys).orderBy(period)
    before = w.rowsBetween(-back, -1)
    framed = series.select(*keys, period, F.col(value).alias("value"), F.avg(value).over(before).alias("mean"), F.stddev_samp(value).over(before).alias("sd"), F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(period))).alias("rn"), F.count("*").over(Window.partitionBy(*keys)).alias("n"))
    return framed.where("rn = 1").drop("rn").withColumn("z", F.when(F.col("n") >= least, z_score(F.col("value"), F.col("mean"), F.col("sd"))))


def graded(zs: DataFrame, fires: Column, base: float, slope: float) -> DataFrame:
    """fired, severity (action from z = 4) and confidence min(.99, base + slope z) beside z."""
    fired = F.coalesce(fires, F.lit(False))
    return zs.withColumn("fired", fired).withColumn("severity", F.when(F.col("fired"), F.when(F.col("z") >= 4, "action").otherwise("watch"))).withColumn("confidence", F.when(F.col("fired"), clipped(base + slope * F.col("z"), high=0.99)))


def vector_anomaly(series: DataFrame, region: str, period: str, value: str, threshold: float = 2.5) -> DataFrame:
    return graded(last_n_against_rest(series, region, period, value), F.col("z") >= threshold, 0.6, 0.05)


def sentinel_cases(series: DataFrame, keys: list[str], period: str, value: str, threshold: float = 2.0, least_count: int = 3) -> DataFrame:
    return graded(last_against_previous(series, keys, period, value), (F.col("z") >= threshold) & (F.col("value") >= least_count), 0.55, 0.08)


def with_noised_count(alerts: DataFrame, count: str, keys: list[str], epsilon: float = 1.0, seed: int = 7) -> DataFrame:
    return alerts.withColumn("noised_count", laplace_count(F.col(count), keyed_uniform(*[F.col(k) for k in keys], seed=seed), epsilon))


def prophylactic(conditions: DataFrame, members: DataFrame, codes: list[str], kinds: tuple[str, str]) -> DataFrame:
    """Groups with a code of the list that not both kinds have, while some member has not."""
    cases = conditions.where(F.col("code").isin(codes)).join(members, "ref")
    seen = cases.groupBy("group_id", "code").agg(F.count_distinct("ref").alias("n_diagnosed"), F.count_if(F.col("kind") == kinds[0]).alias("a"), F.count_if(F.col("kind") == kinds[1]).alias("b")).where("NOT (a > 0 AND b > 0)")
    sizes = members.groupBy("group_id").agg(F.count_distinct("ref").alias("n_members"))
    return seen.join(sizes, "group_id").select("group_id", "code", "n_diagnosed", (F.col("n_members") - F.col("n_diagnosed")).alias("n_at_risk")).where("n_at_risk > 0")


def region_rules(conditions: DataFrame, members: DataFrame, groups: DataFrame, regions: DataFrame, rules: DataFrame) -> DataFrame:
    """Conditions whose code has a rule that allows their region's level: four hops, all equality joins."""
    return conditions.join(members.select("ref", "group_id"), "ref").join(groups.select("group_id", "region_id"), "group_id").join(regions.select("region_id", "level"), "region_id").join(rules, ["code", "level"])


def as_alerts(rows: DataFrame, kind: str, ordinal: int, severity: Column, confidence: Column, summary: Column, count: Column, group: str = "group_id", code: Column | None = None) -> DataFrame:
    """Rows in the common columns of alerts."""
    return rows.select(F.lit(kind).alias("kind"), severity.alias("severity"), confidence.cast("double").alias("confidence"), F.col(group).cast("string").alias("group_id"), (code if code is not None else F.lit(None)).cast("string").alias("code"), summary.alias("summary"), count.cast("long").alias("count"), F.lit(ordinal).alias("detector_ord"))


def alert_id(kind: Column, *key: Column) -> Column:
    """An id from the alert's natural key, the same on every run and in every partition."""
    return F.concat(F.lit("ALERT-"), F.substring(kind, 1, 4), F.lit("-"), F.substring(F.sha2(F.concat_ws("|", kind, *[F.coalesce(k, F.lit("")) for k in key]), 256), 1, 12))


def ranked(*detectors: DataFrame) -> DataFrame:
    """All alerts with their ids, by severity, then confidence, detector and key (a distributed range sort)."""
    every = reduce(DataFrame.unionByName, detectors).withColumn("severity_rank", severity_rank(F.col("severity")))
    named = every.withColumn("alert_id", alert_id(F.col("kind"), F.col("group_id"), F.col("code")))
    return named.orderBy("severity_rank", F.desc("confidence"), "detector_ord", "group_id", "code")


def numbered(alerts: DataFrame, natural: str | None = None) -> DataFrame:
    """Alerts with a dense number in the order of `ranked` as seq, and an alert_id of the kind and that number, of four digits at least.

    natural: the column that keeps the id from the alert's key.
    """
    rest = [c for c in ("summary", "count") if c in alerts.columns]
    order = [F.asc("severity_rank"), F.desc_nulls_last("confidence"), F.asc("detector_ord"), F.asc_nulls_last("group_id"), F.asc_nulls_last("code"), *[F.asc_nulls_last(c) for c in rest]]
    found = numbering.numbered(alerts, order)
    digits = F.col("seq").cast("string")
    named = F.concat(F.lit("ALERT-"), F.substring("kind", 1, 4), F.lit("-"), F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits))
    kept = found.withColumn(natural, F.col("alert_id")) if natural else found
    return kept.withColumn("alert_id", named)


def worst_per_group(alerts: DataFrame) -> DataFrame:
    """The most severe severity of each group and its number of alerts."""
    return alerts.groupBy("group_id").agg(F.min_by("severity", severity_rank(F.col("severity"))).alias("severity"), F.count("*").alias("n_alerts"))
