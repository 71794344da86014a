"""Evaluation metrics from scores and labels, exact under ties and by stratum.

Rows have a score p and a label y (0 or 1).  Scores are summed by distinct value
first, so that rank metrics need one row for each distinct score of a stratum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearth.functions.numbers import safe_ratio

#: Parts of equal width that scores between 0 and 1 are cut into.
BUCKETS = 4096


def _by_score(rows: DataFrame, strata: list[str]) -> DataFrame:
    return rows.groupBy(*strata, "p").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))


def _before(by_score: DataFrame, strata: list[str], descending: bool) -> DataFrame:
    """pos_before and neg_before: the sums over the scores that come before each one.

    Scores are cut into BUCKETS parts of equal width: sums run inside a part, and
    over the parts' totals, so that no task has to order a whole stratum.
    """
    order = F.desc if descending else F.asc
    rows = by_score.withColumn("_b", F.floor(F.col("p") * BUCKETS))
    inside = Window.partitionBy(*strata, "_b").orderBy(order("p")).rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy(*strata, "_b").agg(F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg"))
    earlier = Window.partitionBy(*strata).orderBy(order("_b")).rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(*[F.col(s).alias(f"_s{i}") for i, s in enumerate(strata)], F.col("_b").alias("_ob"), F.coalesce(F.sum("_pos").over(earlier), F.lit(0)).alias("_op"), F.coalesce(F.sum("_neg").over(earlier), F.lit(0)).alias("_on"))
    on = F.col("_b") == F.col("_ob")
    for i, s in enumerate(strata):
        on = on & F.col(s).eqNullSafe(F.col(f"_s{i}"))
    run = rows.withColumn("_ip", F.coalesce(F.sum("pos").over(inside), F.lit(0))).withColumn("_in", F.coalesce(F.sum("neg").over(inside), F.lit(0)))
    return run.join(offsets, on).select(*strata, "p", "pos", "neg", (F.col("_ip") + F.col("_op")).alias("pos_before"), (F.col("_in") + F.col("_on")).alias("neg_before"))


def auc(rows: DataFrame, strata: list[str]) -> DataFrame:
    """Area under the ROC curve, ties counting half; null for a stratum of one class."""
    won = _before(_by_score(rows, strata), strata, False).withColumn("won", F.col("pos") * (F.col("neg_before") + F.col("neg") / 2))
    return won.groupBy(*strata).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), (F.sum("won") / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("auc"))


def curve(rows: DataFrame, strata: list[str]) -> DataFrame:
    """True and false positives at each distinct score, from the highest: the points of the ROC and PR curves."""
    points = _before(_by_score(rows, strata), strata, True).withColumn("tp", F.col("pos_before") + F.col("pos")).withColumn("fp", F.col("neg_before") + F.col("neg"))
    totals = rows.groupBy(*[F.col(s).alias(f"_s{i}") for i, s in enumerate(strata)]).agg(F.count_if(F.col("y") == 1).alias("_p"), F.count_if(F.col("y") == 0).alias("_n"))
    on = F.lit(True)
    for i, s in enumerate(strata):
        on = on & F.col(s).eqNullSafe(F.col(f"_s{i}"))
    points = points.join(totals, on)
    return points.select(*strata, "p", "pos", "tp", "fp", (F.col("tp") / F.nullif("_p", F.lit(0))).alias("tpr"), (F.col("fp") / F.nullif("_n", F.lit(0))).alias("fpr"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"))


def average_precision(rows: DataFrame, strata: list[str]) -> DataFrame:
    """Step-wise average precision; null without positives."""
    return curve(rows, strata).groupBy(*strata).agg((F.sum(F.col("pos") * F.col("precision")) / F.nullif(F.sum("pos"), F.lit(0))).alias("average_precision"))


def point_metrics(rows: DataFrame, strata: list[str], threshold: float = 0.5) -> DataFrame:
    """Counts, Brier score, and precision, recall and F1 at the threshold."""
    hit, pos = F.col("p") >= threshold, F.col("y") == 1
    sums = rows.groupBy(*strata).agg(F.count("*").alias("n"), F.count_if(pos).alias("n_pos"), F.avg((F.col("p") - F.col("y")) ** 2).alias("brier"), F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"), F.count_if(~hit & pos).alias("fn"), F.count_if(~hit & ~pos).alias("tn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return sums.withColumn("precision", safe_ratio(tp, tp + fp)).withColumn("recall", safe_ratio(tp, tp + fn)).withColumn("f1", safe_ratio(2 * tp, 2 * tp + fp + fn))


def confusion(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    return rows.groupBy("y", (F.col("p") >= threshold).cast("int").alias("predicted")).agg(F.count("*").alias("n"))


def calibration(rows: DataFrame, bins: int = 10) -> DataFrame:
    """Mean score and share of positives in bins of equal width; a score of 1 belongs to the last bin."""
    b = F.least(F.lit(bins - 1), F.floor(F.col("p") * bins).cast("int"))
    return rows.where("p >= 0 AND p <= 1").groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("share"))


def histogram(rows: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """Counts between edges, each bin without its right edge."""
    b = F.lit(None).cast("int")
    for i in reversed(range(len(edges) - 1)):
        b = F.when((F.col(value) >= edges[i]) & (F.col(value) < edges[i + 1]), i).otherwise(b)
    return rows.groupBy(b.alias("bin")).agg(F.count("*").alias("n")).where("bin IS NOT NULL")


def ranked(rows: DataFrame, keys: list[str], value: str, parts: int = 64) -> DataFrame:
    """_rank (from 1) and _n: each row's exact place among its key's values, and their number; null values are left out.

    Approximate quantiles cut a key's values into parts; rows are ranked inside a
    part and moved on by the rows of the parts before, so that a key that holds
    most rows is not ordered by one task.
    """
    rows = rows.where(F.col(value).isNotNull())
    names = [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    cuts = rows.groupBy(*names).agg(F.percentile_approx(value, [i / parts for i in range(1, parts)], 10_000).alias("_cuts"))
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    dealt = rows.join(cuts, on).drop(*[f"_k{i}" for i in range(len(keys))]).withColumn("_part", F.size(F.filter("_cuts", lambda c: c <= F.col(value)))).drop("_cuts")
    sums = dealt.groupBy(*names, F.col("_part").alias("_p")).agg(F.count("*").alias("_c"))
    key = [f"_k{i}" for i in range(len(keys))]
    before = Window.partitionBy(*key).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*key, "_p", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"), F.sum("_c").over(Window.partitionBy(*key)).alias("_n"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(value))
    return dealt.withColumn("_r", inside).join(offsets, on & (F.col("_part") == F.col("_p"))).select(*rows.columns, (F.col("_r") + F.col("_o")).alias("_rank"), "_n")


def nearest_rank(rows: DataFrame, keys: list[str], value: str, share: float = 0.95) -> DataFrame:
    """n, the median, and the element at floor(share (n - 1)) in sorted order."""
    n, r, v = F.col("_n"), F.col("_rank"), F.col(value)
    at = F.floor(F.lit(share) * (n - 1)) + 1
    low, high = F.floor((n + 1) / 2), F.ceil((n + 1) / 2)
    return ranked(rows, keys, value).groupBy(*keys).agg(F.count("*").alias("n"), ((F.max(F.when(r == low, v)) + F.max(F.when(r == high, v))) / 2).alias("median"), F.max(F.when(r == at, v)).alias("high"))


def by_dimensions(rows: DataFrame, dimensions: list[str], threshold: float = 0.5) -> DataFrame:
    """point_metrics and AUC for every value of each of several dimensions, as (dimension, stratum)."""
    long = rows.select("p", "y", F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("stratum")) for d in dimensions])).alias("s")).select("p", "y", "s.*")
    keys = ["dimension", "stratum"]
    return point_metrics(long, keys, threshold).join(auc(long, keys).select(*keys, "auc"), keys)
