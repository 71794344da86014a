"""Fitted trees as tables: nodes, rules, the leaves that rows reach, and exact attributions.

Nodes come from the table that Spark saves with a model.  A leaf's value is what it
adds to the model's margin: of a boosted model the weighted prediction, of a
forest the share of the class 1 over the number of trees, of a single tree that
share itself.  Attributions are Shapley values of the margin where absent features
follow both branches by the training weight of each (path-dependent TreeSHAP).
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth.session import scratch_dir


def nodes(spark: SparkSession, model: PipelineModel) -> DataFrame:
    """(tree, node, feature, threshold, left, right, cover, n_rows, value) of every node; leaves have no feature.

    Rows whose feature is at most the threshold go left.  cover is the weight of
    the training rows, n_rows their number.
    """
    fitted = model.stages[-1]
    path = f"{scratch_dir(spark)}/trees-{uuid.uuid4().hex}"
    fitted.write().save(path)
    data = spark.read.parquet(f"{path}/data")
    if "nodeData" in data.columns:
        data = data.select(F.col("treeID").alias("tree"), "nodeData.*")
    else:
        data = data.withColumn("tree", F.lit(0))
    weights = list(getattr(fitted, "treeWeights", [1.0]))
    regression = isinstance(fitted, GBTClassificationModel)
    stats = F.col("impurityStats")
    cover = stats[0] if regression else F.aggregate(stats, F.lit(0.0), lambda a, x: a + x)
    value = F.col("prediction") * F.element_at(F.array(*map(F.lit, weights)), F.col("tree") + 1) if regression else stats[1] / cover / len(weights)
    leaf = F.col("leftChild") < 0
    return data.select(
        "tree",
        F.col("id").alias("node"),
        F.when(~leaf, F.col("split.featureIndex")).alias("feature"),
        F.when(~leaf, F.col("split.leftCategoriesOrThreshold")[0]).alias("threshold"),
        F.when(~leaf, F.col("leftChild")).alias("left"),
        F.when(~leaf, F.col("rightChild")).alias("right"),
        cover.alias("cover"),
        F.col("rawCount").alias("n_rows"),
        F.when(leaf, value).alias("value"),
    )


@dataclass(frozen=True)
class Leaf:
    tree: int
    node: int
    value: float
    #: Distinct features on the way, the bounds low < x <= high, and the share of training weight that takes the branches.
    features: tuple[int, ...]
    low: tuple[float, ...]
    high: tuple[float, ...]
    share: tuple[float, ...]


def leaves(table: DataFrame) -> list[Leaf]:
    """The leaves of a node table, whose size is the model's, with the ways to them."""
    known = {(r.tree, r.node): r for r in table.collect()}
    out: list[Leaf] = []
    for (tree, node), root in known.items():
        if node:
            continue
        ways = [(root, {})]
        while ways:
            at, way = ways.pop()
            if at.feature is None:
                way = dict(sorted(way.items()))
                out.append(Leaf(tree, at.node, at.value, tuple(way), *(tuple(w[i] for w in way.values()) for i in range(3))))
                continue
            low, high, share = way.get(at.feature, (-np.inf, np.inf, 1.0))
            left, right = known[tree, at.left], known[tree, at.right]
            ways.append((left, way | {at.feature: (low, min(high, at.threshold), share * left.cover / at.cover)}))
            ways.append((right, way | {at.feature: (max(low, at.threshold), high, share * right.cover / at.cover)}))
    return sorted(out, key=lambda x: (x.tree, x.node))


def base(found: list[Leaf]) -> float:
    """The margin that is expected without any feature."""
    return float(sum(x.value * np.prod(x.share) for x in found))


def attributed(x: np.ndarray, found: list[Leaf]) -> tuple[np.ndarray, np.ndarray]:
    """(attributions, margins) of rows of features, all rows of a batch at once.

    For each leaf the weights of subsets by size grow feature by feature
    (extended), and each feature's part is what is left when it is taken out
    again (unwound).
    """
    out, margin = np.zeros(x.shape), np.zeros(len(x))
    for leaf in found:
        d = len(leaf.features)
        taken = [((x[:, f] > lo) & (x[:, f] <= hi)).astype(float) for f, lo, hi in zip(leaf.features, leaf.low, leaf.high)]
        margin += leaf.value * np.prod(taken, axis=0) if d else leaf.value
        weight = np.zeros((d + 1, len(x)))
        weight[0] = 1
        for i, (one, zero) in enumerate(zip(taken, leaf.share)):
            for j in range(i, -1, -1):
                weight[j + 1] += one * weight[j] * ((j + 1) / (i + 2))
                weight[j] *= zero * ((i + 1 - j) / (i + 2))
        for f, one, zero in zip(leaf.features, taken, leaf.share):
            rest, with_it, without = weight[d].copy(), np.zeros(len(x)), np.zeros(len(x))
            for j in range(d - 1, -1, -1):
                part = rest * ((d + 1) / (j + 1))
                with_it += part
                rest = weight[j] - part * (zero * (d - j) / (d + 1))
                without += weight[j] * ((d + 1) / (zero * (d - j)))
            out[:, f] += np.where(one > 0, with_it, without) * (one - zero) * leaf.value
    return out, margin


def attributions(model: PipelineModel, rows: DataFrame, key: str, vector: str = "assembled") -> DataFrame:
    """(key, base, margin, values, attributions) of every row, one array place for each feature."""
    found = leaves(nodes(rows.sparkSession, model))
    expected = base(found)
    shipped = rows.sparkSession.sparkContext.broadcast(found)  # as large as the model
    ready = model.transform(rows).select(F.col(key).alias("key"), vector_to_array(vector).alias("values"))

    def run(batches):
        for batch in batches:
            column = batch.column(1)
            if not len(column):
                continue
            x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
            phi, margin = attributed(x, shipped.value)
            ends = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(margin), column, pa.ListArray.from_arrays(pa.array(ends), pa.array(phi.ravel()))], names=["key", "margin", "values", "attributions"])

    kind = dict(ready.dtypes)["key"]
    made = ready.mapInArrow(run, f"key {kind}, margin double, values array<double>, attributions array<double>")
    return made.select(F.col("key").alias(key), F.lit(expected).alias("base"), "margin", "values", "attributions")


def by_feature(found: DataFrame, features: list[str]) -> DataFrame:
    """Attributions in long form: a row for each row and feature, with the feature's value."""
    names = F.array(*map(F.lit, features))
    others = [c for c in found.columns if c not in ("values", "attributions")]
    parts = F.arrays_zip(names.alias("feature"), F.col("values").alias("value"), F.col("attributions").alias("attribution"))
    return found.select(*others, F.inline(parts)).toDF(*others, "feature", "value", "attribution")


def mean_attribution(found: DataFrame, features: list[str]) -> DataFrame:
    """(feature, importance): the mean absolute attribution, the largest first."""
    return by_feature(found, features).groupBy("feature").agg(F.avg(F.abs("attribution")).alias("importance")).orderBy(F.desc("importance"), "feature")


def top_explained(found: DataFrame, groups: DataFrame, key: str, group: str, features: list[str], n: int = 8) -> DataFrame:
    """Of each group the row of the largest margin (ties to the least key), with its n strongest features by absolute attribution."""
    order = F.struct(F.col("margin"), -F.col(key))
    best = found.join(groups.select(key, group), key).groupBy(group).agg(F.max_by(F.struct(key, "base", "margin", "values", "attributions"), order).alias("r")).select(group, "r.*")
    zipped = F.transform(F.array(*map(F.lit, features)), lambda f, i: F.struct((-F.abs(F.get("attributions", i))).alias("order"), f.alias("feature"), F.get("values", i).alias("value"), F.get("attributions", i).alias("attribution")))
    return best.select(group, key, "base", "margin", F.posexplode(F.slice(F.array_sort(zipped), 1, n)).alias("rank", "f")).select(group, key, "base", "margin", (F.col("rank") + 1).alias("rank"), "f.feature", "f.value", "f.attribution")


def predicate(leaf: Leaf, features: list[str]) -> str:
    """A leaf's rule as a SQL predicate."""
    said = []
    for f, low, high in zip(leaf.features, leaf.low, leaf.high):
        said += [f"{features[f]} > {low!r}"] if low > -np.inf else []
        said += [f"{features[f]} <= {high!r}"] if high < np.inf else []
    return " AND ".join(said) or "TRUE"


def reached(rows: DataFrame, model: PipelineModel, table: DataFrame, features: list[str]) -> DataFrame:
    """The rows with the leaf (tree, node) that they reach in each tree: one equality join with the nodes for each level.

    features: the columns, in the order in which the model was fitted on them.
    """
    fitted = model.stages[-1]
    trees = getattr(fitted, "trees", [fitted])
    small = F.broadcast(table.select("tree", "node", "feature", "threshold", "left", "right"))  # as large as the model
    values = F.array(*[F.col(f).cast("double") for f in features])
    goes = F.when(F.get(values, F.col("feature")) <= F.col("threshold"), F.col("left")).otherwise(F.col("right"))
    at = rows.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(len(trees) - 1)))).withColumn("node", F.lit(0))
    for _ in range(max(t.depth for t in trees)):
        at = at.join(small, ["tree", "node"]).withColumn("node", F.coalesce(goes, F.col("node"))).select(*rows.columns, "tree", "node")
    return at


def rules(rows: DataFrame, model: PipelineModel, features: list[str], label: str = "y") -> DataFrame:
    """(tree, leaf, rule, value, n, n_pos, share): each leaf's rule as a SQL predicate, with the rows that it holds for."""
    spark = rows.sparkSession
    table = nodes(spark, model)
    said = [(x.tree, x.node, predicate(x, features), float(x.value)) for x in leaves(table)]
    named = spark.createDataFrame(said, "tree int, leaf int, rule string, value double")
    counts = reached(rows, model, table, features).groupBy("tree", F.col("node").alias("leaf")).agg(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("n_pos"))
    held = named.join(counts, ["tree", "leaf"], "left").na.fill(0, ["n", "n_pos"])
    return held.withColumn("share", F.col("n_pos") / F.nullif("n", F.lit(0)))
