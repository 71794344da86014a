"""Risk models on pyspark.ml: pipelines, stratified folds, out-of-fold scores and metrics, permutation importance."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearth.functions.numbers import keyed_uniform
from hearth.operators import metrics
from hearth.operators.numbering import hash_ranked
from hearth.session import stored


def pipeline(features: list[str], kind: str = "logistic", label: str = "y", weight: str | None = "weight", **params) -> Pipeline:
    """Median imputation, assembly, and a classifier: logistic (on scaled features), forest, boosted or tree; params replace the classifier's own."""
    filled = [f"{f}__filled" for f in features]
    w = {"weightCol": weight} if weight else {}
    made = {
        "logistic": lambda: LogisticRegression(labelCol=label, featuresCol="scaled", maxIter=2000, regParam=1e-4, **w),
        "forest": lambda: RandomForestClassifier(labelCol=label, featuresCol="assembled", numTrees=200, maxDepth=8, seed=42, **w),
        "boosted": lambda: GBTClassifier(labelCol=label, featuresCol="assembled", maxIter=300, maxDepth=3, stepSize=0.05, seed=42, **w),
        "tree": lambda: DecisionTreeClassifier(labelCol=label, featuresCol="assembled", maxDepth=4, minInstancesPerNode=10, **w),
    }
    scaling = [StandardScaler(inputCol="assembled", outputCol="scaled", withMean=True)] if kind == "logistic" else []
    return Pipeline(stages=[Imputer(strategy="median", inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="assembled"), *scaling, made[kind]().setParams(**params)])


def balanced(rows: DataFrame, label: str = "y") -> DataFrame:
    """Rows with weights that give both classes the same sum."""
    sums = rows.groupBy(label).agg(F.count("*").alias("_c"))
    total = rows.count()
    weights = {r[label]: total / (2 * r["_c"]) for r in sums.collect()}  # one row for each class
    table = reduce(lambda acc, kv: F.when(F.col(label) == kv[0], kv[1]).otherwise(acc), weights.items(), F.lit(1.0))
    return rows.withColumn("weight", table)


def folds(rows: DataFrame, key: str, label: str = "y", n: int = 5, seed: int = 42) -> DataFrame:
    """Stratified folds by rank of a keyed hash within each class: sizes differ by one at most and never change between runs."""
    return hash_ranked(rows, key, [label], "fold", seed).withColumn("fold", F.pmod("fold", F.lit(n)).cast("int"))


def hashed_folds(rows: DataFrame, key: str, n: int = 5, seed: int = 42) -> DataFrame:
    """Folds by hash alone, without the sort of a class: for tables too large for a rank."""
    return rows.withColumn("fold", F.floor(keyed_uniform(F.col(key), seed=seed) * n).cast("int"))


def with_probability(model: PipelineModel, rows: DataFrame) -> DataFrame:
    return model.transform(rows).withColumn("p", vector_to_array("probability")[1])


def out_of_fold(rows: DataFrame, features: list[str], key: str, kind: str = "logistic", n: int = 5) -> DataFrame:
    """(key, y, fold, p): every row scored by the model that did not see it."""
    rows = stored(rows, "folds")
    parts = []
    for k in range(n):
        model = pipeline(features, kind).fit(balanced(rows.where(F.col("fold") != k)))
        parts.append(with_probability(model, rows.where(F.col("fold") == k)).select(key, "y", "fold", "p"))
    return reduce(DataFrame.unionByName, parts)


def fit(rows: DataFrame, features: list[str], kind: str = "logistic", weighted: bool = True, **params) -> PipelineModel:
    return pipeline(features, kind, weight="weight" if weighted else None, **params).fit(balanced(rows) if weighted else rows)


def rules(model: PipelineModel) -> str:
    """The text of a fitted tree; `trees.rules` gives its rules as rows."""
    return model.stages[-1].toDebugString


def fold_metrics(scored: DataFrame) -> DataFrame:
    """Of out-of-fold scores (y, fold, p): counts, AUC, average precision and Brier score of each fold, and of all rows (a null fold), with precision, recall and F1 at 0.5."""
    both = scored.select(F.col("y").cast("int").alias("y"), "p", F.explode(F.array("fold", F.lit(None))).alias("fold"))
    keys = both.select(F.coalesce("fold", F.lit(-1)).alias("fold"), "y", "p")
    joined = metrics.point_metrics(keys, ["fold"]).join(metrics.auc(keys, ["fold"]).select("fold", "auc"), "fold").join(metrics.average_precision(keys, ["fold"]), "fold")
    return joined.withColumn("fold", F.nullif("fold", F.lit(-1)))


def permutation_importance(model: PipelineModel, rows: DataFrame, features: list[str], key: str, repeats: int = 5, seed: int = 0) -> DataFrame:
    """(feature, importance, deviation): mean and deviation of the fall of AUC when a feature's values are dealt anew among the rows.

    Rows are ranked once by a keyed hash.  For each feature and repeat a row takes
    the value of the row a keyed number of ranks further on, around the end: one
    equality join for all of them, and one pass of the model over all its rows.
    """
    ranked = stored(hash_ranked(rows, key, [], "_rank", seed), "ranked")
    n = F.lit(ranked.count())
    turns = [F.struct(F.lit(f).alias("feature"), F.lit(r).alias("repeat"), (F.floor(keyed_uniform(F.lit(f), F.lit(r), seed=seed) * (n - 1)) + 1).alias("step")) for f in features for r in range(repeats)]
    whole = F.struct(F.lit("").alias("feature"), F.lit(0).alias("repeat"), F.lit(0).cast("long").alias("step"))
    asked = ranked.withColumn("_t", F.explode(F.array(whole, *turns))).select("*", "_t.*").drop("_t").withColumn("_from", F.pmod(F.col("_rank") - 1 + F.col("step"), n) + 1)
    values = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("_value")) for f in features]))
    dealt = ranked.select(F.col("_rank").alias("_from"), values.alias("_v")).select("_from", "_v.*")
    shuffled = asked.join(dealt, ["_from", "feature"], "left")
    for f in features:
        shuffled = shuffled.withColumn(f, F.when(F.col("feature") == f, F.col("_value")).otherwise(F.col(f)))
    areas = metrics.auc(with_probability(model, shuffled).select("feature", "repeat", "p", "y"), ["feature", "repeat"]).select("feature", "repeat", "auc")
    areas = stored(areas, "areas")
    first = areas.where("feature = ''").select(F.col("auc").alias("whole"))
    falls = areas.where("feature <> ''").join(F.broadcast(first)).withColumn("fall", F.col("whole") - F.col("auc"))
    return falls.groupBy("feature").agg(F.avg("fall").alias("importance"), F.stddev_pop("fall").alias("deviation")).orderBy(F.desc("importance"), "feature")


def tree_importance(model: PipelineModel, features: list[str]) -> list[tuple[str, float]]:
    """A tree model's own importances, the largest first."""
    return sorted(zip(features, model.stages[-1].featureImportances.toArray().tolist()), key=lambda x: (-x[1], x[0]))
