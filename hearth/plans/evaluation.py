"""Metrics, linkage and models."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth.operators import linkage, metrics, models, trace, trees
from hearth.plans import plain
from hearth.plans.views import read
from hearth.session import own_session, scratch_dir, stored
from hearth.sources.writers import load_model, save_model


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score from a text's length, and the quality label."""
    d = read(spark, sf_dir, "documents").select("doc_id", "lang", "source", F.least(F.lit(1.0), F.col("n_chars") / 4000).alias("p"))
    return d.join(read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y"), "toxic"), "doc_id")


SCORES_SQL = "s AS (SELECT d.doc_id, lang, source, least(1.0, n_chars / 4000) AS p, quality AS y, toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def auc_by_stratum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.auc(_scores(spark, sf_dir), ["lang"]), "auc")


def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.average_precision(_scores(spark, sf_dir), ["lang"]), "average_precision")


def curve_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.curve(_scores(spark, sf_dir), ["lang"]), "p", "tpr", "fpr", "precision").select("lang", "p", "tp", "fp", "tpr", "fpr", "precision")


def metrics_by_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.by_dimensions(_scores(spark, sf_dir), ["lang", "source", "toxic"]), "brier", "precision", "recall", "f1", "auc")


def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.calibration(_scores(spark, sf_dir)), "mean_p", "share")


def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(_scores(spark, sf_dir))


def threshold_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(trace.threshold_curve(_scores(spark, sf_dir), "p", "y", [0.05, 0.1, 0.2, 0.3, 0.5]), "sensitivity", "precision", "f1")


def value_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.histogram(read(spark, sf_dir, "events"), "value", [0.0, 1.0, 5.0, 10.0, 50.0, 100.0, 1000.0])


def value_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.nearest_rank(read(spark, sf_dir, "events").select("event_type", "value"), ["event_type"], "value"), "median", "high")


def _records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = read(spark, sf_dir, "customer").select(F.concat(F.lit("C"), F.lpad(F.col("c_custkey").cast("string"), 9, "0")).alias("id"), F.lit("a").alias("site_id"), F.substring("c_name", 1, 8).alias("first_name"), F.substring("c_name", 10, 9).alias("last_name"), F.concat(F.lit("19"), F.lpad((F.col("c_custkey") % 100).cast("string"), 2, "0"), F.lit("-01-01")).alias("dob"), F.concat_ws(" ", (F.col("c_custkey") % 7).cast("string"), F.lit("main street")).alias("address"), F.col("c_nationkey").cast("string").alias("zip"))
    s = read(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0")).alias("id"), F.lit("b").alias("site_id"), F.substring("s_name", 1, 8).alias("first_name"), F.substring("s_name", 10, 9).alias("last_name"), F.concat(F.lit("19"), F.lpad((F.col("s_suppkey") % 100).cast("string"), 2, "0"), F.lit("-01-01")).alias("dob"), F.concat_ws(" ", (F.col("s_suppkey") % 7).cast("string"), F.lit("main st")).alias("address"), F.col("s_nationkey").cast("string").alias("zip"))
    return c, s


def blocked_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linkage.blocked_pairs(*_records(spark, sf_dir), salts=64, columns=["id", "site_id", "zip"]).select(F.col("left.id").alias("left_id"), F.col("right.id").alias("right_id"))


def _links(spark: SparkSession, sf_dir: str, ids: int | None = None, wanted: linkage.Leading | None = None) -> DataFrame:
    """All links, a row for many of equal similarities; two chunks of records are a row for a Python worker, which holds few."""
    own = own_session(spark, **{"spark.sql.execution.arrow.maxRecordsPerBatch": "32"})
    return linkage.tiered(linkage.scored(linkage.compared(*_records(own, sf_dir), {"st": "street"}, ids=ids, wanted=wanted)))


def record_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = [*linkage.SIMILARITIES, "raw", "probability"]
    links = _links(spark, sf_dir).withColumns({c: F.round(c, 5) for c in numbers})
    return linkage.opened(links).select("left_id", "right_id", *numbers, "tier")


def linkage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(linkage.summary(_links(spark, sf_dir, ids=0), F.col("n")), "mean_probability")


def best_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    limits = {"auto": 50, "clerical": 50, "none": 10}
    links = _links(spark, sf_dir, max(limits.values()), linkage.Leading(limits)).withColumn("probability", F.round("probability", 5))
    return linkage.best_of_tier(linkage.opened(links), limits, "left_id", "right_id").select("left_id", "right_id", "probability", "tier")


def _model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The features of the labelled documents, stored: models pass over them many times, and texts are read once."""
    d = read(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("n_chars"), F.size(F.split("text", "\n")).cast("double").alias("n_lines"), (F.length(F.regexp_replace("text", "[^A-Z]", "")) / F.greatest(F.length("text"), F.lit(1))).alias("upper_share"), (F.length(F.regexp_replace("text", "[^#*$%&|<>]", "")) / F.greatest(F.length("text"), F.lit(1))).alias("symbol_share"))
    return stored(d.join(read(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("y")), "doc_id"), "features")


MODEL_FEATURES = ["n_chars", "n_lines", "upper_share", "symbol_share"]


def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five folds of the labelled documents, each with its share of both classes."""
    return models.folds(_model_rows(spark, sf_dir), "doc_id").select("doc_id", F.col("y").cast("int").alias("y"), "fold")


def risk_model_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold counts, AUC, average precision, Brier and F1 of the logistic model, by fold and over all."""
    rows = models.folds(_model_rows(spark, sf_dir), "doc_id")
    return models.fold_metrics(models.out_of_fold(rows, MODEL_FEATURES, "doc_id"))


def model_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC of each kind of model on the rows of one fold after fitting the others; fewer trees than a real run takes."""
    rows = stored(models.folds(_model_rows(spark, sf_dir), "doc_id"), "folds")
    smaller = {"forest": {"numTrees": 40}, "boosted": {"maxIter": 15}}
    found = []
    for kind in ("logistic", "forest", "boosted", "tree"):
        model = models.fit(rows.where("fold <> 0"), MODEL_FEATURES, kind, **smaller.get(kind, {}))
        scored = models.with_probability(model, rows.where("fold = 0")).select(F.col("y").cast("int").alias("y"), "p")
        found.append(metrics.auc(scored, []).select(F.lit(kind).alias("kind"), F.round("auc", 4).alias("auc")))
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


def saved_model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The probabilities that a model gives after it was written and read again."""
    rows = _model_rows(spark, sf_dir)
    path = f"{scratch_dir(spark)}/model-{uuid.uuid4().hex}"
    save_model(models.fit(rows, MODEL_FEATURES), path)
    return models.with_probability(load_model(path), rows).select("doc_id", "p")


def permutation_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation of the fall of AUC over five repeats for each feature."""
    rows = _model_rows(spark, sf_dir)
    model = models.fit(rows, MODEL_FEATURES)
    return models.permutation_importance(model, rows.withColumn("y", F.col("y").cast("int")), MODEL_FEATURES, "doc_id")


def _boosted(rows: DataFrame) -> models.PipelineModel:
    """A boosted model; fewer trees than a real run takes."""
    return models.fit(rows, MODEL_FEATURES, "boosted", maxIter=15)


def tree_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each feature adds to each document's margin under the boosted model."""
    rows = _model_rows(spark, sf_dir)
    return trees.by_feature(trees.attributions(_boosted(rows), rows, "doc_id"), MODEL_FEATURES)


def attribution_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean absolute attribution of each feature."""
    rows = _model_rows(spark, sf_dir)
    return trees.mean_attribution(trees.attributions(_boosted(rows), rows, "doc_id"), MODEL_FEATURES)


def source_explanations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each source the document of the largest margin, with its strongest features."""
    rows = _model_rows(spark, sf_dir)
    return trees.top_explained(trees.attributions(_boosted(rows), rows, "doc_id"), read(spark, sf_dir, "documents"), "doc_id", "source", MODEL_FEATURES)


def tree_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of the interpretable tree, with the documents that each holds for."""
    rows = _model_rows(spark, sf_dir)
    return trees.rules(rows, models.fit(rows, MODEL_FEATURES, "tree"), MODEL_FEATURES)


def _jw(a: str, b: str) -> str:
    same = " + ".join(f"CASE WHEN substr({a}, 1, {n}) = substr({b}, 1, {n}) AND length({a}) >= {n} AND length({b}) >= {n} THEN 1 ELSE 0 END" for n in (1, 2, 3, 4))
    return f"CASE WHEN {a} = {b} THEN 1.0 ELSE jaro_similarity({a}, {b}) + ({same}) * 0.1 * (1 - jaro_similarity({a}, {b})) END"


_RECORDS_SQL = """c AS (SELECT 'C' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS id, lower(substr(c_name, 1, 8)) AS f, lower(substr(c_name, 10, 9)) AS l, '19' || lpad(CAST(c_custkey % 100 AS VARCHAR), 2, '0') AS y, c_custkey % 7 AS a, c_nationkey AS z FROM customer),
u AS (SELECT 'S' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') AS id, lower(substr(s_name, 1, 8)) AS f, lower(substr(s_name, 10, 9)) AS l, '19' || lpad(CAST(s_suppkey % 100 AS VARCHAR), 2, '0') AS y, s_suppkey % 7 AS a, s_nationkey AS z FROM supplier),
pairs AS (SELECT c.id AS left_id, u.id AS right_id, c.f AS f1, u.f AS f2, c.l AS l1, u.l AS l2, c.y AS y1, u.y AS y2, c.a AS a1, u.a AS a2, c.z AS z1, u.z AS z2 FROM c JOIN u ON (c.z = u.z OR c.l = u.l))"""


def _weight(s: str, m: float, u: float) -> str:
    return f"{s} * log2({m}::DOUBLE / {u}::DOUBLE) + (1 - {s}) * log2((1 - {m}::DOUBLE) / (1 - {u}::DOUBLE))"


_LINKS_SQL = f"""{_RECORDS_SQL},
sims AS (SELECT left_id, right_id, {_jw('l1', 'l2')} AS s_last_name, {_jw('f1', 'f2')} AS s_first_name, CASE WHEN y1 = y2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS s_dob, CASE WHEN a1 = a2 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE / 3 END AS s_address, CASE WHEN z1 = z2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS s_zip FROM pairs),
raws AS (SELECT *, {" + ".join(_weight(f"s_{f.name}", f.m, f.u) for f in linkage.FIELDS)} AS raw FROM sims),
probs AS (SELECT *, CASE WHEN s_dob < 0.99 OR s_last_name < 0.85 THEN least(0.93, 1 / (1 + exp(-raw / 8))) ELSE 1 / (1 + exp(-raw / 8)) END AS probability FROM raws),
links AS (SELECT *, CASE WHEN probability >= 0.95 THEN 'auto' WHEN probability >= 0.80 THEN 'clerical' ELSE 'none' END AS tier FROM probs)"""
_POINTS_SQL = f"""{SCORES_SQL},
b AS (SELECT lang, p, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM s GROUP BY 1, 2),
pts AS (SELECT lang, p, pos, CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp, sum(pos) OVER (PARTITION BY lang) AS np, sum(neg) OVER (PARTITION BY lang) AS nn FROM b WINDOW w AS (PARTITION BY lang ORDER BY p DESC ROWS UNBOUNDED PRECEDING))"""


def _auc(keys: str, source: str) -> str:
    return f"""SELECT {keys}, CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg, sum(pos * (below + neg / 2)) / nullif(sum(pos) * sum(neg), 0) AS auc FROM (
  SELECT *, coalesce(sum(neg) OVER (PARTITION BY {keys} ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM (SELECT {keys}, p, count(*) FILTER (y = 1) AS pos, count(*) FILTER (y = 0) AS neg FROM {source} GROUP BY {keys}, p)) GROUP BY {keys}"""


def _ratio(a: str, b: str) -> str:
    return f"round(CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / ({b}) ELSE 0.0 END, 6)"


QUERIES = {f.__name__: plain(f) for f in (auc_by_stratum, average_precision, curve_points, metrics_by_dimension, calibration, confusion, threshold_curve, value_histogram, value_percentiles, blocked_pairs, record_linkage, linkage_summary, best_links, stratified_folds, risk_model_metrics, model_kinds, saved_model_scores, permutation_importance, tree_attribution, attribution_importance, source_explanations, tree_rules)}
ORACLES = {
    "auc_by_stratum": f"WITH {SCORES_SQL} SELECT lang, n_pos, n_neg, round(auc, 6) AS auc FROM ({_auc('lang', 's')})",
    "average_precision": f"WITH {_POINTS_SQL} SELECT lang, round(sum(pos * (CAST(tp AS DOUBLE) / (tp + fp))) / nullif(sum(pos), 0), 6) AS average_precision FROM pts GROUP BY 1",
    "curve_points": f"WITH {_POINTS_SQL} SELECT lang, round(p, 6) AS p, tp, fp, round(CAST(tp AS DOUBLE) / nullif(np, 0), 6) AS tpr, round(CAST(fp AS DOUBLE) / nullif(nn, 0), 6) AS fpr, round(CAST(tp AS DOUBLE) / (tp + fp), 6) AS precision FROM pts",
    "metrics_by_dimension": f"""WITH {SCORES_SQL},
long AS (SELECT p, y, 'lang' AS dimension, lang AS stratum FROM s UNION ALL SELECT p, y, 'source', source FROM s UNION ALL SELECT p, y, 'toxic', CAST(toxic AS VARCHAR) FROM s),
m AS (SELECT dimension, stratum, count(*) AS n, count(*) FILTER (y = 1) AS n_pos, round(avg((p - y) ** 2), 6) AS brier, count(*) FILTER (p >= 0.5 AND y = 1) AS tp, count(*) FILTER (p >= 0.5 AND y <> 1) AS fp, count(*) FILTER (p < 0.5 AND y = 1) AS fn, count(*) FILTER (p < 0.5 AND y <> 1) AS tn FROM long GROUP BY 1, 2),
a AS ({_auc('dimension, stratum', 'long')})
SELECT m.*, {_ratio('tp', 'tp + fp')} AS precision, {_ratio('tp', 'tp + fn')} AS recall, {_ratio('2 * tp', '2 * tp + fp + fn')} AS f1, round(auc, 6) AS auc FROM m JOIN (SELECT dimension, stratum, auc FROM a) USING (dimension, stratum)""",
    "calibration": f"WITH {SCORES_SQL} SELECT CAST(least(9, floor(p * 10)) AS INTEGER) AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS share FROM s GROUP BY 1",
    "confusion": f"WITH {SCORES_SQL} SELECT y, CAST(p >= 0.5 AS INTEGER) AS predicted, count(*) AS n FROM s GROUP BY 1, 2",
    "threshold_curve": f"""WITH {SCORES_SQL}, t(threshold) AS (VALUES (0.05::DOUBLE), (0.1::DOUBLE), (0.2::DOUBLE), (0.3::DOUBLE), (0.5::DOUBLE)),
c AS (SELECT threshold, count(*) FILTER (p >= threshold AND y = 1) AS tp, count(*) FILTER (p >= threshold AND y = 0) AS fp, count(*) FILTER (p < threshold AND y = 1) AS fn FROM s, t GROUP BY 1)
SELECT *, {_ratio('tp', 'tp + fn')} AS sensitivity, {_ratio('tp', 'tp + fp')} AS precision, {_ratio('2 * tp', '2 * tp + fp + fn')} AS f1 FROM c""",
    "value_histogram": "SELECT CAST(CASE WHEN value < 1 THEN 0 WHEN value < 5 THEN 1 WHEN value < 10 THEN 2 WHEN value < 50 THEN 3 WHEN value < 100 THEN 4 ELSE 5 END AS INTEGER) AS bin, count(*) AS n FROM events WHERE value >= 0 AND value < 1000 GROUP BY 1",
    "value_percentiles": """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS rn, count(*) OVER (PARTITION BY event_type) AS k FROM events)
SELECT event_type, count(*) AS n, round(median(value), 6) AS median, round(max(value) FILTER (rn = floor(0.95::DOUBLE * (k - 1)) + 1), 6) AS high FROM r GROUP BY 1""",
    "stratified_folds": """WITH u AS (SELECT doc_id, quality AS y, (CAST(CAST('0x' || substr(md5(doc_id || '|42'), 1, 12) AS BIGINT) AS DOUBLE) + 0.5) / CAST(281474976710656 AS DOUBLE) AS u FROM documents JOIN labels USING (doc_id))
SELECT doc_id, y, CAST(row_number() OVER (PARTITION BY y ORDER BY u, doc_id) % 5 AS INTEGER) AS fold FROM u""",
    "blocked_pairs": f"WITH {_RECORDS_SQL} SELECT left_id, right_id FROM pairs",
    "record_linkage": f"WITH {_LINKS_SQL} SELECT left_id, right_id, {', '.join(f'round({c}, 5) AS {c}' for c in ('s_last_name', 's_first_name', 's_dob', 's_address', 's_zip', 'raw', 'probability'))}, tier FROM links",
    "linkage_summary": f"WITH {_LINKS_SQL} SELECT tier, count(*) AS n, round(avg(probability), 6) AS mean_probability FROM links GROUP BY 1",
    "best_links": f"""WITH {_LINKS_SQL}, r AS (SELECT left_id, right_id, round(probability, 5) AS probability, tier, row_number() OVER (PARTITION BY tier ORDER BY round(probability, 5) DESC, left_id, right_id) AS rn FROM links)
SELECT left_id, right_id, probability, tier FROM r WHERE rn <= CASE tier WHEN 'none' THEN 10 ELSE 50 END""",
}
