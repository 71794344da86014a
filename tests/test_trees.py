"""Trees as tables, attributions, folds, dense numbers and permutation importance, against brute force and SQL."""

import itertools
import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from hearth.operators import detect, metrics, models, numbering, trees
from hearth.plans import evaluation

FEATURES = ["a", "b", "c", "e"]


@pytest.fixture(scope="module")
def rows(spark):
    random.seed(7)
    made = []
    for i in range(240):
        a, b, c, e = random.random(), random.randrange(4), random.gauss(0, 1), random.random()
        y = float((a > 0.5) ^ (b > 1) or c > 1.2 and e < 0.4)
        made.append((i, a if i % 17 else None, float(b), c, e, y))
    return spark.createDataFrame(made, "id long, a double, b double, c double, e double, y double").repartition(3)


@pytest.fixture(scope="module")
def fitted(rows):
    smaller = {"forest": {"numTrees": 4, "maxDepth": 4}, "boosted": {"maxIter": 6}, "tree": {}}
    return {kind: models.fit(rows, FEATURES, kind, **p) for kind, p in smaller.items()}


def shapley(nodes, x, features):
    """From the definition, over all subsets; absent features follow both branches by training weight."""

    def value(tree, node, present):
        n = nodes[tree, node]
        if n.feature is None:
            return n.value
        left, right = nodes[tree, n.left], nodes[tree, n.right]
        if n.feature in present:
            return value(tree, n.left if x[n.feature] <= n.threshold else n.right, present)
        return (left.cover * value(tree, n.left, present) + right.cover * value(tree, n.right, present)) / n.cover

    def margin(present):
        return sum(value(t, 0, present) for t in {t for t, _ in nodes})

    out = []
    for f in range(features):
        others = [g for g in range(features) if g != f]
        total = 0.0
        for k in range(features):
            for s in itertools.combinations(others, k):
                total += math.factorial(k) * math.factorial(features - k - 1) / math.factorial(features) * (margin({*s, f}) - margin(set(s)))
        out.append(total)
    return margin(set()), margin(set(range(features))), out


@pytest.mark.parametrize("kind", ["boosted", "forest", "tree"])
def test_attributions_are_shapley_values(spark, rows, fitted, kind):
    model = fitted[kind]
    nodes = {(r.tree, r.node): r for r in trees.nodes(spark, model).collect()}
    found = trees.attributions(model, rows, "id").collect()
    p = {r.id: r.p for r in models.with_probability(model, rows).select("id", "p").collect()}
    assert len(found) == 240
    for r in found:
        assert sum(r.attributions) == pytest.approx(r.margin - r.base, abs=1e-9)
        assert p[r.id] == pytest.approx(1 / (1 + math.exp(-2 * r.margin)) if kind == "boosted" else r.margin, abs=1e-9)
    for r in found[:40]:
        base, margin, want = shapley(nodes, r["values"], len(FEATURES))
        assert r.base == pytest.approx(base, abs=1e-9) and r.margin == pytest.approx(margin, abs=1e-9)
        assert r.attributions == pytest.approx(want, abs=1e-9)


def test_attribution_tables(spark, rows, fitted):
    found = trees.attributions(fitted["boosted"], rows, "id")
    phi = {r.id: r for r in found.collect()}
    long = trees.by_feature(found, FEATURES).collect()
    assert len(long) == 240 * 4 and all(r.attribution == phi[r.id].attributions[FEATURES.index(r.feature)] for r in long)
    mean = {r.feature: r.importance for r in trees.mean_attribution(found, FEATURES).collect()}
    assert mean == pytest.approx({f: np.mean([abs(r.attributions[i]) for r in phi.values()]) for i, f in enumerate(FEATURES)})
    groups = rows.select("id", (F.col("id") % 3).alias("g"))
    for g, part in itertools.groupby(sorted(trees.top_explained(found, groups, "id", "g", FEATURES, 3).collect(), key=lambda r: (r.g, r.rank)), key=lambda r: r.g):
        part = list(part)
        best = min((r for r in phi.values() if r.id % 3 == g), key=lambda r: (-r.margin, r.id))
        order = sorted(range(4), key=lambda i: -abs(best.attributions[i]))[:3]
        assert [(r.id, r.rank, r.feature, r.attribution) for r in part] == [(best.id, k + 1, FEATURES[i], best.attributions[i]) for k, i in enumerate(order)]


def test_rules_count_what_their_predicates_count(spark, sf, rows, fitted):
    filled = rows.na.fill({"a": rows.approxQuantile("a", [0.5], 0.0)[0]})
    model = models.fit(filled, FEATURES, "tree")
    found = trees.rules(filled, model, FEATURES).collect()
    filled.createOrReplaceTempView("ruled")
    assert len(found) > 2 and sum(r.n for r in found) == 240
    for r in found:
        n, pos = spark.sql(f"SELECT count(*), coalesce(sum(y), 0) FROM ruled WHERE {r.rule}").first()
        assert (r.n, r.n_pos) == (n, pos) and r.share == pytest.approx(pos / n)
    con = duckdb.connect()  # the registered query, by DuckDB on the given tables
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    con.execute(f"CREATE VIEW labels AS SELECT * FROM '{sf}/labels.parquet'")
    con.execute("""CREATE VIEW f AS SELECT CAST(n_chars AS DOUBLE) AS n_chars, CAST(len(string_split(text, chr(10))) AS DOUBLE) AS n_lines,
      length(regexp_replace(text, '[^A-Z]', '', 'g')) / greatest(length(text), 1) AS upper_share, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) / greatest(length(text), 1) AS symbol_share, quality AS y FROM documents JOIN labels USING (doc_id)""")
    for r in evaluation.tree_rules(spark, sf).collect():
        assert (r.n, r.n_pos) == con.execute(f"SELECT count(*), CAST(coalesce(sum(y), 0) AS BIGINT) FROM f WHERE {r.rule}").fetchone()


def test_folds_are_stratified(spark, rows):
    sizes = {}
    for r in models.folds(rows, "id").collect():
        sizes.setdefault(r.y, {}).setdefault(r.fold, 0)
        sizes[r.y][r.fold] += 1
    assert all(set(s) == set(range(5)) and max(s.values()) - min(s.values()) <= 1 for s in sizes.values())
    few = spark.createDataFrame([(i, 1.0 if i < 3 else None) for i in range(10)], "id long, y double")
    got = models.folds(few, "id").collect()
    assert len(got) == 10 and len({r.fold for r in got if r.y == 1.0}) == 3


def test_out_of_fold_metrics_against_sql(spark, rows, tmp_path):
    scored = models.out_of_fold(models.folds(rows, "id"), FEATURES, "id")
    scored.coalesce(1).write.parquet(f"file://{tmp_path}/scores")
    assert scored.select("id").distinct().count() == 240
    con = duckdb.connect()
    con.execute(f"CREATE VIEW s AS SELECT * FROM '{tmp_path}/scores/*.parquet'")
    stored = spark.read.parquet(f"file://{tmp_path}/scores")
    for r in models.fold_metrics(stored).collect():
        where = "TRUE" if r.fold is None else f"fold = {r.fold}"
        n, pos, brier, auc = con.execute(f"""SELECT count(*), CAST(sum(y) AS BIGINT), avg((p - y) ** 2),
          (SELECT avg(CASE WHEN a.p > b.p THEN 1.0 WHEN a.p = b.p THEN 0.5 ELSE 0 END) FROM s a, s b WHERE a.y = 1 AND b.y = 0 AND a.{where if r.fold is not None else 'p IS NOT NULL'} AND b.{where if r.fold is not None else 'p IS NOT NULL'}) FROM s WHERE {where}""").fetchone()
        assert (r.n, r.n_pos) == (n, pos) and r.brier == pytest.approx(brier) and r.auc == pytest.approx(float(auc))
        tp, fp, fn = con.execute(f"SELECT count(*) FILTER (p >= 0.5 AND y = 1), count(*) FILTER (p >= 0.5 AND y = 0), count(*) FILTER (p < 0.5 AND y = 1) FROM s WHERE {where}").fetchone()
        assert (r.precision, r.recall) == (pytest.approx(tp / (tp + fp) if tp + fp else 0), pytest.approx(tp / (tp + fn) if tp + fn else 0))
        ap = con.execute(f"""WITH b AS (SELECT p, sum(y) AS k, count(*) AS m FROM s WHERE {where} GROUP BY p), c AS (SELECT k, sum(k) OVER (ORDER BY p DESC) AS tp, sum(m) OVER (ORDER BY p DESC) AS all_ FROM b)
          SELECT sum(k * tp / all_) / sum(k) FROM c""").fetchone()[0]
        assert r.average_precision == pytest.approx(ap)


def test_permutation_importance_against_brute_force(spark, rows, fitted):
    model = fitted["forest"]
    labelled = rows.withColumn("y", F.col("y").cast("int"))
    got = {r.feature: (r.importance, r.deviation) for r in models.permutation_importance(model, labelled, FEATURES, "id", 3).collect()}
    ranked = sorted(numbering.hash_ranked(labelled, "id", [], "k", 0).collect(), key=lambda r: r.k)
    assert [r.k for r in ranked] == list(range(1, 241))

    def area(made):
        frame = spark.createDataFrame(made, labelled.schema)
        return metrics.auc(models.with_probability(model, frame).select("p", "y"), []).first()["auc"]

    from hearth.functions.numbers import keyed_uniform

    whole = area([tuple(r)[:-1] for r in ranked])
    for f in FEATURES[:2]:
        falls = []
        for k in range(3):
            u = spark.range(1).select(keyed_uniform(F.lit(f), F.lit(k), seed=0)).first()[0]
            step = int(u * 239) + 1
            made = []
            for i, r in enumerate(ranked):
                d = r.asDict()
                d.pop("k")
                made.append(tuple((d | {f: ranked[(i + step) % 240][f]})[c] for c in labelled.columns))
            falls.append(whole - area(made))
        assert got[f] == (pytest.approx(np.mean(falls)), pytest.approx(np.std(falls)))
    assert got["a"][0] > got["e"][0]


def test_dense_numbers(spark):
    random.seed(1)
    values = [(i, random.choice([None, 1, 2, 2, 2, 2, 3])) for i in range(5000)]
    df = spark.createDataFrame(values, "id int, v int").repartition(7)
    got = numbering.numbered(df, [F.desc_nulls_last("v"), F.asc("id")], parts=9).collect()
    want = sorted(values, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert [(r.id, r.v) for r in sorted(got, key=lambda r: r.seq)] == want and sorted(r.seq for r in got) == list(range(1, 5001))
    assert numbering.numbered(df.limit(0), [F.asc("id")]).count() == 0
    plan = numbering.numbered(df, [F.asc("id")], parts=9)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan.split("BroadcastExchange")[0]  # the rows themselves pass through no window


def test_alert_numbers_of_more_than_four_digits(spark):
    rows = spark.range(10_050).select(F.lit("SENTINEL_CASE").alias("kind"), F.lit("watch").alias("severity"), F.lit(0.5).alias("confidence"), F.col("id").cast("string").alias("group_id"), F.lit(None).cast("string").alias("code"), F.lit("s").alias("summary"), F.lit(1).alias("count"), F.lit(5).alias("detector_ord"))
    got = detect.numbered(detect.ranked(rows)).select("alert_id", "seq").collect()
    by = {r.seq: r.alert_id for r in got}
    assert by[1] == "ALERT-SENT-0001" and by[10_050] == "ALERT-SENT-10050" and len(set(by.values())) == 10_050
