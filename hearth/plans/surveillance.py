"""Clusters, graphs, detectors and alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth.operators import detect, graph, members as member_ops
from hearth.plans import dated, plain, small_tasks
from hearth.plans.views import DAILY_SQL, KINDS, MEMBERS_SQL, MONTHLY_SQL, cases, cases_sql, daily_events, members, monthly_orders, read

CODES = [f"Brand#{i}{j}-{s}" for i in range(1, 6) for j in range(1, 6) for s in (1, 2, 3)]
CODES_SQL = ", ".join(f"'{c}'" for c in CODES)
RULES = [("Brand#11", "ASIA"), ("Brand#22", "EUROPE"), ("Brand#33", "AMERICA"), ("Brand#44", "ASIA")]


def cross_kind_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cross_kind_clusters(cases(spark, sf_dir), members(spark, sf_dir), KINDS)


def cluster_secondaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, m = cases(spark, sf_dir), members(spark, sf_dir)
    rows = graph.secondaries(c, m, graph.cross_kind_clusters(c, m, KINDS))
    return rows.groupBy("group_id", "code").agg(F.count("*").alias("n_secondary"), F.min("onset").alias("first_onset"), F.max("onset").alias("last_onset"), F.sum(F.col("ordinal").cast("long") * F.col("case_id")).alias("check_sum"))


def at_risk_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.at_risk(cases(spark, sf_dir, False), members(spark, sf_dir))


def at_risk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.at_risk_counts(cases(spark, sf_dir), members(spark, sf_dir))


def at_risk_asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The members at risk of one code in each of two groups."""
    asked = spark.createDataFrame([("3", "Brand#11"), ("7", "Brand#22")], "group_id string, code string")
    return graph.at_risk(cases(spark, sf_dir, False), members(spark, sf_dir), asked)


def prophylactic_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.prophylactic(cases(spark, sf_dir), members(spark, sf_dir), CODES, KINDS)


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    n, r, m = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region"), members(spark, sf_dir)
    nation = F.concat(F.lit("N"), F.col("n_nationkey").cast("string"))
    region = F.concat(F.lit("R"), F.col("n_regionkey").cast("string"))
    orders = read(spark, sf_dir, "orders").select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("ref"), F.concat(F.lit("P"), F.substring("o_orderpriority", 1, 1)).alias("priority"))
    vs = graph.vertices((r.select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("i"), "r_name"), "Region", "i", "r_name"), (n.select(nation.alias("i"), "n_name"), "Group", "i", "n_name"), (m, "Member", "ref", "kind"))
    es = graph.edges((n.select(nation.alias("s"), region.alias("t")), "LOCATED_IN", "s", "t"), (m.select("ref", F.concat(F.lit("N"), "group_id").alias("t")), "LIVES_IN", "ref", "t"), (orders, "HAS_PRIORITY", "ref", "priority"))
    return vs, es


def graph_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.stats(*_graph(spark, sf_dir))


def graph_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.export(*_graph(spark, sf_dir))


def graph_hops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Member to group to region."""
    vs, es = _graph(spark, sf_dir)
    m = vs.where("type = 'Member'").select("id", "label")
    one = graph.neighbours(es, "LIVES_IN", m, "id").withColumnsRenamed({"target": "group"})
    return graph.neighbours(es, "LOCATED_IN", one, "group").groupBy(F.col("target").alias("region"), "label").agg(F.count("*").alias("n"))


def region_rule_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "code string, level string")
    groups = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("group_id"), F.col("n_regionkey").alias("region_id"))
    regions = read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("region_id"), F.col("r_name").alias("level"))
    hits = detect.region_rules(cases(spark, sf_dir, False), members(spark, sf_dir), groups, regions, rules)
    return hits.groupBy("group_id", "code", "level").agg(F.count("*").alias("n"), F.min("onset").alias("first_onset"))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def vector_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect.vector_anomaly(daily_events(spark, sf_dir), "event_type", "day", "n")
    return _rounded(found, "last_mean", "rest_mean", "rest_sd", "z", "confidence")


def sentinel_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect.sentinel_cases(monthly_orders(spark, sf_dir), ["nation"], "month", "n")
    return _rounded(found, "mean", "sd", "z", "confidence")


def _alerts(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    clusters = detect.as_alerts(cross_kind_clusters(spark, sf_dir).where("n_first + n_second >= 6"), "CROSS_KIND_CLUSTER", 1, F.lit("action"), F.lit(0.93), F.concat(F.lit("index "), "index_ref"), F.col("n_first") + F.col("n_second"), code=F.col("code"))
    risk = detect.as_alerts(prophylactic_groups(spark, sf_dir), "PROPHYLACTIC_GROUP", 2, F.lit("watch"), F.lit(0.82), F.concat(F.col("n_at_risk").cast("string"), F.lit(" at risk")), F.col("n_diagnosed"), code=F.col("code"))
    sentinel = detect.as_alerts(sentinel_cases(spark, sf_dir).where("fired"), "SENTINEL_CASE", 5, F.col("severity"), F.col("confidence"), F.concat(F.lit("month "), F.col("month").cast("string")), F.col("value"), "nation")
    return [clusters, risk, sentinel]


def alerts_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.ranked(*_alerts(spark, sf_dir))


def worst_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.worst_per_group(detect.ranked(*_alerts(spark, sf_dir)))


def noised_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.with_noised_count(daily_events(spark, sf_dir), "n", ["event_type", "day"])


def member_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return member_ops.counts_and_flags(members(spark, sf_dir), {"has_supplier": ("kind", ["supplier"])})


_CLUSTERS_SQL = f"""{MEMBERS_SQL}, {cases_sql()},
joined AS (SELECT c.*, m.kind, m.group_id FROM cases c JOIN members m USING (ref)),
placed AS (SELECT *, row_number() OVER (PARTITION BY group_id, code ORDER BY onset NULLS FIRST, CASE WHEN kind = 'customer' THEN 0 ELSE 1 END, ref, case_id) AS rn FROM joined),
clusters AS (
  SELECT group_id, code, count(*) FILTER (kind = 'customer') AS n_first, count(*) FILTER (kind = 'supplier') AS n_second, count(DISTINCT ref) AS n_members,
         max(ref) FILTER (rn = 1) AS index_ref, max(kind) FILTER (rn = 1) AS index_kind, max(onset) FILTER (rn = 1) AS index_onset,
         CAST(date_diff('day', max(onset) FILTER (rn = 1), max(onset) FILTER (rn = 2)) AS INTEGER) AS interval_days
  FROM placed GROUP BY group_id, code HAVING count(*) FILTER (kind = 'customer') > 0 AND count(*) FILTER (kind = 'supplier') > 0)"""
_RISK_SQL = f"""sizes AS (SELECT group_id, count(DISTINCT ref) AS n_members FROM members GROUP BY 1),
risk AS (
  SELECT group_id, code, n_diagnosed, n_members - n_diagnosed AS n_at_risk FROM (
    SELECT group_id, code, count(DISTINCT ref) AS n_diagnosed, count(*) FILTER (kind = 'customer') AS a, count(*) FILTER (kind = 'supplier') AS b
    FROM joined WHERE code IN ({CODES_SQL}) GROUP BY 1, 2) JOIN sizes USING (group_id)
  WHERE NOT (a > 0 AND b > 0) AND n_members > n_diagnosed)"""
_SENTINEL_SQL = f"""{MONTHLY_SQL},
framed AS (
  SELECT nation, month, n AS value, avg(n) OVER w AS mean, stddev_samp(n) OVER w AS sd, row_number() OVER (PARTITION BY nation ORDER BY month DESC) AS rn, count(*) OVER (PARTITION BY nation) AS n
  FROM monthly WINDOW w AS (PARTITION BY nation ORDER BY month ROWS BETWEEN 11 PRECEDING AND 1 PRECEDING)),
zs AS (SELECT nation, month, value, mean, sd, n, CASE WHEN n >= 6 THEN (value - mean) / nullif(sd, 0) END AS z FROM framed WHERE rn = 1),
sentinel AS (
  SELECT nation, month, value, round(mean, 6) AS mean, round(sd, 6) AS sd, n, round(z, 6) AS z, coalesce(z >= 2.0 AND value >= 3, false) AS fired,
         CASE WHEN coalesce(z >= 2.0 AND value >= 3, false) THEN CASE WHEN z >= 4 THEN 'action' ELSE 'watch' END END AS severity,
         CASE WHEN coalesce(z >= 2.0 AND value >= 3, false) THEN round(least(0.99, 0.55 + 0.08 * z), 6) END AS confidence
  FROM zs)"""
_ALERTS_SQL = f"""{_CLUSTERS_SQL}, {_RISK_SQL}, {_SENTINEL_SQL},
every AS (
  SELECT 'CROSS_KIND_CLUSTER' AS kind, 'action' AS severity, CAST(0.93 AS DOUBLE) AS confidence, group_id, code, 'index ' || index_ref AS summary, n_first + n_second AS "count", 1 AS detector_ord FROM clusters WHERE n_first + n_second >= 6
  UNION ALL SELECT 'PROPHYLACTIC_GROUP', 'watch', 0.82, group_id, code, n_at_risk || ' at risk', n_diagnosed, 2 FROM risk
  UNION ALL SELECT 'SENTINEL_CASE', severity, confidence, nation, NULL, 'month ' || month, value, 5 FROM sentinel WHERE fired),
alerts AS (
  SELECT *, CASE severity WHEN 'action' THEN 0 WHEN 'watch' THEN 1 WHEN 'info' THEN 2 ELSE 3 END AS severity_rank,
         'ALERT-' || substr(kind, 1, 4) || '-' || substr(sha256(kind || '|' || coalesce(group_id, '') || '|' || coalesce(code, '')), 1, 12) AS alert_id
  FROM every)"""
_GRAPH_SQL = f"""{MEMBERS_SQL},
vs AS (SELECT 'R' || r_regionkey AS id, 'Region' AS type, r_name AS label FROM region UNION ALL SELECT 'N' || n_nationkey, 'Group', n_name FROM nation UNION ALL SELECT ref, 'Member', kind FROM members),
es AS (SELECT 'N' || n_nationkey AS source, 'R' || n_regionkey AS target, 'LOCATED_IN' AS kind FROM nation UNION ALL SELECT ref, 'N' || group_id, 'LIVES_IN' FROM members UNION ALL SELECT 'C' || o_custkey, 'P' || substr(o_orderpriority, 1, 1), 'HAS_PRIORITY' FROM orders)"""

#: Sorts and sums over all cases.
_BY_CASE = (cross_kind_clusters, cluster_secondaries, at_risk_members, at_risk_counts, at_risk_asked, prophylactic_groups, region_rule_join, alerts_ranked, worst_per_group)
CASE_TABLES = ("lineitem", "orders")
QUERIES = {f.__name__: plain(f) for f in (graph_stats, graph_export, graph_hops, vector_anomaly, sentinel_cases, noised_counts, member_kinds)} | {f.__name__: plain(small_tasks(*CASE_TABLES)(f)) for f in _BY_CASE}
ORACLES = {
    "cross_kind_clusters": f"WITH {_CLUSTERS_SQL} SELECT * FROM clusters",
    "cluster_secondaries": f"""WITH {_CLUSTERS_SQL},
again AS (SELECT p.*, row_number() OVER (PARTITION BY group_id, code ORDER BY onset NULLS FIRST, CASE WHEN p.kind = k.index_kind THEN 0 ELSE 1 END, ref, case_id) - 1 AS ordinal FROM placed p JOIN clusters k USING (group_id, code))
SELECT group_id, code, count(*) AS n_secondary, min(onset) AS first_onset, max(onset) AS last_onset, CAST(sum(ordinal * case_id) AS BIGINT) AS check_sum FROM again WHERE ordinal > 0 GROUP BY 1, 2""",
    "at_risk_members": f"""WITH {MEMBERS_SQL}, {cases_sql(False)},
seen AS (SELECT DISTINCT group_id, code, ref FROM cases JOIN members USING (ref))
SELECT s.group_id, s.code, m.ref FROM (SELECT DISTINCT group_id, code FROM seen) s JOIN members m USING (group_id)
WHERE NOT EXISTS (SELECT 1 FROM seen x WHERE x.group_id = s.group_id AND x.code = s.code AND x.ref = m.ref)""",
    "at_risk_counts": f"""WITH {MEMBERS_SQL}, {cases_sql()}, s AS (SELECT group_id, count(DISTINCT ref) AS n FROM members GROUP BY 1), d AS (SELECT group_id, code, count(DISTINCT ref) AS n_diagnosed FROM cases JOIN members USING (ref) GROUP BY 1, 2)
SELECT group_id, code, n_diagnosed, n - n_diagnosed AS n_at_risk FROM d JOIN s USING (group_id)""",
    "at_risk_asked": f"""WITH {MEMBERS_SQL}, {cases_sql(False)}, a(group_id, code) AS (VALUES ('3', 'Brand#11'), ('7', 'Brand#22')), seen AS (SELECT DISTINCT group_id, code, ref FROM cases JOIN members USING (ref) JOIN a USING (group_id, code))
SELECT s.group_id, s.code, m.ref FROM (SELECT DISTINCT group_id, code FROM seen) s JOIN members m USING (group_id) WHERE NOT EXISTS (SELECT 1 FROM seen x WHERE x.group_id = s.group_id AND x.code = s.code AND x.ref = m.ref)""",
    "prophylactic_groups": f"WITH {_CLUSTERS_SQL}, {_RISK_SQL} SELECT * FROM risk",
    "graph_stats": f"""WITH {_GRAPH_SQL},
ends AS (SELECT source AS id FROM es UNION SELECT target FROM es)
SELECT 'vertex' AS what, type AS name, count(*) AS n FROM vs GROUP BY 2
UNION ALL SELECT 'vertex', 'Unknown', count(*) FROM ends WHERE id NOT IN (SELECT id FROM vs) HAVING count(*) > 0
UNION ALL SELECT 'edge', kind, count(*) FROM es GROUP BY 2""",
    "graph_export": f"""WITH {_GRAPH_SQL}
SELECT 'node' AS what, '{{"id":"' || id || '","type":"' || type || '","label":"' || label || '"}}' AS row FROM vs
UNION ALL SELECT 'link', '{{"source":"' || source || '","target":"' || target || '","kind":"' || kind || '"}}' FROM es""",
    "graph_hops": f"""WITH {_GRAPH_SQL}
SELECT b.target AS region, v.label, count(*) AS n FROM vs v JOIN es a ON a.source = v.id AND a.kind = 'LIVES_IN' JOIN es b ON b.source = a.target AND b.kind = 'LOCATED_IN' WHERE v.type = 'Member' GROUP BY 1, 2""",
    "region_rule_join": f"""WITH {MEMBERS_SQL}, {cases_sql(False)}, rules(code, level) AS (VALUES {", ".join(f"('{c}', '{r}')" for c, r in RULES)})
SELECT m.group_id, c.code, u.level, count(*) AS n, min(c.onset) AS first_onset FROM cases c JOIN members m USING (ref) JOIN nation ON CAST(n_nationkey AS VARCHAR) = m.group_id
JOIN region ON r_regionkey = n_regionkey JOIN rules u ON u.code = c.code AND u.level = r_name GROUP BY 1, 2, 3""",
    "vector_anomaly": f"""WITH {DAILY_SQL},
placed AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day DESC) AS rn FROM daily),
sums AS (SELECT event_type, count(*) AS n, avg(n) FILTER (rn <= 4) AS last_mean, avg(n) FILTER (rn > 4) AS rest_mean, stddev_samp(n) FILTER (rn > 4) AS rest_sd, CAST(sum(n) FILTER (rn <= 4) AS BIGINT) AS last_total FROM placed GROUP BY 1),
zs AS (SELECT *, CASE WHEN n >= 8 THEN (last_mean - rest_mean) / nullif(rest_sd, 0) END AS z FROM sums)
SELECT event_type, n, round(last_mean, 6) AS last_mean, round(rest_mean, 6) AS rest_mean, round(rest_sd, 6) AS rest_sd, last_total, round(z, 6) AS z, coalesce(z >= 2.5, false) AS fired,
       CASE WHEN coalesce(z >= 2.5, false) THEN CASE WHEN z >= 4 THEN 'action' ELSE 'watch' END END AS severity,
       CASE WHEN coalesce(z >= 2.5, false) THEN round(least(0.99, 0.6 + 0.05 * z), 6) END AS confidence FROM zs""",
    "sentinel_cases": f"WITH {_SENTINEL_SQL} SELECT * FROM sentinel",
    "alerts_ranked": f"""WITH {_ALERTS_SQL} SELECT * FROM alerts""",
    "worst_per_group": f"WITH {_ALERTS_SQL} SELECT group_id, min_by(severity, severity_rank) AS severity, count(*) AS n_alerts FROM alerts GROUP BY 1",
    "noised_counts": f"""WITH {DAILY_SQL},
u AS (SELECT *, (CAST(CAST('0x' || substr(md5(event_type || '|' || day || '|7'), 1, 12) AS BIGINT) AS DOUBLE) + 0.5) / CAST(281474976710656 AS DOUBLE) - 0.5 AS u FROM daily)
SELECT event_type, day, n, greatest(0, CAST(round_even(n - sign(u) * ln(1 - 2 * abs(u)), 0) AS BIGINT)) AS noised_count FROM u""",
    "member_kinds": f"WITH {MEMBERS_SQL} SELECT group_id, count(*) AS n_members, count(DISTINCT kind) AS n_kinds, max(CASE WHEN kind = 'supplier' THEN 1 ELSE 0 END) AS has_supplier FROM members GROUP BY 1",
}
for _name, _columns in {"cross_kind_clusters": ("index_onset",), "cluster_secondaries": ("first_onset", "last_onset"), "region_rule_join": ("first_onset",), "sentinel_cases": ("month",), "noised_counts": ("day",)}.items():
    ORACLES[_name] = dated(ORACLES[_name], *_columns)
