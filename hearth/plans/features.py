"""Labels, features, contact tracing and lead time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth.operators import features, trace
from hearth.plans import dated, plain
from hearth.plans.views import MEMBERS_SQL, MONTHLY_SQL, members, monthly_orders, read


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("group_id"))
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("date"), "o_orderpriority", "o_totalprice")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("event_id"), "group_id", F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("ref"), "date", F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("price"))


ORDERS_SQL = "ev AS (SELECT o_orderkey AS event_id, CAST(c_nationkey AS VARCHAR) AS group_id, 'C' || o_custkey AS ref, CAST(o_orderdate AS DATE) AS date, o_orderpriority AS priority, o_totalprice AS price FROM orders JOIN customer ON o_custkey = c_custkey)"
#: Index groups with their dates, for labels, tracing and lead time.
INDICES = [("0", "1996-03-15", "C1", "airborne"), ("3", "1997-06-01", "C3", "vector"), ("7", "1995-10-20", "C7", "contact"), ("12", "1998-01-10", "C12", "food"), ("21", "1999-05-05", "C21", "airborne")]
INDICES_SQL = "idx(group_id, index_date, ref, route) AS (VALUES " + ", ".join(f"('{g}', DATE '{d}', '{r}', '{t}')" for g, d, r, t in INDICES) + ")"


def _indices(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(INDICES, "group_id string, index_date string, ref string, route string")
    return rows.withColumn("index_date", F.to_date("index_date")).withColumn("index_id", F.concat(F.lit("I"), "group_id"))


def trailing_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", F.to_date("ts").alias("day"))
    return features.trailing(e, "user_id", "day", [7, 30], {"types": F.col("event_type")}).select("event_id", "n_7d", "n_30d", "types_7d", "types_30d")


def group_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.daily_trailing(_orders(spark, sf_dir).select("event_id", "group_id", "date"), "group_id", "date", [30, 90])


def other_member_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir)
    return features.others_recent(o, o.withColumnRenamed("priority", "code"), 90).select("event_id", "n_other_cases", "n_other_codes")


def label_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.labelled(_orders(spark, sf_dir), _indices(spark).select("group_id", "index_date"), 60, ["urgent", "high"], F.col("group_id") == "5", ("1996-01-01", "1997-12-31"), F.col("priority"))
    return rows.select("event_id", "label", "reason")


def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir)
    rows = features.temporal(o, F.col("date"))
    rows = features.keyword_flags(rows, F.col("priority"), {"kw_urgent": ["urgent"], "kw_low": ["low", "not spec"]})
    rows = features.measurement_flags(rows, {"price_high": ("price", 200000.0, None), "price_low": ("price", 0.0, 20000.0)})
    activity = features.daily_trailing(o.select("event_id", "group_id", "date"), "group_id", "date", [30]).select("event_id", "n_30d")
    anomaly = features.region_anomaly(monthly_orders(spark, sf_dir).withColumnRenamed("nation", "group_id"), "group_id", "n").select("group_id", F.col("total").alias("region_total"), F.round("z", 6).alias("region_z"))
    out = features.assembled(rows, [(activity, "event_id"), (anomaly, "group_id")])
    return out.select("event_id", "month", "is_summer", "is_monsoon", "day_of_year", "kw_urgent", "kw_low", "price_high", "price_low", "n_30d", "region_total", "region_z")


def contact_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("group_id"), F.col("n_regionkey").alias("region_id"))
    found = trace.contacts(_indices(spark), members(spark, sf_dir), groups, ["airborne", "vector"])
    return found.groupBy("index_id", "tier", "group_id").agg(F.count("*").alias("n"), F.min("ref").alias("first_ref"))


def next_event_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _orders(spark, sf_dir)
    asks = members(spark, sf_dir).where("kind = 'customer'").select("ref", "group_id").join(_indices(spark).select("group_id", "index_date"), "group_id")
    return trace.next_event(asks, o.select("ref", "date", "event_id"), "ref", "index_date", "date", "event_id")


def contact_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = next_event_asof(spark, sf_dir).withColumn("tier", F.when(F.col("group_id").isin("0", "3"), 1).otherwise(2))
    model = _orders(spark, sf_dir).where("price > 150000").select("event_id", F.least(F.lit(1.0), F.col("price") / 500000).alias("probability"))
    return trace.scored(rows, model, {1: 0.45, 2: 0.18, 3: 0.10}, 0.05, [(0.5, "call"), (0.2, "visit"), (0.05, "watch")], "none").select("ref", "tier", "next_id", F.round("risk", 6).alias("risk"), "action")


def best_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    confirmed = _indices(spark).select("group_id", F.col("index_date").alias("confirmed"))
    o = _orders(spark, sf_dir)
    monthly = monthly_orders(spark, sf_dir).select(F.col("nation").alias("group_id"), "month", "n")
    signals = [
        trace.earliest_in_window(o, confirmed, "group_id", "date", 90, "model", F.col("price") > 250000),
        trace.earliest_in_window(o, confirmed, "group_id", "date", 90, "pattern", F.lower("priority").contains("urgent")),
        trace.series_signal(monthly, confirmed, "group_id", "month", "n", 1.5, "series"),
    ]
    return trace.best_signal(confirmed, signals, "group_id")


def lead_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.lead_summary(best_signal(spark, sf_dir))


_NEXT_SQL = f"""{MEMBERS_SQL}, {ORDERS_SQL}, {INDICES_SQL},
asks AS (SELECT m.ref, m.group_id, i.index_date FROM members m JOIN idx i USING (group_id) WHERE m.kind = 'customer'),
nexts AS (
  SELECT a.ref, a.group_id, a.index_date, min(e.date) AS next_date, min_by(e.event_id, (e.date, e.event_id)) AS next_id
  FROM asks a LEFT JOIN ev e ON e.ref = a.ref AND e.date >= a.index_date GROUP BY 1, 2, 3)"""
_BEST_SQL = f"""{ORDERS_SQL}, {MONTHLY_SQL}, {INDICES_SQL},
z AS (SELECT nation AS group_id, month, (n - avg(n) OVER w) / coalesce(nullif(stddev_pop(n) OVER w, 0), 1) AS z, count(*) OVER w AS k FROM monthly WINDOW w AS (PARTITION BY nation)),
signals AS (
  SELECT i.group_id, 'model' AS signal, min(date) AS earliest, 0 AS ord FROM ev JOIN idx i USING (group_id) WHERE price > 250000 AND date < index_date AND date >= index_date - 90 GROUP BY 1
  UNION ALL SELECT i.group_id, 'pattern', min(date), 1 FROM ev JOIN idx i USING (group_id) WHERE lower(priority) LIKE '%urgent%' AND date < index_date AND date >= index_date - 90 GROUP BY 1
  UNION ALL SELECT i.group_id, 'series', min(month), 2 FROM z JOIN idx i USING (group_id) WHERE z > 1.5 AND k >= 4 AND month < index_date GROUP BY 1),
led AS (SELECT s.*, index_date - CAST(earliest AS DATE) AS lead, row_number() OVER (PARTITION BY group_id ORDER BY index_date - CAST(earliest AS DATE) DESC, ord) AS rn, count(*) OVER (PARTITION BY group_id) AS k FROM signals s JOIN idx USING (group_id)),
best AS (SELECT i.group_id, i.index_date AS confirmed, signal, CAST(earliest AS DATE) AS earliest, CAST(lead AS INTEGER) AS lead_days, coalesce(k, 0) AS n_signals FROM idx i LEFT JOIN led ON led.group_id = i.group_id AND rn = 1)"""

QUERIES = {f.__name__: plain(f) for f in (trailing_activity, group_activity, other_member_recent, label_rules, feature_matrix, contact_tiers, next_event_asof, contact_scores, best_signal, lead_summary)}
ORACLES = {
    "trailing_activity": """WITH e AS (SELECT event_id, user_id, event_type, CAST(ts AS DATE) - DATE '1970-01-01' AS d FROM events),
daily AS (SELECT user_id, d, count(*) AS n, list(DISTINCT event_type) AS types FROM e GROUP BY 1, 2),
w AS (SELECT a.user_id, a.d, coalesce(sum(b.n) FILTER (b.d >= a.d - 7), 0) AS n7, coalesce(sum(b.n), 0) AS n30, len(list_distinct(flatten(coalesce(list(b.types) FILTER (b.d >= a.d - 7), [])))) AS t7, len(list_distinct(flatten(coalesce(list(b.types) FILTER (b.d IS NOT NULL), [])))) AS t30
      FROM daily a LEFT JOIN daily b ON b.user_id = a.user_id AND b.d BETWEEN a.d - 30 AND a.d - 1 GROUP BY 1, 2)
SELECT event_id, CAST(n7 AS BIGINT) AS n_7d, CAST(n30 AS BIGINT) AS n_30d, CAST(t7 AS INTEGER) AS types_7d, CAST(t30 AS INTEGER) AS types_30d FROM e JOIN w USING (user_id, d)""",
    "group_activity": f"""WITH {ORDERS_SQL}, daily AS (SELECT group_id, date, count(*) AS n FROM ev GROUP BY 1, 2),
w AS (SELECT a.group_id, a.date, CAST(coalesce(sum(b.n) FILTER (b.date >= a.date - 30), 0) AS BIGINT) AS n_30d, CAST(coalesce(sum(b.n), 0) AS BIGINT) AS n_90d FROM daily a LEFT JOIN daily b ON a.group_id = b.group_id AND b.date BETWEEN a.date - 90 AND a.date - 1 GROUP BY 1, 2)
SELECT event_id, group_id, date, n_30d, n_90d FROM ev JOIN w USING (group_id, date)""",
    "other_member_recent": f"""WITH {ORDERS_SQL}
SELECT e.event_id, count(u.ref) AS n_other_cases, count(DISTINCT u.priority) AS n_other_codes FROM ev e LEFT JOIN ev u ON u.group_id = e.group_id AND u.ref <> e.ref AND e.date - u.date BETWEEN 0 AND 90 GROUP BY 1""",
    "label_rules": f"""WITH {ORDERS_SQL}, {INDICES_SQL},
r AS (SELECT event_id, CASE WHEN coalesce(abs(date - index_date) <= 60, false) THEN 'index_group' WHEN ev.group_id = '5' AND date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31' AND (lower(priority) LIKE '%urgent%' OR lower(priority) LIKE '%high%') THEN 'region_keyword' ELSE 'none' END AS reason
      FROM ev LEFT JOIN idx ON idx.group_id = ev.group_id)
SELECT event_id, CAST(reason <> 'none' AS INTEGER) AS label, reason FROM r""",
    "feature_matrix": f"""WITH {ORDERS_SQL}, {MONTHLY_SQL}, daily AS (SELECT group_id, date, count(*) AS n FROM ev GROUP BY 1, 2),
w AS (SELECT a.group_id, a.date, CAST(coalesce(sum(b.n), 0) AS BIGINT) AS n_30d FROM daily a LEFT JOIN daily b ON a.group_id = b.group_id AND b.date BETWEEN a.date - 30 AND a.date - 1 GROUP BY 1, 2),
r AS (SELECT nation AS group_id, CAST(sum(n) AS BIGINT) AS region_total, round((max(n) - avg(n)) / coalesce(nullif(stddev_pop(n), 0), 1), 6) AS region_z FROM monthly GROUP BY 1)
SELECT event_id, CAST(month(date) AS INTEGER) AS month, CAST(month(date) BETWEEN 6 AND 8 AS INTEGER) AS is_summer, CAST(month(date) BETWEEN 7 AND 9 AS INTEGER) AS is_monsoon, CAST(dayofyear(date) AS INTEGER) AS day_of_year,
       CAST(lower(priority) LIKE '%urgent%' AS INTEGER) AS kw_urgent, CAST(lower(priority) LIKE '%low%' OR lower(priority) LIKE '%not spec%' AS INTEGER) AS kw_low, CAST(price > 200000 AS INTEGER) AS price_high, CAST(price > 0 AND price < 20000 AS INTEGER) AS price_low, n_30d, region_total, region_z
FROM ev JOIN w USING (group_id, date) JOIN r USING (group_id)""",
    "contact_tiers": f"""WITH {MEMBERS_SQL}, {INDICES_SQL}
SELECT 'I' || i.group_id AS index_id, 1 AS tier, m.group_id, count(*) AS n, min(m.ref) AS first_ref FROM idx i JOIN members m USING (group_id) GROUP BY 1, 3
UNION ALL SELECT 'I' || i.group_id, 2, m.group_id, count(*), min(m.ref) FROM idx i JOIN nation a ON CAST(a.n_nationkey AS VARCHAR) = i.group_id JOIN nation b ON b.n_regionkey = a.n_regionkey AND b.n_nationkey <> a.n_nationkey JOIN members m ON m.group_id = CAST(b.n_nationkey AS VARCHAR)
WHERE i.route IN ('airborne', 'vector') GROUP BY 1, 3""",
    "next_event_asof": f"WITH {_NEXT_SQL} SELECT ref, group_id, index_date, next_date, next_id, CAST(next_date - index_date AS INTEGER) AS days_until FROM nexts",
    "contact_scores": f"""WITH {_NEXT_SQL},
s AS (SELECT n.ref, CASE WHEN n.group_id IN ('0', '3') THEN 1 ELSE 2 END AS tier, next_id, CASE WHEN e.price IS NOT NULL THEN least(1.0, e.price / 500000) END AS p FROM nexts n LEFT JOIN ev e ON e.event_id = n.next_id AND e.price > 150000),
k AS (SELECT *, coalesce(p, CASE tier WHEN 1 THEN 0.45 ELSE 0.18 END) AS x FROM s)
SELECT ref, tier, next_id, round(CAST(x AS DOUBLE), 6) AS risk, CASE WHEN x >= 0.5 THEN 'call' WHEN x >= 0.2 THEN 'visit' WHEN x >= 0.05 THEN 'watch' ELSE 'none' END AS action FROM k""",
    "best_signal": f"WITH {_BEST_SQL} SELECT * FROM best",
    "lead_summary": f"WITH {_BEST_SQL} SELECT count(*) AS n, count(lead_days) AS n_with_signal, avg(lead_days) AS mean_lead, median(lead_days) AS median_lead, min(lead_days) AS min_lead, max(lead_days) AS max_lead FROM best",
}
for _name, _columns in {"group_activity": ("date",), "next_event_asof": ("index_date", "next_date"), "best_signal": ("confirmed", "earliest")}.items():
    ORACLES[_name] = dated(ORACLES[_name], *_columns)
