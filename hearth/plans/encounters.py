"""The full feature matrix, all five detectors, tracing evaluation and the cross-kind lead signal over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth.operators import detect, encounters, trace
from hearth.plans import plain, small_tasks
from hearth.plans import features as feature_plans
from hearth.plans import surveillance as s
from hearth.plans.features import INDICES_SQL, ORDERS_SQL
from hearth.plans.views import DAILY_SQL, MEMBERS_SQL, MONTHLY_SQL, cases, cases_sql, daily_events, members, monthly_orders, read

COMPLAINTS = ["Cough and fever", "Headache", "Vomiting after lunch", "Rash on arm", "Joint pain, fatigue", "Tick bite", "Valley fever follow-up"]
SPECIES = ["dog", "cat", "horse", "parrot", "snake", "goat", "chicken", "fish"]
GENDERS = ["female", "male", "F", "other"]
LEVELS = ["high", "medium", "low"]
YEARS, VECTOR_Z = (1998, 1997), 0.3
THRESHOLDS = [0.05, 0.1, 0.2, 0.3, 0.5]


def _pick(values: list[str], by) -> F.Column:
    return F.try_element_at(F.array(*map(F.lit, values)), by.cast("int") + 1)


def _encounters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as encounters: every fourth is one of an animal; measurements and complaints from the key, some missing."""
    k = F.col("o_orderkey")

    def unless(n: int, value) -> F.Column:
        return F.when(k % n != 0, value)

    c = read(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("string").alias("group_id"))
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate").join(c, F.col("o_custkey") == F.col("c_custkey"))
    bp = F.when(k % 5 == 1, "unknown").otherwise(unless(5, F.concat((100 + k % 60).cast("string"), F.lit(" / "), (60 + k % 30).cast("string"))))
    vitals = F.struct(bp.alias("bp"), unless(7, 97 + (k % 60) / 10).alias("temp_f"), unless(6, 55 + k % 80).alias("hr"), unless(8, 10 + k % 20).alias("rr"), unless(9, 88 + k % 12).alias("spo2"), unless(3, 70 + k % 100).alias("glucose"))
    animal = k % 4 == 0
    ref = F.when(animal, F.concat(F.lit("S"), (1 + k % 10).cast("string"))).otherwise(F.concat(F.lit("C"), F.col("o_custkey").cast("string")))
    return o.select(k.alias("event_id"), "group_id", ref.alias("ref"), F.when(animal, "Animal").otherwise("Person").alias("kind"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("start"), vitals.alias("vitals"), _pick(COMPLAINTS, k % 8).alias("complaint"))


def _members(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, a = F.col("c_custkey"), F.col("s_suppkey")

    def born(base: str, days) -> F.Column:
        return F.date_add(F.lit(base).cast("date"), days.cast("int")).cast("string")

    people = read(spark, sf_dir, "customer").select(F.concat(F.lit("C"), c.cast("string")).alias("ref"), F.col("c_nationkey").cast("string").alias("group_id"), F.lit("Person").alias("kind"), F.when(c % 10 != 0, born("1940-01-01", c * 37 % 20000)).alias("birth"), _pick(GENDERS, c % 4).alias("gender"), F.lit(None).cast("string").alias("species"))
    animals = read(spark, sf_dir, "supplier").select(F.concat(F.lit("S"), a.cast("string")).alias("ref"), F.col("s_nationkey").cast("string").alias("group_id"), F.lit("Animal").alias("kind"), born("1985-01-01", a % 2000).alias("birth"), F.when(a % 2 == 0, "FS").otherwise("MN").alias("gender"), _pick(SPECIES, a % 8).alias("species"))
    return people.unionByName(animals)


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_nationkey")
    return read(spark, sf_dir, "nation").select(n.cast("string").alias("group_id"), (n * 20000).alias("population"), (n / 10 - 1).alias("eqi"), _pick(LEVELS, n % 4).alias("endemic"), F.when(n == 7, "Apache").otherwise(F.col("n_name")).alias("name"), (n * 1.5).alias("lat"), ((n + 1) * -2.0).alias("lon"))


def encounter_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """51 features of every encounter."""
    monthly = monthly_orders(spark, sf_dir).withColumnRenamed("nation", "group_id")
    disease = monthly.select("group_id", F.year("month").alias("year"), F.month("month").alias("month"), "n")
    onsets = feature_plans._orders(spark, sf_dir).select("group_id", "ref", F.col("priority").alias("code"), F.col("date").alias("onset"))
    found = encounters.matrix(_encounters(spark, sf_dir), _members(spark, sf_dir), _regions(spark, sf_dir), onsets, disease, monthly.select("group_id", F.col("month").alias("period"), F.col("n").alias("value")), *YEARS, VECTOR_Z)
    return found.withColumns({c: F.round(c, 6) for c in ("age_years", "v_temp_f", "co_epa_eqi", "surv_z_score")}).withColumns({c: F.col(c).cast("int") for c in ("month", "day_of_year")}).drop("start")


def alerts_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alerts of all five detectors in one ranking."""
    clusters, risk, sentinel = s._alerts(spark, sf_dir)
    vector = detect.as_alerts(s.vector_anomaly(spark, sf_dir).where("fired"), "VECTOR_ANOMALY", 3, F.col("severity"), F.col("confidence"), F.concat(F.lit("last "), F.col("last_total").cast("string")), F.col("last_total"), "event_type")
    rules = detect.as_alerts(s.region_rule_join(spark, sf_dir), "REGION_RULE", 4, F.lit("info"), F.lit(0.78), F.col("level"), F.col("n"), code=F.col("code"))
    return detect.ranked(clusters, risk, vector, rules, sentinel)


def alerts_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All alerts under dense numbers in the order of their ranking."""
    return detect.numbered(alerts_all(spark, sf_dir), "natural_id").drop("severity_rank")


def _traced(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Tier-1 contacts with their next event and its risk, and labelled positives, of the index groups."""
    indices = feature_plans._indices(spark).select("index_id", "group_id", "index_date")
    found = feature_plans.next_event_asof(spark, sf_dir).select("ref", "group_id", "next_id").join(indices.select("index_id", "group_id"), "group_id")
    contacts = found.select("index_id", F.lit(1).alias("tier"), "ref", "next_id", F.coalesce((F.col("next_id") % 97) / 97, F.lit(0.02)).alias("risk"))
    orders = feature_plans._orders(spark, sf_dir)
    labels = orders.select("event_id", "group_id", "date", (F.col("price") > 200000).cast("int").alias("label"))
    return contacts, trace.index_positives(labels, indices)


def tracing_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = trace.traced_curve(*_traced(spark, sf_dir), THRESHOLDS)
    return found.withColumns({c: F.round(c, 6) for c in ("mean_lead", "sensitivity", "precision", "f1")})


def tracing_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.traced_by_index(*_traced(spark, sf_dir))


def contact_strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    strata = feature_plans._indices(spark).select("index_id", F.when(F.col("group_id").cast("int") < 5, "rural").otherwise("urban").alias("rural_urban"), "route")
    return trace.contacts_by_stratum(_traced(spark, sf_dir)[0], strata, ["rural_urban", "route"])


def cross_kind_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first supplier case of a code in an index group before its confirmation."""
    confirmed = feature_plans._indices(spark).select("group_id", F.col("index_date").alias("confirmed"), F.concat(F.lit("Brand#1"), (F.col("group_id").cast("int") % 5 + 1).cast("string")).alias("code"))
    joined = cases(spark, sf_dir, False).join(members(spark, sf_dir), "ref")
    return trace.earliest_before(joined, confirmed, ["group_id", "code"], "onset", "cross_kind", F.col("kind") == "supplier")


def _case(by: str, values: list[str], n: int | None = None) -> str:
    return f"CASE {by} % {n or len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


_CC = {name: words for name, words in encounters.COMPLAINTS.items()}
_FLAGS = ", ".join(f"CAST({' OR '.join(f'''coalesce(contains(lower(complaint), '{w}'), false)''' for w in words)} AS INTEGER) AS cc_{name}" for name, words in _CC.items())
_SPECIES_FLAGS = ", ".join(f"CAST(max(CASE WHEN species IN ({', '.join(f'''{chr(39)}{c}{chr(39)}''' for c in codes)}) THEN 1 ELSE 0 END) AS INTEGER) AS hh_has_{name}" for name, codes in encounters.SPECIES.items())
_FEATURES_SQL = f"""WITH {ORDERS_SQL}, {MONTHLY_SQL},
e AS (SELECT event_id, group_id, event_id % 4 = 0 AS animal, CASE WHEN event_id % 4 = 0 THEN 'S' || (1 + event_id % 10) ELSE ref END AS ref, date, event_id AS k, {_case('event_id', COMPLAINTS, 8)} AS complaint FROM ev),
who AS (SELECT 'C' || c_custkey AS ref, CAST(c_nationkey AS VARCHAR) AS group_id, true AS person, CASE WHEN c_custkey % 10 <> 0 THEN DATE '1940-01-01' + CAST(c_custkey * 37 % 20000 AS INTEGER) END AS birth, {_case('c_custkey', GENDERS)} AS gender, NULL AS species FROM customer
  UNION ALL SELECT 'S' || s_suppkey, CAST(s_nationkey AS VARCHAR), false, DATE '1985-01-01' + CAST(s_suppkey % 2000 AS INTEGER), CASE WHEN s_suppkey % 2 = 0 THEN 'FS' ELSE 'MN' END, {_case('s_suppkey', SPECIES)} FROM supplier),
hh AS (SELECT group_id, count(*) FILTER (person) AS hh_n_humans, count(*) FILTER (NOT person) AS hh_n_animals, {_SPECIES_FLAGS} FROM who GROUP BY 1),
co AS (SELECT CAST(n_nationkey AS VARCHAR) AS group_id, CAST(n_nationkey * 20000 AS DOUBLE) AS co_population, round(n_nationkey / 10 - 1, 6) AS co_epa_eqi, CAST(n_nationkey % 4 = 0 AS INTEGER) AS co_cocci_high, CAST(n_nationkey % 4 = 1 AS INTEGER) AS co_cocci_med,
  CAST(n_nationkey * 20000 < 100000 AS INTEGER) AS co_is_rural, CAST(n_nationkey = 7 AS INTEGER) AS co_is_tribal, CAST(n_nationkey * 1.5 AS DOUBLE) AS co_lat, CAST((n_nationkey + 1) * -2.0 AS DOUBLE) AS co_lon FROM nation),
days AS (SELECT group_id, date, count(*) AS n, list(DISTINCT ref) AS refs, list(DISTINCT lower(coalesce(complaint, ''))) AS ccs FROM e GROUP BY 1, 2),
act AS (SELECT a.group_id, a.date, CAST(coalesce(sum(b.n) FILTER (b.date >= a.date - 30), 0) AS BIGINT) AS hh_enc_30d, CAST(coalesce(sum(b.n), 0) AS BIGINT) AS hh_enc_90d, CAST(len(list_distinct(flatten(list(b.refs)))) AS BIGINT) AS s90, CAST(len(list_distinct(flatten(list(b.ccs)))) AS BIGINT) AS c90
  FROM days a LEFT JOIN days b ON b.group_id = a.group_id AND b.date BETWEEN a.date - 90 AND a.date - 1 GROUP BY 1, 2),
oth AS (SELECT e.event_id, CAST(count(u.ref) > 0 AS INTEGER) AS hh_other_species_cond_90d, count(DISTINCT u.priority) AS hh_distinct_codes_90d FROM e LEFT JOIN ev u ON u.group_id = e.group_id AND u.ref <> e.ref AND e.date - u.date BETWEEN 0 AND 90 GROUP BY 1),
dis AS (SELECT nation AS group_id, CAST(coalesce(sum(n) FILTER (year(month) >= {YEARS[0]}), 0) AS DOUBLE) AS surv_recent_cases, round((max(n) FILTER (year(month) >= {YEARS[1]}) - avg(n) FILTER (year(month) >= {YEARS[1]})) / coalesce(nullif(stddev_pop(n) FILTER (year(month) >= {YEARS[1]}), 0), 1), 6) AS surv_z_score FROM monthly GROUP BY 1),
rk AS (SELECT *, row_number() OVER (PARTITION BY nation ORDER BY month DESC) AS rn FROM monthly),
vec AS (SELECT nation AS group_id, CAST(count(*) >= 4 AND (avg(n) FILTER (rn <= 4) - avg(n)) / coalesce(nullif(stddev_pop(n), 0), 1) > {VECTOR_Z} AS INTEGER) AS surv_vector_anomaly FROM rk GROUP BY 1)
SELECT e.event_id, e.group_id, e.ref, CAST(animal AS INTEGER) AS is_animal, round((e.date - birth) / 365.25, 6) AS age_years, CAST(coalesce(lower(gender) LIKE 'f%', false) AS INTEGER) AS sex_female,
  round(CASE WHEN k % 7 <> 0 THEN 97 + (k % 60) / 10 END, 6) AS v_temp_f, CAST(CASE WHEN k % 6 <> 0 THEN 55 + k % 80 END AS DOUBLE) AS v_hr, CAST(CASE WHEN k % 8 <> 0 THEN 10 + k % 20 END AS DOUBLE) AS v_rr, CAST(CASE WHEN k % 9 <> 0 THEN 88 + k % 12 END AS DOUBLE) AS v_spo2,
  CAST(CASE WHEN k % 5 > 1 THEN 100 + k % 60 END AS DOUBLE) AS v_bp_sys, CAST(CASE WHEN k % 5 > 1 THEN 60 + k % 30 END AS DOUBLE) AS v_bp_dia, CAST(CASE WHEN k % 3 <> 0 THEN 70 + k % 100 END AS DOUBLE) AS v_glucose,
  CAST(k % 7 <> 0 AND 970 + k % 60 > 1004 AS INTEGER) AS v_fever, CAST(k % 6 <> 0 AND 55 + k % 80 > 100 AS INTEGER) AS v_tachy, CAST(k % 8 <> 0 AND 10 + k % 20 > 20 AS INTEGER) AS v_tachypnea, CAST(k % 9 <> 0 AND 88 + k % 12 < 94 AS INTEGER) AS v_hypoxia,
  {_FLAGS}, hh_n_humans, hh_n_animals, {', '.join(f'hh_has_{n}' for n in encounters.SPECIES)}, co_population, co_epa_eqi, co_cocci_high, co_cocci_med, co_is_rural, co_is_tribal, co_lat, co_lon,
  hh_enc_30d, hh_enc_90d, coalesce(s90, 0) AS hh_distinct_subjects_90d, coalesce(c90, 0) AS hh_distinct_cc_90d, hh_other_species_cond_90d, hh_distinct_codes_90d, coalesce(surv_z_score, 0) AS surv_z_score, surv_vector_anomaly, surv_recent_cases,
  CAST(month(e.date) AS INTEGER) AS month, CAST(month(e.date) BETWEEN 6 AND 8 AS INTEGER) AS is_summer, CAST(month(e.date) BETWEEN 7 AND 9 AS INTEGER) AS is_monsoon, CAST(dayofyear(e.date) AS INTEGER) AS day_of_year
FROM e LEFT JOIN who ON who.ref = e.ref JOIN hh ON hh.group_id = e.group_id LEFT JOIN co ON co.group_id = e.group_id JOIN act ON act.group_id = e.group_id AND act.date = e.date JOIN oth USING (event_id) LEFT JOIN dis ON dis.group_id = e.group_id LEFT JOIN vec ON vec.group_id = e.group_id"""
_TRACE_SQL = f"""{feature_plans._NEXT_SQL},
contacts AS (SELECT 'I' || group_id AS index_id, ref, next_id, coalesce((next_id % 97) / 97, 0.02) AS risk FROM nexts),
pos AS (SELECT 'I' || i.group_id AS index_id, event_id, e.date - i.index_date AS lead FROM ev e JOIN idx i USING (group_id) WHERE price > 200000 AND e.date <> i.index_date)"""
_VECTOR_SQL = f"""{DAILY_SQL},
vr AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day DESC) AS rn FROM daily),
vs AS (SELECT event_type, count(*) AS k, avg(n) FILTER (rn <= 4) AS l, avg(n) FILTER (rn > 4) AS r, stddev_samp(n) FILTER (rn > 4) AS sd, CAST(sum(n) FILTER (rn <= 4) AS BIGINT) AS total FROM vr GROUP BY 1),
vz AS (SELECT *, round((l - r) / nullif(sd, 0), 6) AS z FROM vs WHERE k >= 8)"""

QUERIES = {f.__name__: plain(f) for f in (encounter_features, tracing_curve, tracing_by_index, contact_strata, cross_kind_signal)} | {f.__name__: plain(small_tasks(*s.CASE_TABLES)(f)) for f in (alerts_all, alerts_numbered)}
ORACLES = {
    "encounter_features": _FEATURES_SQL,
    "alerts_all": f"""WITH {s._ALERTS_SQL}, {_VECTOR_SQL}, rules(code, level) AS (VALUES {", ".join(f"('{c}', '{r}')" for c, r in s.RULES)}),
brands AS (SELECT 'C' || o_custkey AS ref, p_brand AS code FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey UNION ALL SELECT 'S' || l_suppkey, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey),
ruled AS (SELECT m.group_id, c.code, u.level, count(*) AS n FROM brands c JOIN members m USING (ref) JOIN nation ON CAST(n_nationkey AS VARCHAR) = m.group_id JOIN region ON n_regionkey = r_regionkey JOIN rules u ON u.code = c.code AND u.level = r_name GROUP BY 1, 2, 3),
more AS (SELECT 'VECTOR_ANOMALY' AS kind, CASE WHEN z >= 4 THEN 'action' ELSE 'watch' END AS severity, round(least(0.99, 0.6 + 0.05 * z), 6) AS confidence, event_type AS group_id, NULL AS code, 'last ' || total AS summary, total AS "count", 3 AS detector_ord FROM vz WHERE z >= 2.5
  UNION ALL SELECT 'REGION_RULE', 'info', 0.78, group_id, code, level, n, 4 FROM ruled)
SELECT * FROM alerts UNION ALL SELECT *, CASE severity WHEN 'action' THEN 0 WHEN 'watch' THEN 1 WHEN 'info' THEN 2 ELSE 3 END, 'ALERT-' || substr(kind, 1, 4) || '-' || substr(sha256(kind || '|' || coalesce(group_id, '') || '|' || coalesce(code, '')), 1, 12) FROM more""",
    "tracing_curve": f"""WITH {_TRACE_SQL}, th(threshold) AS (VALUES {', '.join(f'(CAST({t} AS DOUBLE))' for t in THRESHOLDS)}),
j AS (SELECT t.threshold, c.index_id, c.next_id, p.lead FROM th t JOIN contacts c ON c.risk >= t.threshold LEFT JOIN pos p ON p.index_id = c.index_id AND p.event_id = c.next_id AND p.lead > 0),
a AS (SELECT t.threshold, count(j.lead) AS tp, count(j.index_id) - count(j.lead) AS fp, avg(j.lead) AS mean_lead, count(DISTINCT CASE WHEN j.lead IS NOT NULL THEN j.index_id || '/' || j.next_id END) AS caught FROM th t LEFT JOIN j ON j.threshold = t.threshold GROUP BY 1),
f AS (SELECT a.*, (SELECT count(*) FROM pos WHERE lead > 0 AND index_id IN (SELECT index_id FROM contacts)) - caught AS fn FROM a),
r AS (SELECT threshold, tp, fp, fn, mean_lead, tp + fp AS flagged, tp / greatest(tp + fn, 1) AS s, tp / greatest(tp + fp, 1) AS p FROM f)
SELECT threshold, tp, fp, fn, round(mean_lead, 6) AS mean_lead, flagged, round(s, 6) AS sensitivity, round(p, 6) AS precision, round(CASE WHEN p + s > 0 THEN 2 * p * s / (p + s) ELSE 0 END, 6) AS f1 FROM r""",
    "tracing_by_index": f"""WITH {_TRACE_SQL}, c AS (SELECT index_id, count(*) AS n_contacts, count(*) FILTER (risk >= 0.2) AS n_flagged FROM contacts GROUP BY 1)
SELECT c.*, n_contacts AS tier1, CAST(0 AS BIGINT) AS tier2, CAST(0 AS BIGINT) AS tier3, (SELECT count(*) FROM pos p WHERE p.index_id = c.index_id AND lead > 0) AS n_post, (SELECT count(*) FROM pos p WHERE p.index_id = c.index_id AND lead < 0) AS n_pre,
  (SELECT count(DISTINCT p.event_id) FROM pos p JOIN contacts x ON x.index_id = p.index_id AND x.next_id = p.event_id WHERE p.index_id = c.index_id AND lead > 0 AND risk >= 0.2) AS n_caught FROM c""",
    "contact_strata": f"""WITH {_TRACE_SQL}, c AS (SELECT index_id, count(*) AS k FROM contacts GROUP BY 1), x AS (SELECT c.*, i.route, CASE WHEN CAST(i.group_id AS INTEGER) < 5 THEN 'rural' ELSE 'urban' END AS ru FROM c JOIN idx i ON c.index_id = 'I' || i.group_id)
SELECT 'rural_urban' AS dimension, ru AS stratum, count(*) AS n_indices, CAST(sum(k) AS BIGINT) AS n_contacts FROM x GROUP BY 2 UNION ALL SELECT 'route', route, count(*), CAST(sum(k) AS BIGINT) FROM x GROUP BY 2""",
    "cross_kind_signal": f"""WITH {MEMBERS_SQL}, {cases_sql(False)}, {INDICES_SQL}
SELECT i.group_id, 'cross_kind' AS signal, CAST(min(onset) AS VARCHAR) AS earliest FROM idx i JOIN members m ON m.group_id = i.group_id AND m.kind = 'supplier' JOIN cases c ON c.ref = m.ref AND c.code = 'Brand#1' || (CAST(i.group_id AS INTEGER) % 5 + 1) AND c.onset < i.index_date GROUP BY 1""",
}
ORACLES["alerts_numbered"] = f"""SELECT kind, severity, confidence, group_id, code, summary, "count", detector_ord, alert_id AS natural_id, seq, 'ALERT-' || substr(kind, 1, 4) || '-' || CASE WHEN seq < 1000 THEN lpad(CAST(seq AS VARCHAR), 4, '0') ELSE CAST(seq AS VARCHAR) END AS alert_id
FROM (SELECT *, row_number() OVER (ORDER BY severity_rank, confidence DESC NULLS LAST, detector_ord, group_id NULLS LAST, code NULLS LAST, summary NULLS LAST, "count" NULLS LAST) AS seq FROM ({ORACLES['alerts_all']}))"""
