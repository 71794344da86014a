"""Text, federation, policy, messages, streams and series."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth.functions.numbers import digest_bucket
from hearth.operators import federate, members as member_ops, messages, metrics, policy, series, spans, text
from hearth.plans import dated, few_rows, plain
from hearth.plans.views import DAILY_SQL, MEMBERS_SQL, daily_events, members, read
from hearth.session import scratch_dir
from hearth.sources.readers import spread
from hearth.streaming import live

BAGS = {"n_and": "(?i)(?<![A-Za-z])and(?![A-Za-z])", "n_numbers": "[0-9]+", "n_mail": "[A-Za-z0-9._]+@[A-Za-z0-9.]+"}
HEADERS = [("^the ", "OPENING"), ("^to ", "PLAN")]
TOPICS = [("[0-9]", "MEASURE"), ("[^a-z]and[^a-z]", "DETAIL")]
HOW = text.Extraction(lexicons={"function": {"the": "F1", "of the": "F2", "that": "F3", "and": "F4", "with the": "F5"}}, patterns=(("number", r"\b(?P<value>\d{2,4})\b", 0.97),), negations=("no", "not"), hedges=("it is", "or"))


def keyword_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.keyword_counts(spread(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id"), BAGS)


def _phased(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.phased(text.sentences(spread(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")), "doc_id", HEADERS, TOPICS, opening="OPENING")


def sentence_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _phased(spark, sf_dir).select("doc_id", "sentence_no", "phase", "confidence", F.md5("sentence").alias("sentence_md5"))


def phase_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _phased(spark, sf_dir).groupBy("phase").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


def lexicon_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.entities(spread(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id"), HOW)


def span_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities against a gold standard made from them: ends moved by doc_id modulo 5, some left out."""
    found = lexicon_spans(spark, sf_dir).select("doc_id", "kind", "char_start", "char_end")
    gold = found.where("(char_start + doc_id) % 7 <> 0").select("doc_id", "kind", (F.col("char_start") + F.col("doc_id") % 5).cast("int").alias("char_start"), (F.col("char_end") + F.col("doc_id") % 5).cast("int").alias("char_end"))
    return spans.scores(spans.matched(gold, found), ["kind"])


def document_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.bundle(messages.resource(lexicon_spans(spark, sf_dir)))


def authorship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.authorship(messages.resource(lexicon_spans(spark, sf_dir)))


def _sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("user"), "event_type", "value").withColumn("b8", digest_bucket(F.col("user"), 8)).withColumn("b3", digest_bucket(F.col("user"), 3))
    return federate.in_sites(e, {"S1": F.col("b8") < 4, "S2": F.col("b8") >= 4, "S3": F.col("b3") == 0})


def site_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sites(spark, sf_dir).select("event_id", "site_id")


def site_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return federate.counters(_sites(spark, sf_dir), "event_type")


def site_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = federate.manifest(_sites(spark, sf_dir), "event_id", "user")[1]
    return groups.select("user", F.array_join("participating_sites", ",").alias("sites"), "n_members")


def fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _sites(spark, sf_dir)
    asked = store.where("value > 50").select("user").distinct()
    return federate.fan_out(asked, federate.manifest(store, "event_id", "user")[1], store, "user").groupBy("user", "site_id").agg(F.count("*").alias("n"))


def weighted_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read(spark, sf_dir, "embeddings").select("label", (F.col("vec_id") % 7 + 1).alias("w"), "embedding")
    return federate.weighted_mean(v, "w", "embedding", ["label"]).select("label", F.col("position").cast("int").alias("position"), F.round("value", 6).alias("value"))


def federated_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sites(spark, sf_dir).select("event_id", "site_id", (F.col("value") / 100).alias("x"), (F.col("event_type") == "click").cast("int").alias("y"))
    weights, history = federate.federated_fit(rows, ["x"], "y")
    return spark.createDataFrame([(h["round"], h["sites"], h["rows"], h["norm"]) for h in history], "round int, sites int, n_rows long, norm double")


def federated_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUC on a quarter of the events, held out, of each site's own model and of the federated one."""
    rows = _sites(spark, sf_dir).select("event_id", "site_id", (F.col("value") / 100).alias("x"), (F.col("event_id") % 5).alias("z"), (F.col("event_type").isin("click", "view") | (F.col("value") > 80)).cast("int").alias("y"))
    parted = federate.held_out(rows, "event_id")
    local = federate.local_fits(parted.where("NOT held_out"), ["x", "z"], "y")
    scored = federate.site_scores(parted.where("held_out"), ["x", "z"], "y", local, federate.averaged(local))
    return metrics.auc(scored, ["model", "site"])


def _assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = members(spark, sf_dir)
    return policy.provider_for(m, F.col("group_id"), F.col("ref"), {"0": ["P0a", "P0b", "P0c"], "1": ["P1"], "2": ["P2a", "P2b"]}, "PX").select("ref", "provider_id")


def provider_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _assignments(spark, sf_dir)


def panel_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.panel(members(spark, sf_dir), _assignments(spark, sf_dir), "P0b", "customer")


def co_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.co_members(members(spark, sf_dir), _assignments(spark, sf_dir))


def _consents(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = members(spark, sf_dir).groupBy("group_id").agg(F.count_if(F.col("kind") == "supplier").alias("n_other_kind"))
    return policy.consent_rule(kinds, ["3", "8", "15"]).withColumn("status", F.when(F.col("decision") == "deny", "inactive").otherwise("active"))


def consent_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = policy.consented(members(spark, sf_dir), _consents(spark, sf_dir))
    return kept.groupBy("group_id", "kind").agg(F.count("*").alias("n"))


def consent_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.consent_summary(_consents(spark, sf_dir))


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("case_id"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("ref"), "o_orderpriority", "o_totalprice", "o_orderdate")


def lab_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cases(spark, sf_dir)
    observations = F.array(F.struct(F.lit("PRICE").alias("code"), F.floor("o_totalprice").cast("string").alias("value"), F.lit("USD|EUR").alias("unit")))
    return messages.lab_report(rows, "HEARTH", "HEALTH", F.col("case_id").cast("string"), F.col("ref"), F.col("ref"), F.substring("o_orderpriority", 1, 1), F.col("o_orderpriority"), F.col("o_orderdate"), observations).select("case_id", "message")


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = policy.destinations([("state", F.lit(True)), ("federal", F.col("o_totalprice") > 200000), ("animal", F.col("o_orderpriority").startswith("1"))])
    return messages.submitted(_cases(spark, sf_dir), to, "case_id")


def case_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cases(spark, sf_dir).select("case_id", messages.payload({"case": F.col("case_id"), "member": F.col("ref"), "priority": F.col("o_orderpriority"), "none": F.lit(None).cast("string")}).alias("payload"))


def workflow_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.current_state(read(spark, sf_dir, "events"), "user_id", "event_id", "event_type", "new")


def recent_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("date"))
    return member_ops.newest_per(o, "o_custkey", "date", "o_orderkey", 3).withColumnRenamed("rank", "place")


def member_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = members(spark, sf_dir)
    return member_ops.listing(m, m.where("kind = 'supplier'").select("group_id"), "group_id", "ref")


def member_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("group_id"), "n_name")
    return member_ops.search(members(spark, sf_dir).join(n, "group_id"), "1", ["n_name", "ref"])


def event_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = series.trend(daily_events(spark, sf_dir), "event_type", "day", "n")
    return found.withColumns({c: F.round(c, 6) for c in ("recent", "prior")})


def trailing_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.trailing_mean(daily_events(spark, sf_dir), "event_type", "day", "n", digits=4)


def streamed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six-hour windows of events through Structured Streaming."""
    schema = read(spark, sf_dir, "events").schema
    folder = f"{scratch_dir(spark)}/windows-{uuid.uuid4().hex}"
    counts = live.windowed_counts(live.read_files(spark, sf_dir, schema, "events.parquet"), "ts", ["event_type"], "6 hours")
    done = live.run_once(counts, f"{folder}/table", "complete", f"{folder}/checkpoint")
    return done.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


_PHASES_SQL = """d AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\v\\f\\r]+', ' ', 'g')) AS t FROM documents),
p AS (SELECT doc_id, unnest(string_split(regexp_replace(t, '([.!?]) ([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1))) AS sentence, generate_subscripts(string_split(regexp_replace(t, '([.!?]) ([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), 1) - 1 AS sentence_no FROM d),
h AS (SELECT *, CASE WHEN regexp_matches(lower(sentence), '^the ') THEN 'OPENING' WHEN regexp_matches(lower(sentence), '^to ') THEN 'PLAN' END AS h,
      CASE WHEN regexp_matches(lower(sentence), '[0-9]') THEN 'MEASURE' WHEN regexp_matches(lower(sentence), '[^a-z]and[^a-z]') THEN 'DETAIL' END AS t FROM p WHERE sentence <> ''),
ph AS (SELECT doc_id, sentence_no, sentence, coalesce(last_value(coalesce(h, t, CASE WHEN sentence_no = 0 THEN 'OPENING' END) IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY sentence_no ROWS UNBOUNDED PRECEDING), 'UNKNOWN') AS phase,
       CAST(CASE WHEN h IS NOT NULL THEN 0.95 WHEN t IS NOT NULL THEN 0.65 WHEN sentence_no = 0 THEN 0.55 ELSE 0.4 END AS DOUBLE) AS confidence FROM h)"""
_BUCKET = "list_reduce(list_prepend(0, list_transform(string_split(sha256(CAST(user_id AS VARCHAR)), ''), lambda c : CAST('0x' || c AS INTEGER))), lambda a, d : (a * 16 + d) % {n})"
_SITES_SQL = f"""u AS (SELECT user_id, {_BUCKET.format(n=8)} AS b8, {_BUCKET.format(n=3)} AS b3 FROM (SELECT DISTINCT user_id FROM events)),
e AS (SELECT event_id, CAST(user_id AS VARCHAR) AS user, event_type, value, b8, b3 FROM events JOIN u USING (user_id)),
store AS (SELECT *, 'S1' AS site_id FROM e WHERE b8 < 4 UNION ALL SELECT *, 'S2' FROM e WHERE b8 >= 4 UNION ALL SELECT *, 'S3' FROM e WHERE b3 = 0)"""
_SUM = "list_sum(list_transform(string_split(ref, ''), lambda c : ascii(c)))"
_ASSIGN_SQL = f"""{MEMBERS_SQL},
assigned AS (SELECT ref, CASE group_id WHEN '0' THEN ['P0a', 'P0b', 'P0c'][CAST({_SUM} % 3 AS INTEGER) + 1] WHEN '1' THEN 'P1' WHEN '2' THEN ['P2a', 'P2b'][CAST({_SUM} % 2 AS INTEGER) + 1] ELSE 'PX' END AS provider_id FROM members)"""
_CONSENT_SQL = f"""{MEMBERS_SQL},
consents AS (SELECT group_id, CASE WHEN group_id IN ('3', '8', '15') THEN 'deny' ELSE 'permit' END AS decision FROM members GROUP BY 1)"""
_MD = "case_id, ref, o_orderpriority, o_totalprice, o_orderdate"
_CASES_SQL = "k AS (SELECT o_orderkey AS case_id, 'C' || o_custkey AS ref, o_orderpriority, o_totalprice, o_orderdate FROM orders WHERE o_orderstatus = 'F')"

QUERIES = {
    f.__name__: plain(f)
    for f in (keyword_counts, sentence_phases, phase_counts, lexicon_spans, document_bundles, authorship, site_partition, site_counters, site_manifest, fan_out, weighted_vectors, federated_model, federated_sites, provider_assignment, panel_filter, co_members, consent_gate, consent_summary, lab_reports, submissions, case_payloads, workflow_state, recent_orders, member_listing, member_search, event_trend, trailing_means, streamed_windows)
}
QUERIES["span_scores"] = plain(few_rows(span_scores))
ORACLES = {
    "keyword_counts": """SELECT doc_id, CAST(len(list_filter(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+'), lambda x : x = 'and')) AS BIGINT) AS n_and, CAST(len(regexp_extract_all(coalesce(text, ''), '[0-9]+')) AS BIGINT) AS n_numbers, CAST(len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9._]+@[A-Za-z0-9.]+')) AS BIGINT) AS n_mail FROM documents""",
    "sentence_phases": f"WITH {_PHASES_SQL} SELECT doc_id, CAST(sentence_no AS INTEGER) AS sentence_no, phase, confidence, md5(sentence) AS sentence_md5 FROM ph",
    "phase_counts": f"WITH {_PHASES_SQL} SELECT phase, count(*) AS n, round(avg(confidence), 6) AS mean_confidence FROM ph GROUP BY 1",
    "site_partition": f"WITH {_SITES_SQL} SELECT event_id, site_id FROM store",
    "site_counters": f"WITH {_SITES_SQL} SELECT site_id, count(*) AS n_rows, count(DISTINCT event_type) AS n_kinds FROM store GROUP BY 1",
    "site_manifest": f"WITH {_SITES_SQL} SELECT user, string_agg(DISTINCT site_id, ',' ORDER BY site_id) AS sites, count(DISTINCT event_id) AS n_members FROM store GROUP BY 1",
    "fan_out": f"WITH {_SITES_SQL} SELECT user, site_id, count(*) AS n FROM store WHERE user IN (SELECT user FROM store WHERE value > 50) GROUP BY 1, 2",
    "weighted_vectors": """WITH v AS (SELECT label, vec_id % 7 + 1 AS w, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS position FROM embeddings)
SELECT label, CAST(position AS INTEGER) AS position, round(sum(w * CAST(x AS DOUBLE)) / sum(w), 6) AS value FROM v GROUP BY 1, 2""",
    "provider_assignment": f"WITH {_ASSIGN_SQL} SELECT ref, provider_id FROM assigned",
    "panel_filter": f"WITH {_ASSIGN_SQL} SELECT m.* FROM members m JOIN assigned a USING (ref) WHERE provider_id = 'P0b' AND kind = 'customer'",
    "co_members": f"""WITH {_ASSIGN_SQL}, x AS (SELECT m.*, a.provider_id FROM members m JOIN assigned a USING (ref))
SELECT a.ref, count(*) FILTER (a.kind = b.kind AND a.provider_id = b.provider_id) AS n_visible, count(*) FILTER (NOT (a.kind = b.kind AND a.provider_id = b.provider_id)) AS n_hidden FROM x a JOIN x b ON a.group_id = b.group_id AND a.ref <> b.ref GROUP BY 1""",
    "consent_gate": f"WITH {_CONSENT_SQL} SELECT group_id, kind, count(*) AS n FROM members WHERE group_id NOT IN (SELECT group_id FROM consents WHERE decision = 'deny') GROUP BY 1, 2",
    "consent_summary": f"WITH {_CONSENT_SQL} SELECT count(*) AS n, count(*) FILTER (decision = 'deny') AS n_declined, round_even(CAST(count(*) FILTER (decision = 'deny') AS DOUBLE) / greatest(count(*), 1), 4) AS decline_rate FROM consents",
    "lab_reports": f"""WITH {_CASES_SQL}, m AS (SELECT *, strftime(o_orderdate, '%Y%m%d%H%M%S') AS tm, chr(13) AS cr FROM k)
SELECT case_id, 'MSH|^~\\&|HEARTH||HEALTH||' || tm || '||ORU^R01^ORU_R01|' || case_id || '|P|2.5.1' || cr || 'SFT|HEARTH|1' || cr || 'PID|1||' || ref || '||' || ref || cr || 'PV1|1|O' || cr || 'ORC|RE|' || case_id || cr || 'OBR|1||' || case_id || '|' || substr(o_orderpriority, 1, 1) || '||' || tm || cr
  || 'OBX|1|NM|PRICE||' || CAST(floor(o_totalprice) AS BIGINT) || '|USD\\F\\EUR|F' || cr || 'SPM|1|' || case_id || cr || 'NTE|1||' || o_orderpriority AS message FROM m""",
    "submissions": f"""WITH {_CASES_SQL}, d AS (SELECT case_id, 'state' AS destination FROM k UNION ALL SELECT case_id, 'federal' FROM k WHERE o_totalprice > 200000 UNION ALL SELECT case_id, 'animal' FROM k WHERE o_orderpriority LIKE '1%')
SELECT case_id, destination, 'ACK-' || substr(sha256(case_id || '|' || destination), 1, 12) AS ack_id, 'AA' AS ack_status, 'submitted' AS state FROM d""",
    "case_payloads": f"""WITH {_CASES_SQL} SELECT case_id, '{{"case":' || case_id || ',"member":"' || ref || '","priority":"' || o_orderpriority || '"}}' AS payload FROM k""",
    "workflow_state": "SELECT user_id, coalesce(max_by(event_type, event_id), 'new') AS state, count(*) AS n_steps FROM events GROUP BY 1",
    "recent_orders": "SELECT * FROM (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS date, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) DESC, o_orderkey DESC) AS INTEGER) AS place FROM orders) WHERE place <= 3",
    "member_listing": f"WITH {MEMBERS_SQL}, g AS (SELECT DISTINCT group_id FROM members WHERE kind = 'supplier') SELECT m.*, CAST(g.group_id IS NOT NULL AS INTEGER) AS has_alert FROM members m LEFT JOIN g USING (group_id) ORDER BY has_alert DESC, ref LIMIT 80",
    "member_search": f"WITH {MEMBERS_SQL} SELECT m.group_id, ref, kind, n_name FROM members m JOIN nation ON CAST(n_nationkey AS VARCHAR) = m.group_id WHERE lower(n_name) LIKE '%1%' OR lower(ref) LIKE '%1%'",
    "event_trend": f"""WITH {DAILY_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day DESC) AS rn FROM daily),
t AS (SELECT event_type, avg(n) FILTER (rn <= 7) AS recent, avg(n) FILTER (rn > 7) AS prior FROM r WHERE rn <= 21 GROUP BY 1)
SELECT event_type, round(recent, 6) AS recent, round(prior, 6) AS prior, CASE WHEN recent > 1.1 * prior THEN 'rising' WHEN recent < 0.9 * prior THEN 'falling' ELSE 'stable' END AS trend FROM t""",
    "trailing_means": f"WITH {DAILY_SQL} SELECT event_type, day, n, round(avg(n) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 4) AS trailing_mean FROM daily",
    "streamed_windows": "SELECT strftime(time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
}
for _name, _columns in {"recent_orders": ("date",), "trailing_means": ("day",)}.items():
    ORACLES[_name] = dated(ORACLES[_name], *_columns)
