"""Sources, sinks, filters, projections, column functions, policy and messages over the driver's tables, each with SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth.functions import dates, numbers, strings
from hearth.operators import federate, generate, graph, linkage, members as member_ops, messages, policy, series
from hearth.plans import exchange, plain
from hearth.plans.exchange import _ASSIGN_SQL, _CONSENT_SQL, _SITES_SQL
from hearth.plans.views import DAILY_SQL, MEMBERS_SQL, daily_events, members, read
from hearth.session import scratch_dir
from hearth.sources import readers, writers


def _folder(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


# sources and sinks


def envelope_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations written as one JSON document {_metadata, rows} and read back from it."""
    path = _folder(spark, "envelope")
    n = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    document = n.agg(F.struct(F.count("*").alias("n")).alias("_metadata"), F.collect_list(F.struct("n_nationkey", "n_name")).alias("rows"))  # a reference table
    document.select(F.to_json(F.struct("_metadata", "rows")).alias("value")).write.text(path)
    return readers.unwrap(readers.read_json(spark, path, "_metadata struct<n:bigint>, rows array<struct<n_nationkey:int,n_name:string>>"), "rows")


def missing_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers by nation, written as documents and read again, beside a folder of documents that is not there."""
    path, schema = _folder(spark, "nations"), "s_nationkey int, n bigint"
    n = read(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n")).withColumn("nation", F.col("s_nationkey"))
    n.repartition("nation").write.partitionBy("nation").json(path)
    found = {"present": f"{path}/nation=*", "missing": _folder(spark, "none")}
    sums = [readers.read_optional_json(spark, where, schema).agg(F.lit(name).alias("document"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")) for name, where in found.items()]
    return sums[0].unionByName(sums[1])


def site_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of documents, one for each region, read as rows with their file's folder."""
    path = _folder(spark, "sites")
    n = read(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.collect_list("n_name").alias("names")).withColumn("site", F.col("n_regionkey"))
    n.repartition("site").write.partitionBy("site").json(path)
    return readers.read_site_folder(spark, f"{path}/site=*", "n_regionkey bigint, names array<string>").select("n_regionkey", F.size("names").alias("n_names"), F.col("site_file").endswith(".json").alias("from_file"))


def site_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "store")
    writers.write_sites(exchange._sites(spark, sf_dir).select("event_id", "site_id"), path)
    return readers.read_parquet(spark, path, ["site_id", "event_id"]).groupBy("site_id").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


def log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 200 rows of a line-wise log in which some lines are broken."""
    path = _folder(spark, "log")
    line = F.to_json(F.struct("event_id", "event_type"))
    read(spark, sf_dir, "events").select(F.when(F.col("event_id") % 7 == 0, F.substring(line, 1, 9)).otherwise(line).alias("value")).write.text(path)
    return writers.latest(readers.read_log(spark, path, "event_id bigint, event_type string"), "event_id", "event_type", 200)


def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appends to a log table, read as one."""
    path = _folder(spark, "audit")
    e = read(spark, sf_dir, "events").select("event_id", "user_id")
    for parity in (0, 1):
        writers.append(e.where(F.col("event_id") % 2 == parity), path)
    return readers.read_parquet(spark, path).groupBy("user_id").agg(F.count("*").alias("n"))


def rows_and_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _folder(spark, "json")
    r = read(spark, sf_dir, "region").select("r_regionkey", "r_name")
    writers.write_json(r, path, r.agg(F.count("*").alias("n")))
    rows, summary = (readers.read_log(spark, f"{path}/{part}", schema) for part, schema in (("rows", "r_regionkey int, r_name string"), ("summary", "n bigint")))
    return rows.crossJoin(summary)  # one row


def table_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return writers.bundle({"nation": read(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "region": read(spark, sf_dir, "region").select("r_regionkey", "r_name")})


def dimension_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", "c_name")
    return readers.first_by_key(c, "c_nationkey", "c_custkey")


def catalog_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = f"t{uuid.uuid4().hex}"
    readers.register(spark, {name: read(spark, sf_dir, "nation")})
    return spark.sql(f"SELECT n_regionkey, count(*) AS n FROM {name} GROUP BY 1")


def salvaged_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON arrays found inside prose; every fifth text has none."""
    k = F.col("o_orderkey").cast("string")
    text = F.when(F.col("o_orderkey") % 5 == 0, F.lit("nothing found")).otherwise(F.concat(F.lit('Here it is:\n[{"id": '), k, F.lit(', "kind": "a"}, {"id": 7, "kind": "b"}] Hope this helps.')))
    found = readers.records_from_text(read(spark, sf_dir, "orders").select("o_orderkey", text.alias("reply")), "reply", "id: bigint, kind: string")
    return found.select("o_orderkey", "record.id", "record.kind")


# filters, projections and lookups


def region_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "nation").join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").cast("string").alias("group_id"), "r_name")
    found = member_ops.in_region(members(spark, sf_dir).join(n, "group_id"), "r_name", "aSiA")
    return member_ops.with_value(found, "kind", "supplier").select("ref", "group_id")


def point_member(spark: SparkSession, sf_dir: str) -> DataFrame:
    return member_ops.point(members(spark, sf_dir), "ref", "C7")


def alerts_of_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_id", "event_type")
    return member_ops.with_kind(e, "event_type", "click", {"click", "view", "purchase"})


def flattened_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested groups taken apart: one row for each member, with a display name or its kind."""
    m = members(spark, sf_dir)
    nested = m.groupBy("group_id").agg(*[F.collect_list(F.when(F.col("kind") == k, F.struct(F.col("ref").alias("id"), F.when(~F.col("ref").endswith("3"), F.col("ref")).alias("name")))).alias(f"{k}s") for k in ("customer", "supplier")])
    ident = lambda c: F.col("m.id")
    return member_ops.flatten(nested, "group_id", {"customers": ("customer", "Patient/", ident("m"), F.col("m.name")), "suppliers": ("supplier", "Animal/", ident("m"), F.col("m.name"))})


def members_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = member_ops.by_kind(members(spark, sf_dir))
    return found.select("group_id", "kind", F.size("refs").alias("n"), F.element_at("refs", 1).alias("first_ref"))


def member_codings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select("p_partkey", member_ops.codings([("brand", F.when(F.col("p_size") > 10, F.col("p_brand"))), ("size", F.col("p_size").cast("string"))]).alias("c"))
    return p.select("p_partkey", F.array_join(F.transform("c", lambda x: F.concat(x["system"], F.lit("="), x["code"])), ";").alias("codings"))


def extension_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    extensions = F.array(*[F.struct(F.lit(url).alias("url"), value.alias("valueString")) for url, value in (("http://x/fips", F.col("c_nationkey").cast("string")), ("http://x/zip", c.cast("string")), ("http://y/zip", (c + 1).cast("string")))])
    return read(spark, sf_dir, "customer").select("c_custkey", strings.extension_value(extensions, "/zip", "valueString").alias("zip"), strings.extension_value(extensions, "/none", "valueString").alias("none"))


def member_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer with its finished orders as conditions, priorities as medications and newest orders."""
    who = members(spark, sf_dir).where("kind = 'customer'").select("ref")
    o = read(spark, sf_dir, "orders").select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("ref"), F.col("o_orderkey").alias("event_id"), F.to_date("o_orderdate").alias("date"), "o_orderstatus", F.substring("o_orderpriority", 1, 1).alias("p"))
    conditions = o.select("ref", F.col("p").alias("code"), F.col("date").alias("onset"), (F.col("o_orderstatus") == "F").alias("active"))
    found = member_ops.chart(who, conditions, o.select("ref", "event_id", "date", F.array("p").alias("medications")), n_events=5)
    return found.select("ref", F.coalesce(F.size("conditions"), F.lit(-1)).alias("n_conditions"), F.array_join("medications", "").alias("medications"), F.array_join(F.transform("recent", lambda r: r["event_id"].cast("string")), ",").alias("recent"))


def first_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    es = members(spark, sf_dir).select(F.col("ref").alias("source"), F.col("group_id").alias("target"), F.lit("IN").alias("kind"))
    return graph.first_neighbour(es, "IN")


def identity_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People by weighted matches of name, birth date and address."""
    c = F.col("c_custkey")
    people = read(spark, sf_dir, "customer").select(F.concat(F.lit("C"), c.cast("string")).alias("ref"), F.col("c_name").alias("name"), F.concat(F.lit("19"), F.lpad((c % 100).cast("string"), 2, "0"), F.lit("-01-01")).alias("birth"), F.concat((c % 7).cast("string"), F.lit(" Main Street")).alias("address"))
    return graph.identity_search(people, "00011", "1911-01-01", "4 main").select("ref", F.round("score", 6).alias("score"))


def intake_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    people = read(spark, sf_dir, "customer").select(c.alias("id"), F.element_at(F.array(*map(F.lit, ("Robert", "Rob", "Anna"))), (c % 3).cast("int") + 1).alias("first_name"), F.element_at(F.array(*map(F.lit, ("Miller", "Mills"))), (c % 2).cast("int") + 1).alias("last_name"), F.when(c % 5 == 0, "1980-02-03").otherwise("1990-01-01").alias("dob"), F.lit("4 Main Street").alias("address"))
    return linkage.intake_check(people, "Robert", "Miller", "1980-02-03", "main", 5).select("id", F.round("score", 6).alias("score"))


# column functions


def string_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, name = F.col("c_custkey"), F.col("c_name")
    a, b = F.concat((c % 50).cast("string"), F.lit(" N. Main St")), F.concat((c % 40).cast("string"), F.lit(" north main street"))
    tokens = [strings.address_tokens(x, {"n": "north", "st": "street"}) for x in (a, b)]
    first, second = strings.split_pair(F.when(c % 3 == 0, F.lit("a/b/c")).otherwise(F.concat(c.cast("string"), F.lit("/"), (c + 1).cast("string"))))
    return read(spark, sf_dir, "customer").select(
        "c_custkey", strings.first_chars(name, 4).alias("four"), strings.collapse_spaces(F.concat(F.lit("  a \t b\n"), name)).alias("collapsed"), strings.contains_any(name, ["001", "MER#"]).alias("contains"), strings.equal_ignoring_case(F.col("c_mktsegment"), "building").alias("equal"),
        strings.display_name(F.when(c % 2 == 0, "Ann"), F.when(c % 4 == 0, "Bee"), F.lit("unnamed")).alias("display"), strings.either_contains(F.col("c_mktsegment"), F.lit("auto")).alias("either"), strings.same_prefix(F.col("c_mktsegment"), F.lit("BUX"), 2).alias("prefix"),
        strings.hl7_escape(F.concat(F.lit("a|b^c&d~e\\"), name)).alias("escaped"), F.round(strings.token_overlap(*tokens), 6).alias("overlap"), first.alias("first"), second.alias("second"), strings.wait_text(c % 200).alias("wait"),
        strings.ordered_case(name, [("1$", "one"), ("[12]", "some")], "none").alias("rule"), F.lpad((c % 1000).cast("string"), 4, "0").alias("padded"), F.format_string("%.1f", c / 10).alias("tenths"),
    )


def date_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = F.to_date("o_orderdate"), F.col("o_orderkey")
    born, unit = F.date_sub(o, (k % 20000).cast("int")), F.element_at(F.array(*map(F.lit, ("days", "Week", "months", "year", "hour"))), (k % 5).cast("int") + 1)
    return read(spark, sf_dir, "orders").select(
        "o_orderkey", dates.iso_date(F.when(k % 6 == 0, F.lit("not a date")).otherwise(F.concat(o.cast("string"), F.lit("T10:00:00Z")))).alias("iso"), dates.day_number(o).alias("day_number"), F.round(dates.age_years(born, o), 6).alias("age"), dates.age_by_year(born, o).alias("age_by_year"),
        dates.month_anchor(o, (k % 30).cast("int")).alias("anchor"), dates.mid_month(F.year(o), F.month(o)).alias("middle"), dates.week_start(o).cast("date").alias("week"), dates.birth_from_age((k % 80).cast("int"), F.lit("2024-06-15").cast("date")).alias("born"), dates.hl7_time(F.col("o_orderdate")).alias("hl7"),
        dates.duration_days(k % 9, unit).alias("days"), dates.date_similarity(o.cast("string"), F.date_add(o, (k % 40).cast("int")).cast("string")).alias("similarity"),
    )


def number_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey").cast("double")
    rounded = {"z": numbers.z_score(k, F.lit(500.0), F.when(k % 2 == 0, 10.0).otherwise(0.0)), "clipped": numbers.clipped(F.when(k % 5 != 0, k), 10.0, 900.0), "ratio": numbers.safe_ratio(k, k % 3), "weight": numbers.bit_weight((k % 10) / 10, 0.95, 0.005), "logistic": numbers.logistic(k % 20 - 10, 8.0), "uniform": numbers.keyed_uniform(F.col("c_custkey"), seed=3)}
    return read(spark, sf_dir, "customer").select(
        "c_custkey", *[F.round(c, 6).alias(n) for n, c in rounded.items()], numbers.banded(F.when(k % 11 != 0, k % 400), series.AQI_BOUNDS, series.AQI_LABELS).alias("band"), numbers.weighted_lookup(F.col("c_mktsegment"), {"BUILDING": 0.5, "MACHINERY": 0.25}, 0.1).alias("looked_up"),
        numbers.digest_bucket(F.col("c_custkey"), 8).alias("bucket"), numbers.code_sum_bucket(F.col("c_name"), 7).alias("code_bucket"),
    )


# series, federation, policy and messages


def one_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.region_series(daily_events(spark, sf_dir), "event_type", "click", "day")


def last_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.last_sum(daily_events(spark, sf_dir), ["event_type"], "day", "n", 8).select("event_type", "total", F.col("n").alias("k"))


def station_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    stations = read(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 9 != 0, F.col("s_suppkey") * 37 % 350).alias("aqi"))
    return series.air_quality(stations, "aqi")


def latest_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.latest_by_key(daily_events(spark, sf_dir), "event_type", "day", "n")


def site_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request to one site under exact filters, and what its log says."""
    found, log = federate.fetch(exchange._sites(spark, sf_dir), "S2", {"event_type": "click"}, "2024-01-01")
    return log.select("target", "status", "n_results")


def routed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members with the site of their provider and where they came from; those without a site go."""
    providers = spark.createDataFrame([("P0a", "S1"), ("P0b", "S2"), ("P1", "S1"), ("P2a", "S3")], "provider_id string, site_id string")
    sites = spark.createDataFrame([("S1", "clinic"), ("S2", "lab"), ("S3", "farm")], "site_id string, facility string")
    m = federate.with_provenance(federate.routed_sites(members(spark, sf_dir), exchange._assignments(spark, sf_dir), providers, "ref"), sites)
    return m.select("ref", "site_id", F.col("provenance.facility").alias("facility"))


def role_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests with whether their role may, and an audit row's action for each."""
    e = read(spark, sf_dir, "events").select("event_id", F.when(F.col("user_id") % 3 == 0, "clerk").otherwise("doctor").alias("role"), F.col("event_type").alias("resource"))
    rules = spark.createDataFrame([("doctor", "click"), ("doctor", "view"), ("clerk", "view"), ("clerk", "view")], "role string, resource string")
    found = policy.allowed(e, rules)
    return found.withColumn("audit", F.when(F.col("allowed"), "ACCESS").otherwise("ACCESS_DENIED"))


def role_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A role without row access sees no member; one with access sees its panel."""
    m, a = members(spark, sf_dir), exchange._assignments(spark, sf_dir)
    seen = [policy.panel(m, a, "P0a", None, sees_rows=sees).agg(F.count("*").alias("n")).select(F.lit(name).alias("role"), "n") for name, sees in (("doctor", True), ("public_health", False))]
    return seen[0].unionByName(seen[1])


def pointer_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = members(spark, sf_dir)
    return policy.pointers(m, exchange._consents(spark, sf_dir), F.when(F.col("kind") == "supplier", "trade").otherwise("person"))


def alerts_for_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("kind"))
    return policy.visible_alerts(e, "clinic", {"clinic": ["purchase", "click"]}).groupBy("kind").agg(F.count("*").alias("n"))


def provider_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.panels(exchange._assignments(spark, sf_dir)).select("provider_id", "n", F.element_at("refs", 1).alias("first_ref"))


def staff_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, "vet").otherwise("nurse").alias("role"), F.col("s_nationkey").cast("string").alias("facility"))
    return policy.staff(s, "vet", "3")


def masked_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.masked(members(spark, sf_dir), ["kind"])


def destination_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One message for each case and destination in the destination's own form."""
    rows = exchange.submissions(spark, sf_dir).select("case_id", "destination")
    case = F.col("case_id").cast("string")
    text = messages.for_destination(F.col("destination"), messages.joined(messages.segment("MSH", "^~\\&", case), messages.segment("PID", "1", F.col("destination"))), messages.payload({"case": F.col("case_id"), "to": F.col("destination")}), ["state"], ["federal"], F.concat(F.lit("Notice of case "), case))
    return rows.select("case_id", "destination", text.alias("message"))


def animal_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.animal_report(_animal_cases(spark, sf_dir)).select("case_id", "report")


def animal_acks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.animal_acknowledgement(_animal_cases(spark, sf_dir), 2024).select("case_id", "ack_id", "agency_case_id", "status")


def _animal_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return read(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.concat(F.lit("CASE-"), F.lpad(k.cast("string"), 8, "0")).alias("case_id"), F.concat(F.lit("S"), (k % 10).cast("string")).alias("animal_id"), F.lit("dog").alias("species"), F.col("o_orderpriority").alias("disease"), (k % 2 == 0).alias("federal"), (k % 3 == 0).alias("state"), (k % 5 == 0).alias("zoonotic"), F.to_date("o_orderdate").cast("string").alias("onset"))


def report_deadlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases that must be reported for their kind of subject, with the class of their deadline."""
    k = F.col("o_orderkey")
    cases = read(spark, sf_dir, "orders").select(k.alias("case_id"), F.substring("o_orderpriority", 1, 1).alias("disease_id"), (k % 2 == 0).alias("is_animal"))
    rules = spark.createDataFrame([("1", True, True, "immediate", None, None), ("2", True, True, None, True, True), ("3", False, True, None, False, True), ("4", True, False, None, False, False)], "disease_id string, human boolean, animal boolean, timeline string, notifiable boolean, monitored boolean")
    return messages.reportable(cases, rules)


def order_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first disease with an order set among a member's own conditions, else among its group's."""
    m = members(spark, sf_dir).where("kind = 'customer'")
    o = read(spark, sf_dir, "orders").where("o_orderstatus <> 'O'").select(F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("ref"), F.col("o_orderkey").alias("ordinal"), F.substring("o_orderpriority", 1, 1).alias("disease_id"))
    return messages.detected(m.select("ref", "group_id"), o.join(m.select("ref", "group_id"), "ref"), ["1", "4"])


def triage_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return messages.legal_steps(e, "user_id", "event_id", "event_type", ["view", "click", "purchase"]).groupBy("event_type", "is_legal").agg(F.count("*").alias("n"))


def provenance_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.provenance(read(spark, sf_dir, "documents").select("doc_id", "text"))


# synthetic rows


def generated_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A group for each customer."""
    return generate.group_members(generate.dealt_groups(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("group_id"))))


def generated_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of a region for each supplier over 26 periods, the last four of one of them 5.2 times as high."""
    return generate.series_of(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("region")), 26, spike=(3, 4, 5.2)).withColumn("value", F.round("value", 3))


def generated_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    choices = read(spark, sf_dir, "nation").select("n_name", (F.col("n_nationkey") % 3).alias("w"))
    return generate.weighted_pick(read(spark, sf_dir, "customer").select("c_custkey"), "c_custkey", choices, "n_name", "w")


_U = "((CAST(CAST('0x' || substr(md5({key} || '|42'), 1, 12) AS BIGINT) AS DOUBLE) + 0.5) / 281474976710656)"
_STATUS_CASES = "FROM orders WHERE o_orderstatus = 'F'"
_CASE = "'CASE-' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0')"

QUERIES = {
    f.__name__: plain(f)
    for f in (
        envelope_rows, missing_document, site_documents, site_store, log_tail, audit_log, rows_and_summary, table_bundle, dimension_index, catalog_tables, salvaged_records, region_members, point_member, alerts_of_kind, flattened_members, members_by_kind, member_codings, extension_values, member_chart,
        first_groups, identity_matches, intake_duplicates, string_functions, date_functions, number_functions, one_series, last_sums, station_quality, latest_values, site_fetch, routed_rows, role_access, role_rows, pointer_tiers, alerts_for_role, provider_panels, staff_list, masked_members,
        destination_messages, animal_reports, animal_acks, report_deadlines, order_sets, triage_steps, provenance_records, generated_members, generated_series, generated_picks,
    )
}
ORACLES = {
    "envelope_rows": "SELECT n_nationkey, n_name FROM nation",
    "missing_document": "SELECT 'present' AS document, count(*) AS n FROM supplier UNION ALL SELECT 'missing', 0",
    "site_documents": "SELECT CAST(n_regionkey AS BIGINT) AS n_regionkey, CAST(count(*) AS INTEGER) AS n_names, true AS from_file FROM nation GROUP BY 1",
    "site_store": f"WITH {_SITES_SQL} SELECT site_id, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM store GROUP BY 1",
    "log_tail": "SELECT event_id, event_type FROM events WHERE event_id % 7 <> 0 ORDER BY event_id DESC LIMIT 200",
    "audit_log": "SELECT user_id, count(*) AS n FROM events GROUP BY 1",
    "rows_and_summary": "SELECT r_regionkey, r_name, (SELECT count(*) FROM region) AS n FROM region",
    "table_bundle": """SELECT 'nation' AS "table", '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' AS row FROM nation UNION ALL SELECT 'region', '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}' FROM region""",
    "dimension_index": "SELECT c_nationkey, min(c_custkey) AS c_custkey, min_by(c_name, c_custkey) AS c_name FROM customer GROUP BY 1",
    "catalog_tables": "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY 1",
    "salvaged_records": "SELECT o_orderkey, CAST(o_orderkey AS BIGINT) AS id, 'a' AS kind FROM orders WHERE o_orderkey % 5 <> 0 UNION ALL SELECT o_orderkey, 7, 'b' FROM orders WHERE o_orderkey % 5 <> 0",
    "region_members": f"WITH {MEMBERS_SQL} SELECT ref, group_id FROM members JOIN nation ON CAST(n_nationkey AS VARCHAR) = group_id JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND kind = 'supplier'",
    "point_member": f"WITH {MEMBERS_SQL} SELECT * FROM members WHERE ref = 'C7'",
    "alerts_of_kind": "SELECT event_id, event_type FROM events WHERE event_type = 'click'",
    "flattened_members": f"WITH {MEMBERS_SQL} SELECT group_id, CASE kind WHEN 'customer' THEN 'Patient/' ELSE 'Animal/' END || ref AS ref, kind, CASE WHEN ref LIKE '%3' THEN kind ELSE ref END AS name FROM members",
    "members_by_kind": f"WITH {MEMBERS_SQL} SELECT group_id, kind, CAST(count(*) AS INTEGER) AS n, min(ref) AS first_ref FROM members GROUP BY 1, 2",
    "member_codings": "SELECT p_partkey, CASE WHEN p_size > 10 THEN 'brand=' || p_brand || ';' ELSE '' END || 'size=' || p_size AS codings FROM part",
    "extension_values": "SELECT c_custkey, CAST(c_custkey + 1 AS VARCHAR) AS zip, CAST(NULL AS VARCHAR) AS none FROM customer",
    "member_chart": f"""WITH {MEMBERS_SQL}, o AS (SELECT 'C' || o_custkey AS ref, o_orderkey AS id, CAST(o_orderdate AS DATE) AS date, o_orderstatus, substr(o_orderpriority, 1, 1) AS p FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY date DESC, id DESC) AS rn FROM o)
SELECT ref, coalesce((SELECT CAST(count(DISTINCT (p, date)) AS INTEGER) FROM o WHERE o.ref = m.ref AND o_orderstatus = 'F' HAVING count(*) > 0), -1) AS n_conditions, (SELECT string_agg(DISTINCT p, '' ORDER BY p) FROM o WHERE o.ref = m.ref) AS medications, (SELECT string_agg(id, ',' ORDER BY rn) FROM r WHERE r.ref = m.ref AND rn <= 5) AS recent FROM members m WHERE kind = 'customer'""",
    "first_groups": f"WITH {MEMBERS_SQL} SELECT ref AS source, min(group_id) AS target FROM members GROUP BY 1",
    "identity_matches": "SELECT 'C' || c_custkey AS ref, CAST(least(0.99, CASE WHEN c_name LIKE '%00011%' THEN 0.5 ELSE 0 END + CASE WHEN c_custkey % 100 = 11 THEN 0.35 ELSE 0 END + CASE WHEN c_custkey % 7 = 4 THEN 0.2 ELSE 0 END) AS DOUBLE) AS score FROM customer WHERE c_name LIKE '%00011%' OR c_custkey % 100 = 11 OR c_custkey % 7 = 4 ORDER BY score DESC, ref LIMIT 5",
    "intake_duplicates": "SELECT * FROM (SELECT c_custkey AS id, CAST(least(0.99, CASE WHEN c_custkey % 2 = 0 THEN 0.4 ELSE 0.18 END + CASE c_custkey % 3 WHEN 0 THEN 0.3 WHEN 1 THEN 0.12 ELSE 0 END + CASE WHEN c_custkey % 5 = 0 THEN 0.25 ELSE 0 END + 0.15) AS DOUBLE) AS score FROM customer) WHERE score >= 0.5 ORDER BY score DESC, id LIMIT 5",
    "string_functions": r"""SELECT c_custkey, substr(c_name, 1, 4) AS four, 'a b ' || c_name AS collapsed, (c_name LIKE '%001%' OR lower(c_name) LIKE '%mer#%') AS contains, lower(c_mktsegment) = 'building' AS equal,
CASE WHEN c_custkey % 4 = 0 THEN 'Ann Bee' WHEN c_custkey % 2 = 0 THEN 'Ann' ELSE 'unnamed' END AS display, lower(c_mktsegment) LIKE '%auto%' AS either, c_mktsegment LIKE 'BU%' AS prefix, 'a\F\b\S\c\T\d\R\e\E\' || c_name AS escaped, CAST(CASE WHEN c_custkey % 50 = c_custkey % 40 THEN 1.0 ELSE 0.75 END AS DOUBLE) AS overlap,
CASE WHEN c_custkey % 3 <> 0 THEN CAST(c_custkey AS INTEGER) END AS first, CASE WHEN c_custkey % 3 <> 0 THEN CAST(c_custkey + 1 AS INTEGER) END AS second, CASE WHEN c_custkey % 200 < 60 THEN (c_custkey % 200) || 'm' ELSE (c_custkey % 200 // 60) || 'h ' || (c_custkey % 200 % 60) || 'm' END AS wait,
CASE WHEN c_name LIKE '%1' THEN 'one' WHEN regexp_matches(c_name, '[12]') THEN 'some' ELSE 'none' END AS rule, lpad(CAST(c_custkey % 1000 AS VARCHAR), 4, '0') AS padded, printf('%.1f', c_custkey / 10) AS tenths FROM customer""",
    "date_functions": """WITH x AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o, CAST(o_orderkey % 20000 AS INTEGER) AS back, o_orderdate, o_orderkey % 40 AS fwd FROM orders), d AS (SELECT *, o - back AS born, o + CAST(fwd AS INTEGER) AS later FROM x)
SELECT o_orderkey, CASE WHEN o_orderkey % 6 <> 0 THEN CAST(o AS VARCHAR) END AS iso, CAST(o - DATE '1970-01-01' AS BIGINT) AS day_number, round(back / 365.25, 6) AS age, CAST(year(o) - year(born) AS INTEGER) AS age_by_year, CAST(CAST(date_trunc('month', o) - to_months(CAST(o_orderkey % 30 AS INTEGER)) AS DATE) AS VARCHAR) AS anchor, CAST(make_date(year(o), month(o), 15) AS VARCHAR) AS middle,
CAST(CAST(date_trunc('week', o) AS DATE) AS VARCHAR) AS week, CAST(CAST(DATE '2024-06-15' - to_years(CAST(o_orderkey % 80 AS INTEGER)) AS DATE) AS VARCHAR) AS born, strftime(o_orderdate, '%Y%m%d%H%M%S') AS hl7, CAST(o_orderkey % 9 * CASE o_orderkey % 5 WHEN 0 THEN 1 WHEN 1 THEN 7 WHEN 2 THEN 30 WHEN 3 THEN 365 END AS BIGINT) AS days,
CAST(CASE WHEN fwd = 0 THEN 1 WHEN strftime(o, '%Y%m') = strftime(later, '%Y%m') THEN 0.85 WHEN year(o) = year(later) THEN 0.5 ELSE 0 END AS DOUBLE) AS similarity FROM d""",
    "number_functions": """WITH x AS (SELECT *, CAST(c_custkey AS DOUBLE) AS k FROM customer)
SELECT c_custkey, round(CASE WHEN c_custkey % 2 = 0 THEN (k - 500) / 10 END, 6) AS z, round(CASE WHEN c_custkey % 5 <> 0 THEN greatest(10, least(900, k)) END, 6) AS clipped, round(CASE WHEN c_custkey % 3 > 0 THEN k / (c_custkey % 3) ELSE 0 END, 6) AS ratio,
round((c_custkey % 10) / 10 * log2(0.95 / 0.005) + (1 - (c_custkey % 10) / 10) * log2(0.05 / 0.995), 6) AS weight, round(1 / (1 + exp(-(c_custkey % 20 - 10) / 8)), 6) AS logistic, round((CAST(CAST('0x' || substr(md5(c_custkey || '|3'), 1, 12) AS BIGINT) AS DOUBLE) + 0.5) / 281474976710656, 6) AS uniform,
CASE WHEN c_custkey % 11 = 0 THEN NULL WHEN c_custkey % 400 <= 50 THEN 'Good' WHEN c_custkey % 400 <= 100 THEN 'Moderate' WHEN c_custkey % 400 <= 150 THEN 'Unhealthy for Sensitive Groups' WHEN c_custkey % 400 <= 200 THEN 'Unhealthy' WHEN c_custkey % 400 <= 300 THEN 'Very Unhealthy' ELSE 'Hazardous' END AS band,
CAST(CASE c_mktsegment WHEN 'BUILDING' THEN 0.5 WHEN 'MACHINERY' THEN 0.25 ELSE 0.1 END AS DOUBLE) AS looked_up, CAST(CAST('0x' || substr(sha256(CAST(c_custkey AS VARCHAR)), 64, 1) AS INTEGER) % 8 AS INTEGER) AS bucket, CAST(list_sum(list_transform(string_split(c_name, ''), lambda c : ascii(c))) % 7 AS INTEGER) AS code_bucket FROM x""",
    "one_series": f"WITH {DAILY_SQL} SELECT event_type, CAST(day AS VARCHAR) AS day, n FROM daily WHERE event_type = 'click'",
    "last_sums": f"WITH {DAILY_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day DESC) AS rn FROM daily) SELECT event_type, CAST(sum(n) AS BIGINT) AS total, count(*) AS k FROM r WHERE rn <= 8 GROUP BY 1",
    "station_quality": "WITH s AS (SELECT s_suppkey, CASE WHEN s_suppkey % 9 <> 0 THEN s_suppkey * 37 % 350 END AS aqi FROM supplier) SELECT s_suppkey, aqi, CASE WHEN aqi IS NULL THEN NULL WHEN aqi <= 50 THEN 'Good' WHEN aqi <= 100 THEN 'Moderate' WHEN aqi <= 150 THEN 'Unhealthy for Sensitive Groups' WHEN aqi <= 200 THEN 'Unhealthy' WHEN aqi <= 300 THEN 'Very Unhealthy' ELSE 'Hazardous' END AS category FROM s",
    "latest_values": f"WITH {DAILY_SQL} SELECT event_type, max_by(n, day) AS n, CAST(max(day) AS VARCHAR) AS day FROM daily GROUP BY 1",
    "site_fetch": f"WITH {_SITES_SQL} SELECT 'S2' AS target, CASE WHEN count(*) > 0 THEN 200 ELSE 404 END AS status, count(*) AS n_results FROM store WHERE site_id = 'S2' AND event_type = 'click'",
    "routed_rows": f"WITH {_ASSIGN_SQL}, p(provider_id, site_id, facility) AS (VALUES ('P0a', 'S1', 'clinic'), ('P0b', 'S2', 'lab'), ('P1', 'S1', 'clinic'), ('P2a', 'S3', 'farm')) SELECT ref, site_id, facility FROM assigned JOIN p USING (provider_id)",
    "role_access": "WITH r AS (SELECT event_id, CASE WHEN user_id % 3 = 0 THEN 'clerk' ELSE 'doctor' END AS role, event_type AS resource FROM events), a AS (SELECT *, (role = 'doctor' AND resource IN ('click', 'view')) OR (role = 'clerk' AND resource = 'view') AS allowed FROM r) SELECT *, CASE WHEN allowed THEN 'ACCESS' ELSE 'ACCESS_DENIED' END AS audit FROM a",
    "role_rows": f"WITH {_ASSIGN_SQL} SELECT 'doctor' AS role, count(*) AS n FROM assigned WHERE provider_id = 'P0a' UNION ALL SELECT 'public_health', 0",
    "pointer_tiers": f"WITH {_CONSENT_SQL} SELECT DISTINCT group_id, true AS has_signal, kind AS other_kind, CASE kind WHEN 'supplier' THEN 'trade' ELSE 'person' END AS code_class FROM members WHERE group_id NOT IN (SELECT group_id FROM consents WHERE decision = 'deny')",
    "alerts_for_role": "SELECT event_type AS kind, count(*) AS n FROM events WHERE event_type NOT IN ('purchase', 'click') GROUP BY 1",
    "provider_panels": f"WITH {_ASSIGN_SQL} SELECT provider_id, count(*) AS n, min(ref) AS first_ref FROM assigned GROUP BY 1",
    "staff_list": "SELECT s_suppkey, 'vet' AS role, '3' AS facility FROM supplier WHERE s_suppkey % 2 = 0 AND s_nationkey = 3",
    "masked_members": f"WITH {MEMBERS_SQL} SELECT ref, CAST(NULL AS VARCHAR) AS kind, group_id FROM members",
    "destination_messages": f"""WITH d AS (SELECT o_orderkey AS case_id, 'state' AS destination {_STATUS_CASES} UNION ALL SELECT o_orderkey, 'federal' {_STATUS_CASES} AND o_totalprice > 200000 UNION ALL SELECT o_orderkey, 'animal' {_STATUS_CASES} AND o_orderpriority LIKE '1%')
SELECT case_id, destination, CASE destination WHEN 'state' THEN 'MSH|^~\\&|' || case_id || chr(13) || 'PID|1|state' WHEN 'federal' THEN '{{"case":' || case_id || ',"to":"federal"}}' ELSE 'Notice of case ' || case_id END AS message FROM d""",
    "animal_reports": f"""WITH c AS (SELECT {_CASE} AS case_id, o_orderkey % 2 = 0 AS f, o_orderkey % 3 = 0 AS s, o_orderkey % 5 = 0 AS z, 'S' || (o_orderkey % 10) AS a, o_orderpriority AS p, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS onset {_STATUS_CASES}),
d AS (SELECT *, '[' || array_to_string(list_filter([CASE WHEN f THEN '"aphis"' END, CASE WHEN s THEN '"state_vet"' END, CASE WHEN z THEN '"state_health"' END], lambda x : x IS NOT NULL), ',') || ']' AS dest FROM c)
SELECT case_id, '{{"report_metadata":{{"case_id":"' || case_id || '","report_type":"Confirmed reportable animal disease"}},"disease":{{"name":"' || p || '","is_federal_reportable":' || f || ',"is_state_reportable":' || s || '}},"animal":{{"animal_id":"' || a || '","species":"dog"}},"clinical_information":{{"onset_date":"' || onset || '","case_status":"confirmed"}},"one_health_context":{{"cross_species_sentinel":' || z || '}},"destinations":' || dest || '}}' AS report FROM d""",
    "animal_acks": f"SELECT {_CASE} AS case_id, 'ACK-' || {_CASE} AS ack_id, 'USDA-2024-AZ-' || lpad(CAST(o_orderkey AS VARCHAR), 8, '0') AS agency_case_id, 'received_for_review' AS status {_STATUS_CASES}",
    "report_deadlines": """WITH r(disease_id, human, animal, timeline, notifiable, monitored) AS (VALUES ('1', true, true, 'immediate', NULL, NULL), ('2', true, true, NULL, true, true), ('3', false, true, NULL, false, true), ('4', true, false, NULL, false, false))
SELECT o_orderkey AS case_id, disease_id, o_orderkey % 2 = 0 AS is_animal, coalesce(timeline, CASE WHEN coalesce(notifiable, false) THEN 'notifiable_24h' WHEN coalesce(monitored, false) THEN 'monitored_30d' ELSE 'five_working_days' END) AS deadline FROM orders JOIN r ON disease_id = substr(o_orderpriority, 1, 1) WHERE CASE WHEN o_orderkey % 2 = 0 THEN animal ELSE human END""",
    "order_sets": f"""WITH {MEMBERS_SQL}, o AS (SELECT 'C' || o_custkey AS ref, o_orderkey, substr(o_orderpriority, 1, 1) AS d FROM orders WHERE o_orderstatus <> 'O'), g AS (SELECT o.*, m.group_id FROM o JOIN members m USING (ref)),
own AS (SELECT ref, count(*) AS k, min_by(d, o_orderkey) FILTER (d IN ('1', '4')) AS d FROM o GROUP BY 1), grp AS (SELECT group_id, min_by(d, o_orderkey) FILTER (d IN ('1', '4')) AS d FROM g GROUP BY 1)
SELECT ref, disease_id FROM (SELECT m.ref, CASE WHEN own.k > 0 THEN own.d ELSE grp.d END AS disease_id FROM members m LEFT JOIN own USING (ref) LEFT JOIN grp USING (group_id) WHERE kind = 'customer') WHERE disease_id IS NOT NULL""",
    "triage_steps": """WITH p AS (SELECT *, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 ELSE 0 END AS place FROM events), l AS (SELECT *, lag(place, 1, 1) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM p)
SELECT event_type, place = before + 1 AS is_legal, count(*) AS n FROM l GROUP BY 1, 2""",
    "generated_members": f"""WITH g AS (SELECT c_custkey AS group_id, CAST(1 + floor({_U.format(key="c_custkey || '|a'")} * 4) AS INTEGER) AS p, CAST(floor({_U.format(key="c_custkey || '|b'")} * 4) AS INTEGER) AS a FROM customer)
SELECT group_id, 'person/' || group_id || '/' || i AS ref, 'person' AS kind FROM g, range(1, 5) r(i) WHERE i <= p UNION ALL SELECT group_id, 'animal/' || group_id || '/' || i, 'animal' FROM g, range(1, 5) r(i) WHERE i <= a""",
    "generated_series": f"""WITH g AS (SELECT s_suppkey AS region, CAST(p.range AS INTEGER) AS period, round(10.0::DOUBLE * (0.8 + 0.4 * {_U.format(key="s_suppkey || '|' || p.range")}), 3) AS v FROM supplier, range(1, 27) p)
SELECT region, period, round(CASE WHEN region = 3 AND period > 22 THEN v * 5.2 ELSE v END, 3) AS value FROM g""",
    "generated_picks": f"""WITH n AS (SELECT n_name, sum(n_nationkey % 3) OVER (ORDER BY n_name ROWS UNBOUNDED PRECEDING) AS upto, n_nationkey % 3 AS w FROM nation), t AS (SELECT sum(w) AS total FROM n),
u AS (SELECT c_custkey, {_U.format(key='c_custkey')} * total AS u FROM customer, t) SELECT c_custkey, min_by(n_name, n_name) FILTER (upto > u) AS n_name FROM u, n GROUP BY 1""",
    "provenance_records": """SELECT doc_id, '{"resourceType":"Provenance","sourceDigest":"' || sha256(coalesce(text, '')) || '","sourceLength":' || length(coalesce(text, '')) || '}' AS provenance FROM documents""",
}
