"""Messages and bundles as string columns: HL7 v2 lines, JSON payloads, FHIR bundles, acknowledgements, workflow state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearth.functions.dates import hl7_time
from hearth.functions.strings import hl7_escape


def segment(name: str, *fields: Column | str) -> Column:
    """One HL7 segment; plain strings are literal, columns are escaped."""
    return F.concat_ws("|", F.lit(name), *[F.lit(f) if isinstance(f, str) else hl7_escape(f) for f in fields])


def joined(*segments: Column) -> Column:
    """Segments parted by carriage returns; arrays of segments are spliced in."""
    return F.concat_ws("\r", *segments)


def lab_report(rows: DataFrame, sender: str, receiver: str, case_id: Column, member: Column, name: Column, code: Column, label: Column, onset: Column, observations: Column) -> DataFrame:
    """A laboratory report as `message`; observations is array<struct<code, value, unit>>."""
    at = hl7_time(onset)
    lines = F.transform(observations, lambda o, i: F.concat_ws("|", F.lit("OBX"), (i + 1).cast("string"), F.lit("NM"), hl7_escape(o["code"]), F.lit(""), hl7_escape(o["value"]), hl7_escape(o["unit"]), F.lit("F")))
    return rows.withColumn(
        "message",
        joined(
            segment("MSH", "^~\\&", sender, "", receiver, "", at, "", "ORU^R01^ORU_R01", case_id, "P", "2.5.1"),
            segment("SFT", sender, "1"),
            segment("PID", "1", "", member, "", name),
            segment("PV1", "1", "O"),
            segment("ORC", "RE", case_id),
            segment("OBR", "1", "", case_id, code, "", at),
            lines,
            segment("SPM", "1", case_id),
            segment("NTE", "1", "", label),
        ),
    )


def acknowledgement(rows: DataFrame, case_id: Column, receiver: Column) -> DataFrame:
    """One acknowledgement for each row, its id from the case and the receiver."""
    return rows.withColumn("ack_id", F.concat(F.lit("ACK-"), F.substring(F.sha2(F.concat_ws("|", case_id.cast("string"), receiver), 256), 1, 12))).withColumn("ack_status", F.lit("AA"))


def payload(fields: dict[str, Column]) -> Column:
    """A JSON object; fields without a value are left out."""
    return F.to_json(F.struct(*[c.alias(name) for name, c in fields.items()]))


def for_destination(destination: Column, hl7: Column, json: Column, hl7_targets: list[str], json_targets: list[str], notice: Column) -> Column:
    return F.when(destination.isin(hl7_targets), hl7).when(destination.isin(json_targets), json).otherwise(notice)


def submitted(cases: DataFrame, destinations: Column, case_id: str) -> DataFrame:
    """A row for each case and destination, with its acknowledgement."""
    rows = cases.select(F.col(case_id), F.explode(destinations).alias("destination"))
    return acknowledgement(rows, F.col(case_id), F.col("destination")).withColumn("state", F.lit("submitted"))


def current_state(events: DataFrame, key: str, seq: str, state: str, start: str) -> DataFrame:
    """The last state of each key and how many steps it took; the start state if the last is null."""
    return events.groupBy(key).agg(F.coalesce(F.max_by(state, seq), F.lit(start)).alias("state"), F.count("*").alias("n_steps"))


def legal_steps(events: DataFrame, key: str, seq: str, state: str, order: list[str]) -> DataFrame:
    """Each step with whether it goes on by one in the order of states."""
    from pyspark.sql import Window

    place = F.array_position(F.array(*map(F.lit, order)), F.col(state))
    before = F.lag(place, 1, 1).over(Window.partitionBy(key).orderBy(seq))
    return events.withColumn("is_legal", place == before + 1)


def resource(found: DataFrame, refute_negated: bool = True) -> DataFrame:
    """A FHIR-like resource as JSON for each entity: conditions, symptoms, measurements, exposures, medications."""
    provenance = F.struct(F.lit("ai-extracted").alias("authorship"), F.round("confidence", 3).alias("confidence"), F.col("text").alias("text"), "char_start", "char_end")
    kind = F.when(F.col("kind") == "condition", "Condition").when(F.col("kind") == "medication", "MedicationStatement").otherwise("Observation")
    status = F.when(F.lit(refute_negated) & F.col("negated"), "refuted").when(F.col("uncertain"), "provisional").otherwise("confirmed")
    body = F.struct(kind.alias("resourceType"), F.col("code"), F.when(kind == "Condition", status).alias("verificationStatus"), F.when(F.col("kind") == "symptom", ~F.col("negated")).alias("valueBoolean"), F.when(F.size("attributes") > 0, F.col("attributes")).alias("value"), provenance.alias("provenance"))
    return found.withColumn("resource_type", kind).withColumn("resource", F.to_json(body))


def bundle(resources: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One bundle for each document, its resources in text order (a document's own entities bound the array)."""
    entries = F.sort_array(F.collect_list(F.struct("char_start", "char_end", "resource")))
    return resources.groupBy(id_col).agg(F.count("*").alias("n_resources"), F.concat(F.lit('{"resourceType":"Bundle","type":"collection","entry":['), F.array_join(F.transform(entries, lambda e: e["resource"]), ","), F.lit("]}")).alias("bundle"))


def authorship(resources: DataFrame) -> DataFrame:
    return resources.groupBy("resource_type").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


def person(found: DataFrame, as_of: Column, id_col: str = "doc_id") -> DataFrame:
    """One person for each document from its first age and first gender (entities of kind age and gender, in text order)."""
    order = F.struct("char_start", "char_end")

    def first(kind: str, value: Column) -> Column:
        return F.min_by(F.when(F.col("kind") == kind, value), F.when(F.col("kind") == kind, order))

    firsts = found.groupBy(id_col).agg(first("age", F.col("attributes")["value"].try_cast("int")).alias("age"), first("gender", F.lower("text")).alias("gender"))
    return firsts.withColumn("birth_date", F.add_months(as_of, -12 * F.col("age"))).where("age IS NOT NULL OR gender IS NOT NULL")


def provenance(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """A provenance record for each document: a digest of the whole source text and its length."""
    return docs.select(id_col, F.to_json(F.struct(F.lit("Provenance").alias("resourceType"), F.sha2(F.coalesce(text, F.lit("")), 256).alias("sourceDigest"), F.length(F.coalesce(text, F.lit(""))).alias("sourceLength"))).alias("provenance"))


def animal_report(cases: DataFrame) -> DataFrame:
    """A report of an animal case as JSON, with where it goes: the federal service, the state veterinarian, and state health for what can pass to people.

    cases: case_id, animal_id, species, disease, federal, state, zoonotic, onset.
    """
    to = F.array_compact(F.array(F.when(F.col("federal"), "aphis"), F.when(F.col("state"), "state_vet"), F.when(F.col("zoonotic"), "state_health")))
    parts = {
        "report_metadata": F.struct("case_id", F.lit("Confirmed reportable animal disease").alias("report_type")),
        "disease": F.struct(F.col("disease").alias("name"), F.col("federal").alias("is_federal_reportable"), F.col("state").alias("is_state_reportable")),
        "animal": F.struct("animal_id", "species"),
        "clinical_information": F.struct(F.col("onset").alias("onset_date"), F.lit("confirmed").alias("case_status")),
        "one_health_context": F.struct(F.col("zoonotic").alias("cross_species_sentinel")),
        "destinations": to,
    }
    return cases.withColumn("report", payload(parts))


def animal_acknowledgement(cases: DataFrame, year: int) -> DataFrame:
    """The agency's receipt: its own case number from the year and the end of ours."""
    number = F.concat(F.lit(f"USDA-{year}-AZ-"), F.expr("right(case_id, 8)"))
    return cases.select("*", F.concat(F.lit("ACK-"), "case_id").alias("ack_id"), number.alias("agency_case_id"), F.lit("received_for_review").alias("status"))


def reportable(cases: DataFrame, rules: DataFrame) -> DataFrame:
    """Cases (case_id, disease_id, is_animal) that must be reported for their kind of subject, with the class of their deadline.

    rules: disease_id, human and animal (reportable for either), timeline, notifiable, monitored.
    """
    deadline = F.coalesce("timeline", F.when(F.col("notifiable"), "notifiable_24h").when(F.col("monitored"), "monitored_30d").otherwise("five_working_days"))
    return cases.join(rules, "disease_id").where(F.when(F.col("is_animal"), F.col("animal")).otherwise(F.col("human"))).select(*cases.columns, deadline.alias("deadline"))


def detected(who: DataFrame, conditions: DataFrame, with_orders: list[str]) -> DataFrame:
    """(ref, disease_id): the first of a member's own conditions that has an order set; of its group's if it has no condition at all.

    who: ref, group_id; conditions: ref, group_id, ordinal, disease_id.
    """
    first = F.min_by("disease_id", F.when(F.col("disease_id").isin(with_orders), F.col("ordinal")))
    own = conditions.groupBy("ref").agg(first.alias("own"), F.lit(True).alias("has"))
    group = conditions.groupBy("group_id").agg(first.alias("near"))
    found = who.join(own, "ref", "left").join(group, "group_id", "left")
    return found.select("ref", F.when(F.col("has"), F.col("own")).otherwise(F.col("near")).alias("disease_id")).where("disease_id IS NOT NULL")
