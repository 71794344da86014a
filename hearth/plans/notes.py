"""Clinical notes: typed measurements, lexicons, entities with cues, persons, bundles and scores, over notes written from the orders' numbers.

The documents of the driver hold no clinical text, so each order becomes a note
whose facts are known from its key.  The SQL states those facts and their places;
it uses no pattern, and so holds the extractors to planted truth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth.operators import messages, notes, spans, text
from hearth.plans import plain
from hearth.plans.views import read
from hearth.session import stored_bytes

#: Stored bytes of orders for each task that works on their notes.
STORED = 256 << 10
SEXES = [("woman", "female"), ("man", "male"), ("lady", "female"), ("gentleman", "male")]
UNITS = [("day", 1), ("week", 7), ("month", 30), ("year", 365)]
TICKS = ["Denies tick bite", "Reports tick bite", "Possible tick exposure"]
#: (text, kind, code, phrase, negated, uncertain) by the key modulo 3: the end of a note and the entities in it.
ENDS = [
    ("Suspected valley fever, no cough. Started doxycycline.", [("condition", "C1", "valley fever", False, True), ("symptom", "S2", "cough", True, True), ("medication", "M1", "doxycycline", False, False)]),
    ("Reports fever and COUGH w/o rash. Rule out q fever.", [("symptom", "S1", "fever", False, False), ("symptom", "S2", "COUGH", False, False), ("symptom", "S3", "rash", False, False), ("condition", "C2", "q fever", False, True)]),
    ("Negative for coxiellosis. R/o cocci, not febrile.", [("condition", "C2", "coxiellosis", True, False), ("condition", "C1", "cocci", False, True), ("symptom", "S1", "febrile", True, True)]),
]
TERMS = [(1, "condition", "C1", "Coccidioidomycosis (Valley fever)"), (2, "condition", "C2", "Coxiellosis (Q fever)"), (3, "symptom", "S1", "Fever"), (4, "symptom", "S2", "Cough"), (5, "symptom", "S3", "Rash"), (6, "medication", "M1", "Doxycycline 100 mg")]
#: For terms made from parts: the second overrides nothing, as no part is called so.
PART_SYNONYMS = [(1, "part", "promo", "Small"), (2, "part", "none such", "Plague")]
SYNONYMS = [(1, "condition", "cocci", "Coccidioidomycosis"), (2, "symptom", "febrile", "Fever"), (3, "condition", "none such", "Plague")]


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text): a note for each order."""
    k = F.col("o_orderkey")

    def pick(values: list[str], by) -> F.Column:
        return F.element_at(F.array(*map(F.lit, values)), (by % len(values)).cast("int") + 1)

    n = 1 + k % 9
    about = F.concat((18 + k % 70).cast("string"), F.lit("-year-old "), pick([s for s, _ in SEXES], k), F.lit(" seen for "), n.cast("string"), F.lit(" "), pick([u for u, _ in UNITS], k), F.when(n > 1, "s").otherwise(""), F.lit(".  "))
    measured = F.concat(F.lit("BP "), (100 + k % 60).cast("string"), F.lit("/"), (60 + k % 30).cast("string"), F.lit(", HR "), (55 + k % 80).cast("string"), F.lit(", RR "), (12 + k % 15).cast("string"), F.lit(", T "), (97 + k % 6).cast("string"), F.lit("."), (k % 10).cast("string"), F.lit(", SpO2 "), (90 + k % 10).cast("string"), F.lit("%.\n"))
    # notes cost much more than their keys: tasks of as many rows at any size
    parts = max(spark.sparkContext.defaultParallelism, stored_bytes(spark, f"{sf_dir}/orders.parquet") // STORED)
    return read(spark, sf_dir, "orders").select("o_orderkey").repartition(parts, F.xxhash64("o_orderkey")).select(k.alias("doc_id"), F.concat(about, measured, pick(TICKS, k), F.lit(". "), pick([e for e, _ in ENDS], k)).alias("text"))


def _lexicon(spark: SparkSession) -> DataFrame:
    terms = spark.createDataFrame(TERMS, "ordinal int, kind string, code string, display string")
    synonyms = spark.createDataFrame(SYNONYMS, "ordinal int, kind string, surface string, canonical string")
    plainly = notes.lexicon(terms.where("kind <> 'medication'"), synonyms)
    return plainly.unionByName(notes.lexicon(terms.where("kind = 'medication'"), first_word=True))


def lexicon_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phrases that parts are known by: their displays, both names in them, a first word and a synonym."""
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("ordinal"), F.when(F.col("p_size") > 45, "large").otherwise("part").alias("kind"), F.col("p_brand").alias("code"), F.concat("p_name", F.lit(" ("), "p_type", F.lit(")")).alias("display"))
    plainly = notes.lexicon(p.where("kind = 'part'"), spark.createDataFrame(PART_SYNONYMS, "ordinal int, kind string, surface string, canonical string"))
    return plainly.unionByName(notes.lexicon(p.where("kind = 'large'"), first_word=True))


def note_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.measures(_notes(spark, sf_dir))


def note_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexicon entities that lie in no longer one, with cues before them."""
    lexicons: dict[str, dict[str, str]] = {}
    for r in _lexicon(spark).collect():  # a vocabulary
        lexicons.setdefault(r.kind, {})[r.phrase] = r.code
    how = text.Extraction(lexicons=lexicons, negations=notes.NEGATIONS, hedges=notes.HEDGES)
    return text.uncontained(text.entities(_notes(spark, sf_dir), how)).drop("attributes")


def note_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = note_measures(spark, sf_dir).where("kind = 'Demographic'")
    rows = found.select("doc_id", F.when(F.col("name") == "age", "age").otherwise("gender").alias("kind"), F.col("name").alias("text"), "char_start", "char_end", F.create_map(F.lit("value"), F.col("value").cast("int").cast("string")).alias("attributes"))
    return messages.person(rows, F.lit("2024-06-15").cast("date")).select("doc_id", "age", "gender", "birth_date")


def note_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = note_entities(spark, sf_dir).withColumn("attributes", F.lit(None).cast("map<string,string>"))
    return messages.bundle(messages.resource(found))


def note_authorship(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = note_entities(spark, sf_dir).withColumn("attributes", F.lit(None).cast("map<string,string>"))
    return messages.authorship(messages.resource(found))


def note_span_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities against themselves with places moved by doc_id modulo 5: matched within three characters."""
    found = note_entities(spark, sf_dir).select("doc_id", "kind", "char_start", "char_end")
    by = (F.col("doc_id") % 5).cast("int")
    gold = found.where("kind <> 'symptom' OR doc_id % 2 = 0").withColumns({"char_start": F.col("char_start") + by, "char_end": F.col("char_end") + by})
    return spans.scores(spans.matched(gold, found), ["kind"])


def note_overlap_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities against themselves with places moved by doc_id modulo 6: matched if they overlap."""
    found = note_entities(spark, sf_dir).select("doc_id", "kind", "char_start", "char_end")
    by = (F.col("doc_id") % 6).cast("int")
    gold = found.withColumns({"char_start": F.col("char_start") + by, "char_end": F.col("char_end") + by})
    return spans.scores(spans.matched(gold, found, overlap=True), ["kind"])


def note_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The simple gold annotation: longest phrases first, cues within so many characters before."""
    lexicons: dict[str, dict[str, str]] = {}
    for r in _lexicon(spark).collect():  # a vocabulary
        lexicons.setdefault(r.kind, {})[r.phrase] = r.code
    return text.gold(_notes(spark, sf_dir), lexicons, notes.NEGATIONS, notes.HEDGES)


def note_low_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities under .8, with a reviewer's decision where there is one."""
    found = note_entities(spark, sf_dir)
    decided = found.where("doc_id % 4 = 0").select("doc_id", "char_start", "char_end", "kind", F.lit("kept").alias("decision"))
    return text.handed_back(found, decided, 0.8).groupBy("kind", "decision").agg(F.count("*").alias("n"))


def _case(key: str, values: list[str]) -> str:
    return f"CASE {key} % {len(values)} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


_NOTE_SQL = f"""k AS (SELECT o_orderkey AS doc_id, 18 + o_orderkey % 70 AS age, {_case('o_orderkey', [s for s, _ in SEXES])} AS word, {_case('o_orderkey', [g for _, g in SEXES])} AS gender,
  1 + o_orderkey % 9 AS n, {_case('o_orderkey', [u for u, _ in UNITS])} AS unit, {_case('o_orderkey', [str(d) for _, d in UNITS])} AS days, 100 + o_orderkey % 60 AS sys, 60 + o_orderkey % 30 AS dia, 55 + o_orderkey % 80 AS hr, 12 + o_orderkey % 15 AS rr,
  (97 + o_orderkey % 6) || '.' || (o_orderkey % 10) AS temp, 90 + o_orderkey % 10 AS spo2, {_case('o_orderkey', TICKS)} AS tick, {_case('o_orderkey', [e for e, _ in ENDS])} AS tail FROM orders),
s AS (SELECT *, 'for ' || n || ' ' || unit || CASE WHEN n > 1 THEN 's' ELSE '' END AS dur FROM k),
p AS (SELECT *, length(age || '-year-old ' || word || ' seen ') AS at_dur, length(age || '-year-old ' || word || ' seen ' || dur || '. ') AS at_bp FROM s),
q AS (SELECT *, at_bp + length('BP ' || sys || '/' || dia || ', ') AS at_hr FROM p),
v AS (SELECT *, at_hr + length('HR ' || hr || ', ') AS at_rr, at_hr + length('HR ' || hr || ', RR ' || rr || ', ') AS at_t, at_hr + length('HR ' || hr || ', RR ' || rr || ', T ' || temp || ', ') AS at_o FROM q),
t AS (SELECT *, at_o + length('SpO2 ' || spo2 || '%. ') AS at_tick, at_o + length('SpO2 ' || spo2 || '%. ' || tick || '. ') AS at_tail FROM v)"""


def _fact(kind: str, name: str, said: str, at: str, value: str, value2: str, unit: str, confidence: float, negated: str = "false", uncertain: str = "false") -> str:
    return f"SELECT doc_id, '{kind}' AS kind, {name} AS name, {said} AS said, CAST({at} AS INTEGER) AS char_start, CAST({at} + length({said}) AS INTEGER) AS char_end, CAST({value} AS DOUBLE) AS value, CAST({value2} AS DOUBLE) AS value2, {unit} AS unit, {negated} AS negated, {uncertain} AS uncertain, CAST({confidence} AS DOUBLE) AS confidence FROM t"


_FACTS = [
    _fact("Demographic", "'age'", "age || '-year-old'", "0", "age", "NULL", "NULL", 0.97), _fact("Demographic", "gender", "word", "length(age || '-year-old ')", "NULL", "NULL", "NULL", 0.9),
    _fact("Duration", "'duration'", "dur", "at_dur", "n", "n * CAST(days AS INTEGER)", "unit", 0.85), _fact("Vital", "'blood_pressure'", "'BP ' || sys || '/' || dia", "at_bp", "sys", "dia", "'mmHg'", 0.97),
    _fact("Vital", "'heart_rate'", "'HR ' || hr", "at_hr", "hr", "NULL", "'bpm'", 0.97), _fact("Vital", "'respiratory_rate'", "'RR ' || rr", "at_rr", "rr", "NULL", "'/min'", 0.97),
    _fact("Vital", "'temperature_f'", "'T ' || temp", "at_t", "temp", "NULL", "'F'", 0.97), _fact("Vital", "'spo2'", "'SpO2 ' || spo2", "at_o", "spo2", "NULL", "'%'", 0.97),
    _fact("Exposure", "'tick_exposure'", "substr(tick, strpos(tick, 'tick'))", "at_tick + strpos(tick, 'tick') - 1", "NULL", "NULL", "NULL", 0.75, "tick LIKE 'Denies%'", "tick LIKE 'Possible%'"),
]
_ENTITY_FACTS = ", ".join(
    f"({i}, '{kind}', '{code}', '{said}', {end.index(said)}, {end.index(said) + len(said)}, {str(no).lower()}, {str(maybe).lower()}, {0.88 if len(said) > 6 else 0.78})" for i, (end, found) in enumerate(ENDS) for kind, code, said, no, maybe in found
)
_ENTITY_SQL = f"""{_NOTE_SQL}, f(m, kind, code, text, a, b, negated, uncertain, confidence) AS (VALUES {_ENTITY_FACTS}),
e AS (SELECT doc_id, kind, f.text, CAST(at_tail + a AS INTEGER) AS char_start, CAST(at_tail + b AS INTEGER) AS char_end, code, negated, uncertain, CAST(confidence AS DOUBLE) AS confidence FROM t JOIN f ON m = doc_id % {len(ENDS)})"""
_RESOURCE_SQL = """r AS (SELECT *, CASE kind WHEN 'condition' THEN 'Condition' WHEN 'medication' THEN 'MedicationStatement' ELSE 'Observation' END AS rt FROM e),
j AS (SELECT *, '{"resourceType":"' || rt || '","code":"' || code || '"' || CASE WHEN rt = 'Condition' THEN ',"verificationStatus":"' || CASE WHEN negated THEN 'refuted' WHEN uncertain THEN 'provisional' ELSE 'confirmed' END || '"' ELSE '' END
  || CASE WHEN kind = 'symptom' THEN ',"valueBoolean":' || CASE WHEN negated THEN 'false' ELSE 'true' END ELSE '' END || ',"provenance":{"authorship":"ai-extracted","confidence":' || confidence || ',"text":"' || text || '","char_start":' || char_start || ',"char_end":' || char_end || '}}' AS resource FROM r)"""

QUERIES = {f.__name__: plain(f) for f in (lexicon_terms, note_measures, note_entities, note_persons, note_bundles, note_authorship, note_span_scores, note_overlap_scores, note_gold, note_low_confidence)}
ORACLES = {
    "lexicon_terms": """WITH p AS (SELECT p_partkey AS i, CASE WHEN p_size > 45 THEN 'large' ELSE 'part' END AS kind, p_brand AS code, p_name, p_type, p_name || ' (' || p_type || ')' AS display FROM part),
every AS (SELECT lower(display) AS phrase, kind, 1 AS o, -i AS i, code, display FROM p UNION ALL SELECT lower(p_name), kind, 2, i, code, display FROM p UNION ALL SELECT lower(p_type), kind, 2, i, code, display FROM p
  UNION ALL SELECT string_split(lower(p_name), ' ')[1], kind, 1, -i, code, display FROM p WHERE kind = 'large' UNION ALL (SELECT 'promo', kind, 0, 0, code, display FROM p WHERE kind = 'part' AND lower(display) LIKE 'small%' ORDER BY i LIMIT 1))
SELECT phrase, kind, code, display FROM (SELECT *, row_number() OVER (PARTITION BY kind, phrase ORDER BY o, i) AS rn FROM every) WHERE rn = 1""",
    "note_measures": f"WITH {_NOTE_SQL} {' UNION ALL '.join(_FACTS)}",
    "note_entities": f"WITH {_ENTITY_SQL} SELECT * FROM e",
    "note_persons": f"WITH {_NOTE_SQL} SELECT doc_id, CAST(age AS INTEGER) AS age, gender, CAST(CAST(DATE '2024-06-15' - to_years(CAST(age AS INTEGER)) AS DATE) AS VARCHAR) AS birth_date FROM t",
    "note_bundles": f"""WITH {_ENTITY_SQL}, {_RESOURCE_SQL} SELECT doc_id, count(*) AS n_resources, '{{"resourceType":"Bundle","type":"collection","entry":[' || string_agg(resource, ',' ORDER BY char_start, char_end) || ']}}' AS bundle FROM j GROUP BY 1""",
    "note_authorship": f"WITH {_ENTITY_SQL}, {_RESOURCE_SQL} SELECT rt AS resource_type, count(*) AS n, round(avg(confidence), 6) AS mean_confidence FROM j GROUP BY 1",
    "note_span_scores": f"""WITH {_ENTITY_SQL}, o AS (SELECT kind, kind <> 'symptom' OR doc_id % 2 = 0 AS gold, doc_id % 5 < 4 AS near FROM e),
c AS (SELECT kind, count(*) FILTER (gold AND near) AS tp, count(*) FILTER (NOT (gold AND near)) AS fp, count(*) FILTER (gold AND NOT near) AS fn FROM o GROUP BY ROLLUP (kind))
SELECT kind, tp, fp, fn, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1 FROM c""",
    "note_overlap_scores": f"""WITH {_ENTITY_SQL}, o AS (SELECT kind, doc_id % 6 < length(text) AS near FROM e),
c AS (SELECT kind, count(*) FILTER (near) AS tp, count(*) FILTER (NOT near) AS fp, count(*) FILTER (NOT near) AS fn FROM o GROUP BY ROLLUP (kind))
SELECT kind, tp, fp, fn, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall, 2 * tp / (2 * tp + fp + fn) AS f1 FROM c""",
    "note_gold": f"""WITH {_ENTITY_SQL}, x AS (SELECT e.doc_id, e.kind, code, char_start, char_end, lower(age || '-year-old ' || word || ' seen ' || dur || '. BP ' || sys || '/' || dia || ', HR ' || hr || ', RR ' || rr || ', T ' || temp || ', SpO2 ' || spo2 || '%. ' || tick || '. ' || tail) AS low FROM e JOIN t USING (doc_id)),
w AS (SELECT *, low[greatest(char_start - 29, 1):char_start] AS n30, low[greatest(char_start - 49, 1):char_start] AS n50 FROM x)
SELECT doc_id, kind, code, char_start, char_end, {' OR '.join(f"strpos(n30, '{c}') > 0" for c in notes.NEGATIONS)} AS negated, {' OR '.join(f"strpos(n50, '{c}') > 0" for c in notes.HEDGES)} AS uncertain FROM w""",
    "note_low_confidence": f"WITH {_ENTITY_SQL} SELECT kind, CASE WHEN doc_id % 4 = 0 THEN 'kept' ELSE 'pending' END AS decision, count(*) AS n FROM e WHERE confidence < 0.8 GROUP BY 1, 2",
}
