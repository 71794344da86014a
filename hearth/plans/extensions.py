"""Look-ups by containment, keyed state, replayed logs, pruned site stores, table functions, variants and collations over the driver's tables."""

from __future__ import annotations

import json
import uuid

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth.functions import paths, tables
from hearth.functions.strings import by_locale
from hearth.operators import lookup, members as member_ops, notes, text
from hearth.plans import exchange, few_rows, plain
from hearth.plans import notes as note_plans
from hearth.plans.exchange import _SITES_SQL
from hearth.plans.views import read
from hearth.session import PUSHED_FILTERS, STATE_STORE, own_session, scratch_dir
from hearth.sources import site_store, writers
from hearth.streaming import live

#: Characters of an item that a document must hold, and of a condition's text that a disease's name must hold.
PHRASE, PREFIX = 60, 14
PATHS = ["$.message.body.text", "$.body.text", "$.text"]


def _folder(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def phrase_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold the beginning of a benchmark item, byte for byte."""
    items = read(spark, sf_dir, "benchmark").select("item_id", F.substring("text", 1, PHRASE).alias("phrase"))
    return lookup.containing(read(spark, sf_dir, "documents").select("doc_id", "text"), "text", items, "phrase")


def _diseases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ordinal, name, code): part names in the order of their first part."""
    return read(spark, sf_dir, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("ordinal"), F.min_by("p_brand", "p_partkey").alias("code"))


def _conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, embedded, code, text): every tenth has a disease's number of its own, every third a code, some a text."""
    k = F.col("p_partkey")
    return read(spark, sf_dir, "part").select(k.alias("key"), F.when(k % 10 == 0, k % 7).alias("embedded"), F.when(k % 3 == 0, F.col("p_brand")).alias("code"), F.when(k % 4 != 1, F.substring(F.upper(F.substring("p_name", 4, 40)), 1, PREFIX)).alias("text"))


def priority_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The disease of each condition: by its own number, else the first by code or by text within the name, case ignored."""
    diseases, rows = _diseases(spark, sf_dir), _conditions(spark, sf_dir)
    own = rows.select("key", F.col("embedded").alias("ordinal")).join(diseases.select("ordinal", "name"), "ordinal")
    coded = rows.select("key", "code").join(diseases, "code").select("key", "ordinal", "name")
    names = diseases.select("ordinal", "name", F.lower("name").alias("low"))
    told = lookup.containing(names, "low", rows.select("key", F.lower("text").alias("said")), "said")
    return lookup.prioritised(rows.select("key"), "key", [(0, own), (1, coded), (1, told)], "name")


def keyed_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last event of every user from a stream of four batches, each with events of all times."""
    own, folder = own_session(spark, **STATE_STORE), _folder(spark, "states")
    events = read(own, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    events.withColumn("part", F.pmod(F.xxhash64("event_id"), F.lit(4))).repartition("part").write.partitionBy("part").parquet(f"{folder}/events")
    found = live.keyed_states(live.read_files(own, f"{folder}/events", events.schema, "*.parquet"), "user_id", "ts", "event_id", "event_type", "3650 days", 86_400_000)
    updates = live.logged(found, f"{folder}/updates", f"{folder}/checkpoint", mode="update")
    return updates.groupBy("user_id").agg(F.max_by(F.struct("state", "n_states", "place"), "n_steps").alias("s"), F.max("n_steps").alias("n_steps")).select("user_id", "s.state", "s.place", "n_steps", "s.n_states")


def replayed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by kind from a log whose second batch failed after it was written and was run again, and how many batches a listener heard of."""
    folder = _folder(spark, "log")
    events = read(spark, sf_dir, "events").select("event_id", "event_type", "value")
    events.withColumn("part", F.col("event_id") % 3).repartition("part").write.partitionBy("part").parquet(f"{folder}/events")
    heard: list[int] = []

    def listen(rows: DataFrame, batch: int) -> None:
        heard.append(batch)
        if batch == 1 and heard.count(1) == 1:
            raise RuntimeError("a listener fails once")

    def run() -> DataFrame:
        return live.logged(live.read_files(spark, f"{folder}/events", events.schema, "*.parquet"), f"{folder}/log", f"{folder}/checkpoint", [listen])

    try:
        run()
    except StreamingQueryException:
        pass
    log = run()
    again = len(heard) - len(set(heard))
    return log.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).withColumn("n_replayed", F.lit(again))


def site_store_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large events of two of three sites, from a store of which only their folders are opened."""
    own, folder = own_session(spark, **PUSHED_FILTERS), _folder(spark, "store")
    store = exchange._sites(own, sf_dir).select("event_id", "user", "event_type", "value", "site_id")
    writers.write_sites(store, folder)
    found = site_store.opened(own, folder, "event_id long, user string, event_type string, value double, site_id string")
    return found.where("site_id IN ('S1', 'S3') AND value > 50")


def note_entities_by_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """note_entities by the table function of that name, in SQL."""
    own = own_session(spark)
    tables.register(own)
    lexicons: dict[str, dict[str, str]] = {}
    for r in note_plans._lexicon(own).collect():  # a vocabulary
        lexicons.setdefault(r.kind, {})[r.phrase] = r.code
    how = json.dumps({"lexicons": lexicons, "negations": notes.NEGATIONS, "hedges": notes.HEDGES})
    text.normalised(note_plans._notes(own, sf_dir), "text").createOrReplaceTempView("notes")
    return text.uncontained(own.sql("SELECT * FROM note_entities(TABLE(notes), :how)", {"how": how})).drop("attributes")


def group_fit_by_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line through discount and price of each return flag's line items: a table function sums each flag's rows in as many parts as shuffles have, another fits the sums."""
    own = own_session(spark)
    tables.register(own)
    parts = int(own.conf.get("spark.sql.shuffle.partitions"))
    part = F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(parts)).cast("string").alias("part")
    read(own, sf_dir, "lineitem").select("l_returnflag", part, (F.col("l_extendedprice") / 1000).alias("price"), F.col("l_quantity").alias("quantity")).createOrReplaceTempView("items")
    found = own.sql("SELECT * FROM group_solved(TABLE(SELECT * FROM group_sums(TABLE(SELECT * FROM items) PARTITION BY (l_returnflag, part), 'price')) PARTITION BY (l_returnflag))")
    return found.select("n", F.round(F.col("coefficients")[0], 5).alias("slope"), F.round(F.col("coefficients")[1], 4).alias("constant"))


def fallback_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of every turn out of documents of three shapes, by the first of three paths that leads to one."""
    c, t = read(spark, sf_dir, "conversations"), F.struct(F.col("text").alias("text"))
    shape = F.when(F.col("turn") % 4 == 0, F.to_json(F.struct(F.struct(t.alias("body")).alias("message")))).when(F.col("turn") % 4 == 1, F.to_json(F.struct(t.alias("body"), F.col("role").alias("message")))).when(F.col("turn") % 4 == 2, F.to_json(F.struct("text", F.array("turn").alias("body")))).otherwise(F.concat(F.lit("no JSON "), F.col("role")))
    v = paths.parsed(shape)
    return c.select("conv_id", "turn", paths.which(v, PATHS).alias("step"), F.md5(paths.first_of(v, PATHS, default="none")).alias("text_md5"))


def _words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct words of letters that documents begin with."""
    first = F.regexp_extract("text", r"^([A-Za-zÀ-ÖØ-öø-ÿ]+)", 1)
    return read(spark, sf_dir, "documents").select(first.alias("word")).where("word <> ''").distinct()


def collated_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First words in the locale's order: how many of them stand before each, case ignored."""
    words = _words(spark, sf_dir)
    sizes = words.groupBy(by_locale(F.col("word")).alias("name")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(member_ops.Window.orderBy("name").rowsBetween(member_ops.Window.unboundedPreceding, -1)), F.lit(0))
    ranked = sizes.withColumn("n_before", before).withColumnRenamed("n", "n_same")
    return member_ops.named(words, "word", ranked, "name").select("word", "n_before", "n_same")


def collated_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First words beside the lower-case forms that are the same name."""
    words = _words(spark, sf_dir)
    others = words.select(F.lower("word").alias("name")).distinct()
    return member_ops.named(words, "word", others, "name").select("word", F.col("name").cast("string").alias("name"))


QUERIES = {"phrase_hits": plain(few_rows(phrase_hits))} | {f.__name__: plain(f) for f in (priority_lookup, keyed_states, replayed_log, site_store_fetch, note_entities_by_sql, group_fit_by_sql, fallback_paths, collated_order, collated_names)}
_WORDS_SQL = "words AS (SELECT DISTINCT regexp_extract(text, '^([A-Za-zÀ-ÖØ-öø-ÿ]+)', 1) AS word FROM documents WHERE regexp_extract(text, '^([A-Za-zÀ-ÖØ-öø-ÿ]+)', 1) <> '')"
_SHAPES_SQL = """s AS (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN CAST(json_object('message', json_object('body', json_object('text', text))) AS VARCHAR)
  WHEN 1 THEN CAST(json_object('body', json_object('text', text), 'message', role) AS VARCHAR) WHEN 2 THEN CAST(json_object('text', text, 'body', json_array(turn)) AS VARCHAR) ELSE 'no JSON ' || role END AS j FROM conversations),
v AS (SELECT conv_id, turn, CASE WHEN json_valid(j) THEN j ELSE '{}' END AS j FROM s)"""
ORACLES = {
    "phrase_hits": f"SELECT doc_id, item_id FROM documents d JOIN benchmark b ON strpos(d.text, substr(b.text, 1, {PHRASE})) > 0 WHERE b.text <> ''",
    "priority_lookup": f"""WITH d AS (SELECT p_name AS name, min(p_partkey) AS ordinal, min_by(p_brand, p_partkey) AS code FROM part GROUP BY 1),
c AS (SELECT p_partkey AS key, CASE WHEN p_partkey % 10 = 0 THEN p_partkey % 7 END AS embedded, CASE WHEN p_partkey % 3 = 0 THEN p_brand END AS code, CASE WHEN p_partkey % 4 <> 1 THEN lower(substr(substr(p_name, 4, 40), 1, {PREFIX})) END AS said FROM part),
h AS (SELECT key, 0 AS level, d.ordinal, name FROM c JOIN d ON d.ordinal = c.embedded UNION ALL SELECT key, 1, d.ordinal, name FROM c JOIN d ON d.code = c.code OR (said <> '' AND strpos(lower(name), said) > 0)),
b AS (SELECT key, arg_min(name, (level, ordinal)) AS name FROM h GROUP BY 1)
SELECT c.key, b.name FROM c LEFT JOIN b ON b.key = c.key""",
    "keyed_states": "SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, epoch_us(max(ts)) AS place, count(*) AS n_steps, count(DISTINCT event_type) AS n_states FROM events GROUP BY 1",
    "replayed_log": "SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, CAST(1 AS INTEGER) AS n_replayed FROM events GROUP BY 1",
    "site_store_fetch": f"WITH {_SITES_SQL} SELECT event_id, user, event_type, value, site_id FROM store WHERE site_id IN ('S1', 'S3') AND value > 50",
    "note_entities_by_sql": note_plans.ORACLES["note_entities"],
    "group_fit_by_sql": "SELECT count(*) AS n, round(regr_slope(l_extendedprice / 1000, l_quantity), 5) AS slope, round(regr_intercept(l_extendedprice / 1000, l_quantity), 4) AS constant FROM lineitem GROUP BY l_returnflag",
    "fallback_paths": f"""WITH {_SHAPES_SQL}, e AS (SELECT conv_id, turn, json_extract_string(j, '$.message.body.text') AS a, json_extract_string(j, '$.body.text') AS b, json_extract_string(j, '$.text') AS c FROM v)
SELECT conv_id, turn, CAST(CASE WHEN a IS NOT NULL THEN 1 WHEN b IS NOT NULL THEN 2 WHEN c IS NOT NULL THEN 3 ELSE 0 END AS INTEGER) AS step, md5(coalesce(a, b, c, 'none')) AS text_md5 FROM e""",
    "collated_order": f"""WITH {_WORDS_SQL}
SELECT word, rank() OVER (ORDER BY word COLLATE FR.NOCASE) - 1 AS n_before, (SELECT count(*) FROM words o WHERE o.word COLLATE FR.NOCASE = w.word COLLATE FR.NOCASE) AS n_same FROM words w""",
    "collated_names": f"WITH {_WORDS_SQL}, o AS (SELECT DISTINCT lower(word) AS name FROM words) SELECT word, name FROM words JOIN o ON word COLLATE FR.NOCASE = name COLLATE FR.NOCASE",
}
