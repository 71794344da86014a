"""Keyed state with timers, replayed logs, pruned site stores, table functions, variants and collations."""

import datetime as dt
import json

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from hearth.functions import paths, tables
from hearth.functions.strings import by_locale
from hearth.operators import members
from hearth.session import PUSHED_FILTERS, own_session
from hearth.sources import site_store, writers
from hearth.streaming import live

DAY = 86_400_000


def batches(spark, folder, made, schema):
    for rows in made:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))


def at(hour):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=hour)


def test_late_rows_count_but_do_not_undo_and_idle_keys_close(spark, tmp_path):
    schema = "id long, who string, ts timestamp, what string"
    made = [[(1, "a", at(5), "ordered"), (2, "b", at(1), "fired")], [(3, "a", at(2), "fired"), (4, "a", at(5), "fired")], [(5, "c", at(100), "fired")], [(6, "a", at(101), "reported"), (7, "c", at(102), "closed")]]
    batches(spark, tmp_path / "in", made, schema)
    found = live.keyed_states(live.read_files(spark, str(tmp_path / "in"), schema, "*.parquet"), "who", "ts", "id", "what", "10 hours", DAY)
    rows = [r for r in live.logged(found, str(tmp_path / "log"), str(tmp_path / "cp"), mode="update").orderBy("batch").collect()]
    a = [(r.state, r.n_steps, r.n_states, r.closed) for r in rows if r.who == "a"]
    # the second batch's rows are late and a tie, which the larger id wins; then idle, closed, and begun anew
    assert a == [("ordered", 1, 1, False), ("fired", 3, 2, False), ("fired", 3, 2, True), ("reported", 1, 1, False)]
    assert [(r.state, r.closed) for r in rows if r.who == "b"] == [("fired", False), ("fired", True)]
    assert [(r.state, r.n_steps, r.closed) for r in rows if r.who == "c"] == [("fired", 1, False), ("closed", 2, False)]


def test_replayed_batches_are_logged_once(spark, tmp_path):
    schema = "id long, v double"
    batches(spark, tmp_path / "in", [[(1, 1.0)], [(2, 2.0), (3, 3.0)], [(4, 4.0)]], schema)
    heard = []

    def listen(rows, batch):
        heard.append((batch, rows.count()))
        if len(heard) == 2:
            raise RuntimeError("once")

    def run():
        return live.logged(live.read_files(spark, str(tmp_path / "in"), schema, "*.parquet"), str(tmp_path / "log"), str(tmp_path / "cp"), [listen])

    with pytest.raises(Exception, match="once"):
        run()
    log = run()
    assert sorted((r.id, r.batch) for r in log.collect()) == [(1, 0), (2, 1), (3, 1), (4, 2)]
    assert heard == [(0, 1), (1, 2), (1, 2), (2, 1)]
    assert run().count() == 4 and len(heard) == 4  # nothing is left to do


def test_site_store_opens_only_the_sites_asked_for(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"u{i % 3}", s) for i in range(30) for s in ("S1", "S2", "a b/c")], "event_id long, user string, site_id string")
    store = str(tmp_path / "store")
    writers.write_sites(rows, store)
    for f in (tmp_path / "store" / "site_id=S2").glob("*.parquet"):
        f.write_bytes(b"broken")
    own = own_session(spark, **PUSHED_FILTERS)

    def asked(where):
        return site_store.opened(own, store, "event_id long, user string, site_id string").where(where)

    one = asked("site_id = 'S1' AND user = 'u1'")
    assert sorted(r.event_id for r in one.collect()) == list(range(1, 30, 3)) and one.rdd.getNumPartitions() == 1
    assert asked("site_id IN ('S1', 'a b/c', 'none')").count() == 60
    assert asked("site_id = 'none'").count() == 0 and asked("site_id IN ('S1', 'S2') AND site_id = 'S1'").count() == 30
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" in plan and "site_id" not in plan.split("Filter (")[1].split("\n")[0]  # the site's filter is the source's, the user's is Spark's
    with pytest.raises(Exception):
        asked("user = 'u1'").count()


def test_table_functions_refuse_what_they_cannot_take(spark):
    own = own_session(spark)
    tables.register(own)
    own.createDataFrame([(1, "no cough"), (2, None), (3, "COUGH, fever")], "k long, t string").createOrReplaceTempView("said")
    how = json.dumps({"lexicons": {"symptom": {"cough": "S2", "fever": "S1"}}, "negations": ["no"], "patterns": [["n", r"\d+", 0.9]]})
    got = own.sql("SELECT * FROM note_entities(TABLE(said), :how)", {"how": how})
    assert sorted((r.k, r.code, r.negated) for r in got.collect()) == [(1, "S2", True), (3, "S1", False), (3, "S2", False)]
    own.createDataFrame([("g", 1.0, 3.0), ("g", 2.0, 5.0), ("h", 1.0, 1.0), ("h", None, 9.0)], "g string, x double, y double").createOrReplaceTempView("numbers")
    fits = {r.n: [round(c, 6) for c in r.coefficients] for r in own.sql("SELECT * FROM group_fit(TABLE(numbers) PARTITION BY (g), 'y')").collect()}
    assert fits == {2: [2.0, 1.0], 1: [0.5, 0.5]}
    for bad in ("SELECT * FROM note_entities(TABLE(numbers), 'x')", "SELECT * FROM group_fit(TABLE(numbers) PARTITION BY (g), 'g')"):
        with pytest.raises(Exception, match="takes a table|no numeric column"):
            own.sql(bad)


def test_paths_fall_back(spark):
    rows = spark.createDataFrame([('{"a": {"b": 1}}',), ('{"a": "x", "c": [2, 7]}',), ("[1]",), ("broken {",), (None,)], "j string")
    v = paths.parsed(F.col("j"))
    got = rows.select(paths.first_of(v, ["$.a.b", "$.c[1]"], "int", -1).alias("x"), paths.which(v, ["$.a.b", "$.c[1]"], "int").alias("n")).collect()
    assert [(r.x, r.n) for r in got] == [(1, 1), (7, 2), (-1, 0), (-1, 0), (-1, 0)]


def test_names_by_locale(spark):
    names = spark.createDataFrame([(x,) for x in ("Étude", "etude", "ETUDE", "zoo", "Zebra", "éclair", "étude")], "name string")
    assert [r.name for r in names.orderBy(by_locale(F.col("name")), "name").collect()] == ["éclair", "ETUDE", "etude", "Étude", "étude", "Zebra", "zoo"]
    asked = spark.createDataFrame([("ÉTUDE",), ("Zoo",)], "asked string")
    assert sorted((r.name, r.asked) for r in members.named(names, "name", asked, "asked").collect()) == [("zoo", "Zoo"), ("Étude", "ÉTUDE"), ("étude", "ÉTUDE")]
    assert names.where(by_locale(F.col("name")) == "éTUDE").count() == 2
    listed = members.listing(names.withColumn("g", F.col("name")), spark.createDataFrame([("zoo",)], "g string"), "g", "name", 3)
    assert [r.name for r in listed.collect()] == ["zoo", "éclair", "ETUDE"]


def test_a_key_s_state_is_read_and_written_once_a_batch():
    calls = []

    class Value:
        def get(self):
            calls.append("get")

        def update(self, value):
            calls.append("update")

    class Handle:
        def getValueState(self, *_):
            return Value()

        def __getattr__(self, name):
            return lambda *_: calls.append(name)

    state = live.KeyedState("who", DAY)
    state.init(Handle())
    rows = [Row(at_place=10_000_000 * i, at_tie=i, at_state="xy"[i % 2]) for i in range(100)]
    (out,) = state.handleInputRows(("a",), iter(rows), None)
    assert (out.state, out.n_steps, out.n_states) == ("y", 100, 2)
    assert calls == ["get", "registerTimer", "update"]
