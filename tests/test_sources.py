import json

from hearth.sources import readers, writers
from hearth.streaming import live


def test_json_envelope_and_optional(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"_metadata": {"n": 2}, "rows": [{"id": "1"}, {"id": "2"}]}))
    df = readers.unwrap(readers.read_json(spark, str(tmp_path / "a.json"), "rows array<struct<id:string>>"), "rows")
    assert [r.id for r in df.collect()] == ["1", "2"]
    assert readers.read_optional_json(spark, str(tmp_path / "none.json"), "id string").count() == 0
    sites = readers.read_site_folder(spark, str(tmp_path), "rows array<struct<id:string>>")
    assert sites.first().site_file == "a.json"


def test_logs_and_salvage(spark, tmp_path):
    (tmp_path / "log.json").write_text('{"a": 1}\nnot json\n{"a": 3}\n')
    log = readers.read_log(spark, str(tmp_path / "log.json"), "a int")
    assert [r.a for r in writers.latest(log, "a", "a", 1).collect()] == [3]
    text = spark.createDataFrame([("answer: [{\"k\": 5}] end",), ("none",)], "t string")
    assert [r.record.k for r in readers.records_from_text(text, "t", "k:int").collect()] == [5]


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("A", 1), ("B", 2), (None, 3)], "site_id string, x int")
    writers.write_sites(rows, str(tmp_path / "sites"))
    assert spark.read.parquet(str(tmp_path / "sites")).where("site_id = 'A'").count() == 1
    writers.write_json(rows, str(tmp_path / "j"), rows.groupBy().count())
    assert spark.read.json(str(tmp_path / "j/rows")).count() == 3
    assert writers.bundle({"t": rows}).count() == 3
    assert readers.first_by_key(rows.withColumn("k", rows.x * 0), "k", "x").first().x == 1


def test_keyed_state_stream(spark, tmp_path):
    folder = tmp_path / "in"
    for i, batch in enumerate([[("k", 1, "fired")], [("k", 3, "ordered"), ("j", 1, "fired")], [("k", 2, "acknowledged")]]):
        spark.createDataFrame(batch, "key string, seq long, state string").coalesce(1).write.mode("append").parquet(str(folder))
    stream = live.read_files(spark, str(folder), "key string, seq long, state string", "*.parquet")
    out = live.run_once(live.last_states(stream, "key", "seq", "state"), str(tmp_path / "states"), "update", str(tmp_path / "cp"))
    rows = {(r.key, r.n_steps): r.state for r in out.collect()}
    assert rows[("k", 3)] == "ordered" and rows[("j", 1)] == "fired"
