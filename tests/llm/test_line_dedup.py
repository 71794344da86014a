from pyspark.sql import functions as F

from hearth.llm import line_dedup


def test_line_dedup(spark, odd, empty):
    rows = [(i, f"unique {i}\nmenu\nfooter {i % 2}", "h") for i in range(20)] + [(50, "menu\nonly", "other"), (51, None, "h"), (52, "x\n\nmenu\n", "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("n_lines", F.lit("clash"))
    want = {51: None, 50: "menu\nonly", 52: "x\n\n"} | {i: f"unique {i}" for i in range(20)}
    for bound in (1000, 0):  # both ways of joining
        got = {r.doc_id: r for r in line_dedup.line_dedup(docs, broadcast_rows=bound).collect()}
        assert {k: r.text for k, r in got.items()} == want
        assert (got[0].n_lines, got[0].n_dropped, got[51].n_lines) == (3, 2, 0)
    assert line_dedup.line_dedup(empty).count() == 0
    assert line_dedup.line_dedup(odd).count() == odd.count()


def test_any_column_name_is_free(spark):
    docs = spark.createDataFrame([(k, f"head\nbody {k}", "h", k, k, k, k, {"a": k}) for k in range(4)], "doc_id int, text string, source string, host int, drop int, salt int, kept int, m map<string,int>")
    for rows in (200_000, 0):
        got = line_dedup.line_dedup(docs, broadcast_rows=rows)
        assert got.columns == [*docs.columns, "n_lines", "n_dropped"]
        assert sorted((r.doc_id, r.text, r.host, r.drop, r.salt, r.kept) for r in got.collect()) == [(k, f"body {k}", k, k, k, k) for k in range(4)]
