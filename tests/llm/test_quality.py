import duckdb
from brute import brute_quality, thue_morse

from hearth.llm import quality, queries


def test_quality(spark, sf, odd, empty, texts):
    def measures(r):
        return r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed

    for r in queries.op5_quality(spark, sf).collect():
        assert measures(r) == brute_quality(texts[r.doc_id]) and not (r.base_failed and r.kept)
    for r in quality.quality(odd, ["text"]).collect():
        assert measures(r) == brute_quality(r.text)
    assert quality.quality(empty, ["doc_id"]).count() == 0 and quality.filtered(empty).columns == empty.columns
    kept = {r.doc_id for r in quality.filtered(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    assert kept == {r.doc_id for r in queries.op5_quality(spark, sf).where("kept").collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(labels[k] == 1 for k in labels if k in kept and labels[k] == 1) and sum(k in kept for k in labels if labels[k] == 0) <= 0.2 * sum(1 for k in labels if labels[k] == 0)


def test_words_and_lines_alike_under_polynomials(spark, tmp_path):
    one, other = ("".join(x) for x in thue_morse(2048))
    texts = [f"{one}\n{other}", " ".join([one, "p q r s", other, "p q r s"]), f"{one} p q r s {one} p q r s", f"{one}\n{one}"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"file://{tmp_path}/documents.parquet")
    got = queries.op5_quality(spark, str(tmp_path))
    assert [(r.n_dup_lines, r.n_repeat_words) for r in got.orderBy("doc_id").collect()] == [(0, 0), (0, 0), (0, 10), (1, 0)]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(queries.ORACLES["op5_quality"])
    names = [d[0] for d in want.description]
    assert sorted(tuple(r) for r in got.select(*names).collect()) == sorted(want.fetchall())
