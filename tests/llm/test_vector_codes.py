import duckdb
import numpy as np
import pytest

from hearth.llm import queries, vector_codes


def frame(spark, rows, label="int"):
    return spark.createDataFrame([(i, v, t, "clash") for i, v, t in rows], f"vec_id long, embedding array<float>, label {label}, code string").repartition(3)


def brute(rows, parts=8, entries=16, rounds=6):
    """{row number: (code, error)} and the codebooks, one vector at a time."""
    x = [[int(np.floor(4096 * float(c))) for c in v] for _, v, _ in rows]
    w = len(x[0]) // parts
    cut = [[v[p * w : (p + 1) * w] for p in range(parts)] for v in x]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, x[k]))[:entries]
    books = [[list(cut[k][p]) for k in order] for p in range(parts)]

    def nearest(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            held = [[] for _ in books[p]]
            for v in cut:
                held[nearest(v[p], books[p])[1]].append(v[p])
            books[p] = [[sum(c) // len(h) for c in zip(*h)] if h else e for h, e in zip(held, books[p])]
    out = []
    for v in cut:
        found = [nearest(v[p], books[p]) for p in range(parts)]
        out.append(("".join(f"{i:02x}" for _, i in found), sum(d for d, _ in found)))
    return out, books


def test_query_against_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = con.execute(queries.ORACLES["op13_vector_codes"])
    names = [d[0] for d in want.description]
    got = queries.op13_vector_codes(spark, sf)
    assert sorted(names) == sorted(got.columns) and sorted(tuple(r) for r in got.select(*names).collect()) == sorted(want.fetchall())


def test_odd_vectors_against_brute_force(spark):
    inf, nan = float("inf"), float("nan")
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(60, 16)).round(2).tolist()
    rows = [(100 - i, v, i % 4) for i, v in enumerate(vectors)]
    rows += [(200 + i, vectors[0], None) for i in range(40)] + [(None, vectors[3], 2), (None, vectors[4], None)] + [(100, v, 1) for v in vectors[5:7]] * 2
    gone = [(1, None, 1), (2, [nan] + [0.0] * 15, 1), (3, [inf] + [0.0] * 15, None), (4, [None] + [0.0] * 15, 1), (5, [], 1), (None, None, None)]
    want, books = brute(rows)
    got = vector_codes.vector_codes(frame(spark, rows + gone)).collect()
    sums = {}
    for (_, _, label), (_, e) in zip(rows, want):
        sums[label] = sums.get(label, 0) + e
    assert sorted(map(repr, [(r.vec_id, r.code, r.error, r.label_error) for r in got])) == sorted(repr((i, c, e, sums[label])) for (i, _, label), (c, e) in zip(rows, want))
    assert {r.codebooks_sha256 for r in got} == {vector_codes.digest(np.array(books))}


def test_few_vectors_and_limits(spark):
    three = [(7, [0.5] * 8, "a"), (8, [-0.25] * 8, None), (9, [0.5] * 8, None)]
    got = vector_codes.vector_codes(frame(spark, three, "string")).collect()
    assert {(r.vec_id, r.code, r.error) for r in got} == {(7, "00" * 8, 0), (8, "01" * 8, 0), (9, "00" * 8, 0)}
    assert vector_codes.vector_codes(frame(spark, [(1, None, 1)])).count() == 0
    assert vector_codes.vector_codes(frame(spark, [(1, None, 1)]).limit(0)).columns == list(got[0].__fields__)
    for bad, said in (([(1, [0.5] * 8, 1), (2, [0.5] * 16, 1)], "components"), ([(1, [0.5] * 9, 1)], "equal parts"), ([(1, [1e30] * 8, 1)], "beyond")):
        with pytest.raises(Exception, match=said):
            vector_codes.vector_codes(frame(spark, bad)).collect()


def test_hot_label_is_split(spark):
    """The join with the label sums has both sides stored, so that skew handling applies."""
    rows = frame(spark, [(i, [i / 100] * 8, i % 3) for i in range(30)])
    plan = vector_codes.vector_codes(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 0
