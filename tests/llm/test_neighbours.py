import numpy as np
import pytest

from hearth.llm import neighbours, queries


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "clash") for i, v in rows], "vec_id long, embedding array<float>, rank string").repartition(3)


def brute(data, queries, k):
    """{query: [(id, score)]} over all rows."""
    ids = np.array(sorted(data))
    x = np.array([data[i] for i in ids], float)
    out = {}
    for q in queries:
        score = np.zeros(len(ids))
        for j in range(x.shape[1]):
            score += x[:, j] * float(data[q][j])
        order = np.lexsort((ids, -score))
        out[q] = [(int(ids[o]), float(score[o])) for o in order if ids[o] != q][:k]
    return out


def result(rows):
    got = {}
    for r in sorted(rows, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    return got


def shares(got, want):
    return np.mean([len({i for i, _ in got.get(q, [])} & {i for i, _ in w}) / max(len(w), 1) for q, w in want.items()])


def test_query_recall(spark, sf):
    data = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    want = brute(data, [i for i in data if i % 20 == 0], 20)
    rows = queries.op11_neighbours(spark, sf).collect()
    got = result(rows)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert shares(got, want) >= 0.9 and rows[0].measured_recall >= 0.9
    exact = {(q, i): s for q, w in brute(data, list(want), len(data)).items() for i, s in w}
    assert all(exact[q, i] == s for q, v in got.items() for i, s in v)


def test_clustered_vectors_need_few_parts(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(64, 24))
    x = (centres[rng.integers(0, 64, 6000)] + rng.normal(size=(6000, 24)) * 0.25).astype(np.float32)
    data = dict(enumerate(x.tolist()))
    s = neighbours.Settings(k=10, sample_rows=2000, part_rows=256, calibration=100, cell_rows=120, chunk_rows=40)
    rows = neighbours.neighbours(frame(spark, data.items()), lambda i: i % 20 == 0, s=s).collect()
    assert rows[0].parts == 32 and rows[0].searched <= 16
    want = brute(data, range(0, 6000, 20), 10)
    assert shares(result(rows), want) >= 0.9
    assert abs(shares(result(rows), want) - rows[0].measured_recall) < 0.05


def test_parts_are_balanced_and_follow_the_graph():
    rng = np.random.default_rng(5)
    group = np.repeat(np.arange(8), 100)
    x = rng.normal(size=(8, 16))[group] + rng.normal(size=(800, 16)) * 0.05
    a, b = neighbours.graph(x, 6)
    assert (np.bincount(a * 800 + b) <= 1).all() and set(zip(a, b)) == set(zip(b, a))
    part = neighbours.balanced(800, a, b, 8, 1)
    assert (np.bincount(part) == 100).all()
    assert (part[a] != part[b]).mean() < 0.05
    odd = neighbours.balanced(801, a, b, 4, 1)
    assert set(np.bincount(odd)) <= {200, 201}
    model = neighbours.router(x, part, a, b, 8, neighbours.Settings(passes=20))
    assert (model.logits(x).argmax(1) == part).mean() > 0.95
    assert neighbours.balanced(0, a[:0], b[:0], 2, 1).size == 0


def test_bundles():
    assert neighbours.bundled({0: 3, 1: 4, 2: 9, 3: 25, 4: 1}, 6, 10) == ([0, 0, 1, 2, 3, 3], [1, 1, 3, 1])
    assert neighbours.bundled({}, 2, 10) == ([0, 0], [1])


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    fine = [(i, [float(i % 5), 1.0]) for i in range(0, 200, 10)]
    copies = [(1000 + i, [4.0, 4.0]) for i in range(100)]
    gone = [(3, None), (20_000, [nan, 1.0]), (40_000, [0.0, 0.0]), (60_000, [None, 1.0]), (80_000, [1.0, inf]), (100_000, []), (None, [9.0, 9.0])]
    rows = fine + copies + copies[:5] + gone + [(0, [7.0, 7.0])]  # of the rows of 0 the smaller vector counts
    got = result(neighbours.neighbours(frame(spark, rows), lambda i: i % 20 == 0).collect())
    data = dict(fine + copies)
    assert got == brute(data, [i for i in data if i % 20 == 0], 20)
    few = result(neighbours.neighbours(frame(spark, [(20, [1.0]), (21, [2.0]), (22, [-1.0])]), lambda i: i % 20 == 0).collect())
    assert few == {20: [(21, 2.0), (22, -1.0)]}
    assert neighbours.neighbours(frame(spark, [(20, [1.0])]), lambda i: i % 20 == 0).count() == 0
    assert neighbours.neighbours(frame(spark, [(21, [1.0]), (22, [1.0])]), lambda i: i % 20 == 0).count() == 0
    assert neighbours.neighbours(frame(spark, [(20, None)]), lambda i: i % 20 == 0).count() == 0
    assert neighbours.neighbours(frame(spark, gone).limit(0), lambda i: i % 20 == 0).count() == 0
    with pytest.raises(Exception, match="components in one column|shape|dimension"):
        neighbours.neighbours(frame(spark, [(1, [1.0]), (20, [1.0, 2.0])]), lambda i: i % 20 == 0).collect()
