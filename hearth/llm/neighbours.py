"""Approximate nearest neighbours by learned partitions.

A graph of nearest neighbours over a bounded sample is cut into balanced parts, by
bisection after bisection: a spectral start at the median, then swaps of the pairs
that cut the fewest edges (Kernighan and Lin).  A small classifier (one hidden
layer) learns from each sampled vector to which parts its neighbours belong.
Every vector of the table is then indexed under its most probable part, and a
query looks into its several most probable ones, whose vectors are ranked anew by
the exact measure.  How many parts it looks into is not guessed: for some
queries the true neighbours are found over all vectors, and the least number
that finds the recall asked for is taken, all parts if need be.

The sample (`Settings.sample_rows`) and the queries of the calibration
(`Settings.calibration`) are bounded; the index, the true neighbours and the search
cover all rows.  Of equal vectors only the k + 1 with the least ids can be among a
query's k nearest, as ties go to smaller ids, so no others are indexed (every one of
them is a query where asked for).  Small parts are searched together, large
ones are cut into cells by hash, and queries into chunks, so that a task holds one
cell and one chunk however large a part may be.

Cases: vectors that are null, empty, zero, or hold null or non-finite components,
and rows with a null id take no part; of rows that repeat an id the smallest
vector counts; a query with fewer candidates than k finds them all; small tables
are one part, which is searched in full; no vector gives an empty result; other
columns are ignored.  Vectors of different lengths are an error.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .shared import dropped, written
from .vectors import tree_sum, usable


@dataclass(frozen=True)
class Settings:
    k: int = 20
    #: Vectors that graph and classifier are fitted on, at most.
    sample_rows: int = 8192
    #: Edges from each vector of the graph.
    edges: int = 10
    #: A part is meant to hold so many vectors; a power of two parts, up to max_parts.
    part_rows: int = 2048
    max_parts: int = 128
    #: Units of the classifier's hidden layer, passes over the sample, step length.
    hidden: int = 64
    passes: int = 10
    step: float = 0.01
    #: What a vector's own part weighs beside one of its edges.
    own: float = 30.0
    #: Queries whose true neighbours are found, at most, and the share of them that the search must find.
    calibration: int = 256
    recall: float = 0.94
    #: Indexed vectors (small parts together) and queries that meet in one task, about.
    cell_rows: int = 16384
    chunk_rows: int = 1024
    seed: int = 11


def parts_for(rows: int, s: Settings) -> int:
    """A power of two, so that every cut halves."""
    return 1 if rows < 2 * s.part_rows // 16 else min(s.max_parts, 2 ** max(1, round(np.log2(rows / s.part_rows))))


def nearest(queries: np.ndarray, rows: np.ndarray, k: int, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(query, row) places of each query's k rows of largest inner product and of any that rounding may have left just behind.

    skip: for each query the place of a row to leave out, or -1.
    """
    found = []
    lengths = np.sqrt((queries * queries).sum(1)) * np.sqrt((rows * rows).sum(1).max(initial=0))
    for at in range(0, len(queries), 256):
        near = queries[at : at + 256] @ rows.T
        if skip is not None:
            own = np.flatnonzero(skip[at : at + 256] >= 0)
            near[own, skip[at : at + 256][own]] = -np.inf
        least = np.partition(near, -k, 1)[:, -k] - 1e-9 * lengths[at : at + 256] if near.shape[1] > k else np.full(len(near), -np.inf)
        q, r = np.nonzero((near >= least[:, None]) & (near > -np.inf))
        found.append((q + at, r))
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 2


def exact(queries: np.ndarray, rows: np.ndarray, q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Inner products of pairs, added up component by component: the same for equal vectors wherever they stand."""
    out = np.zeros(len(q))
    for a, b in zip(queries.T, rows.T):
        out += a[q] * b[r]
    return out


def top(query: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of each query's k best by score, ties to the smaller id."""
    order = np.lexsort((ids, -score, query))
    q = query[order]
    begins = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(begins, np.diff(np.append(begins, len(q))))
    return order[rank < k]


# the graph and its parts


def graph(sample: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (a, b), both ways, between sampled vectors of which one is among the other's k nearest by inner product."""
    unit = sample / np.sqrt((sample * sample).sum(1, keepdims=True))
    q, r = nearest(unit, unit, k, np.arange(len(unit)))
    both = np.unique(np.concatenate([q * len(unit) + r, r * len(unit) + q]))
    return both // len(unit), both % len(unit)


def halved(n: int, a: np.ndarray, b: np.ndarray, rng: np.random.Generator, turns: int = 60) -> np.ndarray:
    """The side (0 or 1) of each of n nodes: two sides of the same size, few edges between them."""
    degree = np.bincount(a, minlength=n) + 1.0
    root = np.sqrt(degree)
    x = rng.normal(size=n)
    for _ in range(turns):  # second eigenvector of the normalised graph by power iteration
        x -= root * (x @ root) / (root @ root)
        x = x + np.bincount(a, (x / root)[b], n) / root
        x /= np.sqrt(x @ x) + 1e-300
    side = np.zeros(n, bool)
    side[np.argsort(x / root, kind="stable")[n // 2 :]] = True
    cut = (side[a] != side[b]).sum()
    for _ in range(turns):
        gain = np.bincount(a, np.where(side[a] != side[b], 1.0, -1.0), n)
        ones, zeros = np.flatnonzero(side), np.flatnonzero(~side)
        ones, zeros = ones[np.argsort(-gain[ones], kind="stable")], zeros[np.argsort(-gain[zeros], kind="stable")]
        m = min(len(ones), len(zeros))
        good = int(((gain[ones[:m]] + gain[zeros[:m]]) > 0).sum())
        while good:
            trial = side.copy()
            trial[ones[:good]], trial[zeros[:good]] = False, True
            less = (trial[a] != trial[b]).sum()
            if less < cut:
                side, cut = trial, less
                break
            good //= 2
        if not good:
            break
    return side.astype(np.int64)


def balanced(n: int, a: np.ndarray, b: np.ndarray, parts: int, seed: int) -> np.ndarray:
    """The part of each of n nodes; sizes differ by one at each cut at most."""
    rng = np.random.default_rng(seed)
    part = np.zeros(n, np.int64)
    while parts > 1:
        cut = part.copy()
        for p in np.unique(part):
            nodes = np.flatnonzero(part == p)
            place = np.full(n, -1)
            place[nodes] = np.arange(len(nodes))
            inside = (place[a] >= 0) & (place[b] >= 0)
            cut[nodes] = 2 * p + halved(len(nodes), place[a[inside]], place[b[inside]], rng)
        part, parts = cut, parts // 2
    return part


# the classifier


@dataclass(frozen=True)
class Router:
    first: np.ndarray
    first_bias: np.ndarray
    second: np.ndarray
    second_bias: np.ndarray

    def logits(self, vectors: np.ndarray) -> np.ndarray:
        unit = vectors / np.sqrt((vectors * vectors).sum(1, keepdims=True))
        return np.maximum(unit @ self.first + self.first_bias, 0) @ self.second + self.second_bias


def router(sample: np.ndarray, part: np.ndarray, a: np.ndarray, b: np.ndarray, parts: int, s: Settings) -> Router:
    """A classifier of one hidden layer, by Adam, whose aim is the share of each part among a vector and its neighbours."""
    n, d = sample.shape
    rng = np.random.default_rng(s.seed)
    scale = np.sqrt(2 / d)
    unit = sample / np.sqrt((sample * sample).sum(1, keepdims=True))
    aim = np.bincount(a * parts + part[b], minlength=n * parts).reshape(n, parts).astype(float)
    aim[np.arange(n), part] += s.own
    aim /= aim.sum(1, keepdims=True)
    w = [rng.normal(size=(d, s.hidden)) * scale, np.zeros(s.hidden), rng.normal(size=(s.hidden, parts)) * np.sqrt(1 / s.hidden), np.zeros(parts)]
    m, v, t = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w], 0
    for turn in range(s.passes):
        order = rng.permutation(n)
        for at in range(0, n, 256):
            rows = order[at : at + 256]
            x = unit[rows]
            h = np.maximum(x @ w[0] + w[1], 0)
            z = h @ w[2] + w[3]
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = (p - aim[rows]) / len(rows)
            back = (g @ w[2].T) * (h > 0)
            t += 1
            rate = s.step * (1 - turn / s.passes)
            for i, grad in enumerate((x.T @ back, back.sum(0), h.T @ g, g.sum(0))):
                m[i] = 0.9 * m[i] + 0.1 * grad
                v[i] = 0.999 * v[i] + 0.001 * grad * grad
                w[i] -= rate * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
    return Router(*w)


# the table


def _matrix(column) -> np.ndarray:
    return usable(column)[1]


def taking_part(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """(id, vector) of the rows that take part, one for each id, a stored table."""
    kept = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("vector"))

    def run(batches):
        for batch in batches:
            places, matrix = usable(batch.column(1))
            fine = places[(matrix != 0).any(1)] if len(places) else places
            named = batch.column(0).is_valid().to_numpy(zero_copy_only=False)[fine]
            yield batch.take(pa.array(fine[named]))

    return written(kept.mapInArrow(K.tidy(run), kept.schema).groupBy("id").agg(F.min("vector").alias("vector")), "vectors")


def candidates(rows: DataFrame, k: int) -> DataFrame:
    """The rows that can be among some query's k nearest: of equal vectors those with the k + 1 least ids (cut before the shuffle too)."""
    turn = Window.partitionBy("vector").orderBy("id")
    return written(rows.withColumn("turn", F.row_number().over(turn)).where(F.col("turn") <= k + 1).select("id", "vector"), "candidates")


def _sampled(rows: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids, matrix) of the n rows with the least hashes of their ids."""
    got = rows.orderBy(F.xxhash64("id"), "id").limit(n).toArrow()
    return got["id"].to_numpy(), _matrix(got["vector"])


def routed(rows: DataFrame, model: Router, among: int) -> DataFrame:
    """(parts, id, vector): the `among` most probable parts, the best first."""
    shipped = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            matrix = _matrix(batch.column(1))
            if not len(matrix):
                continue
            best = np.argsort(-shipped.value.logits(matrix), 1, kind="stable")[:, :among].astype(np.int32)
            ends = np.arange(len(best) + 1, dtype=np.int32) * best.shape[1]
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array(best.ravel())), *batch.columns], names=["parts", "id", "vector"])

    kind = dict(rows.dtypes)["vector"]
    return rows.select("id", "vector").mapInArrow(K.tidy(run), f"parts array<int>, id long, vector {kind}")


def true_parts(index: DataFrame, ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(query place, part) of the k nearest indexed rows of each of some queries, found over the whole index."""
    shipped = index.sparkSession.sparkContext.broadcast((ids, queries))

    def best(held):
        q, score, row_ids, part = (np.concatenate(x) for x in zip(*held))
        keep = top(q, score, row_ids, k)
        return q[keep], score[keep], row_ids[keep], part[keep]

    def run(batches):
        ids, queries = shipped.value
        held = None
        for batch in batches:
            part, row_ids, matrix = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2))
            if not len(matrix):
                continue
            for at in range(0, len(matrix), 4096):
                some, here = matrix[at : at + 4096], row_ids[at : at + 4096]
                q, r = nearest(queries, some, k + 1)
                q, r = (x[ids[q] != here[r]] for x in (q, r))
                made = q, exact(queries, some, q, r), here[r], part[at : at + 4096][r]
                held = best([made] if held is None else [held, made])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()]) for x in held], names=["q", "score", "id", "part"])

    found = index.select("part", "id", "vector").mapInArrow(K.tidy(run), "q binary, score binary, id binary, part binary")
    kinds = np.int64, np.float64, np.int64, np.int32
    out = tree_sum(found, lambda r: tuple(np.frombuffer(x, kind) for x, kind in zip(r, kinds)), lambda a, b: best([a, b]))
    return (out[0], out[3]) if out else (np.zeros(0, np.int64), np.zeros(0, np.int32))


def breadth(model: Router, queries: np.ndarray, q: np.ndarray, part: np.ndarray, parts: int, recall: float) -> tuple[int, float]:
    """(how many parts to look into, the recall that this had): the least number that finds `recall` of the true neighbours."""
    if not len(q):
        return parts, 1.0
    order = np.argsort(-model.logits(queries), 1, kind="stable")
    place = np.argsort(order, 1, kind="stable")[q, part]
    reached = np.cumsum(np.bincount(place, minlength=parts)) / len(q)
    most = int(np.searchsorted(reached, recall)) + 1
    return min(most, parts), float(reached[min(most, parts) - 1])


def bundled(sizes: dict[int, int], parts: int, rows: int) -> tuple[list[int], list[int]]:
    """(bundle of each part, cells of each bundle): consecutive parts of `rows` vectors together at most, larger ones alone and cut into cells."""
    bundle, cells, held = [], [], 0
    for p in range(parts):
        n = sizes.get(p, 0)
        if not cells or held + n > rows:
            cells.append(max(1, -(-n // rows)))
            held = 0
        held += n
        bundle.append(len(cells) - 1)
    return bundle, cells


def search(index: DataFrame, asked: DataFrame, parts: int, s: Settings) -> DataFrame:
    """(query, id, score) of each query's k nearest in its parts.  index: part, id, vector; asked: parts, id, vector.

    A group is a cell of indexed vectors and a chunk of the queries that look into
    its parts, and gives k rows a query at most.
    """
    sizes = {r.part: r["count"] for r in index.groupBy("part").count().collect()}  # a row for each part
    bundle, cells = bundled(sizes, parts, s.cell_rows)
    table = F.array(*map(F.lit, bundle))
    asked = asked.withColumn("bundle", F.explode(F.array_distinct(F.transform("parts", lambda p: F.get(table, p)))))
    calls = {r.bundle: r["count"] for r in asked.groupBy("bundle").count().collect()}
    chunks = [-(-calls.get(b, 0) // s.chunk_rows) for b in range(len(cells))]

    def dealt(rows: DataFrame, mine: str, own: list[int], other: str, others: list[int]) -> DataFrame:
        """Each row in one share of its side, for every share of the other."""
        shares, turns = (F.get(F.array(*map(F.lit, x)), F.col("bundle")) for x in (own, others))
        return rows.where(turns > 0).withColumn(mine, F.pmod(F.xxhash64("id", F.lit(mine)), shares).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), turns - 1)))

    keys, k = ["bundle", "cell", "chunk"], s.k
    left = dealt(index.withColumn("bundle", F.get(table, F.col("part"))), "cell", cells, "chunk", chunks).select(*keys, "part", "id", "vector").groupBy(*keys)
    right = dealt(asked, "chunk", chunks, "cell", cells).select(*keys, "parts", "id", "vector").groupBy(*keys)

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        ids, wanted = rows["id"].to_numpy(), queries["id"].to_numpy()
        a, b, part = _matrix(queries["vector"]), _matrix(rows["vector"]), rows["part"].to_numpy()
        found = [(np.zeros(0, np.int64),) * 2]
        if len(a) and len(b):
            looks = np.array(queries["parts"].to_pylist()).reshape(len(a), -1)
            for p in np.unique(part).tolist():
                q, r = np.flatnonzero((looks == p).any(1)), np.flatnonzero(part == p)
                order = np.argsort(ids[r])
                at = order[np.minimum(np.searchsorted(ids[r], wanted[q], sorter=order), len(r) - 1)]
                i, j = nearest(a[q], b[r], k, np.where(ids[r][at] == wanted[q], at, -1))
                found.append((q[i], r[j]))
        q, r = (np.concatenate(x) for x in zip(*found))
        score = exact(a, b, q, r)
        keep = top(q, score, ids[r], k)
        return pa.table({"query": wanted[q[keep]], "id": ids[r[keep]], "score": score[keep]})

    return left.cogroup(right).applyInArrow(run, "query long, id long, score double")


def neighbours(vectors: DataFrame, asked: Callable[[Column], Column], id_col: str = "vec_id", vector: str = "embedding", s: Settings = Settings()) -> DataFrame:
    """query_id, rank, vec_id, score, and the parts looked into of parts, with the recall measured for that.

    asked: of a row's id, whether the row is a query.
    """
    spark = vectors.sparkSession
    rows = taking_part(vectors, id_col, vector)
    near = candidates(rows, s.k)
    asking = rows.where(asked(F.col("id")))
    n = near.count()
    parts = parts_for(n, s)
    ids, sample = _sampled(near, s.sample_rows)
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, searched int, parts int, measured_recall double")
    a, b = graph(sample, s.edges)
    model = router(sample, balanced(len(sample), a, b, parts, s.seed), a, b, parts, s)
    index = written(routed(near, model, 1).select(F.col("parts")[0].alias("part"), "id", "vector"), "index")
    dropped(near)
    some, queries = _sampled(asking, s.calibration)
    most, recall = breadth(model, queries, *true_parts(index, some, queries, s.k), parts, s.recall) if len(some) else (parts, 1.0)
    found = search(index, routed(asking, model, most), parts, s)
    turn = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    best = found.withColumn("rank", F.row_number().over(turn)).where(F.col("rank") <= s.k)
    return best.select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score", F.lit(most).alias("searched"), F.lit(parts).alias("parts"), F.lit(recall).alias("measured_recall"))
