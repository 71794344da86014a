"""Vector codes: product quantisation with integer k-means.

Components become integers (floor of 4096 times the component) and are stored in
blocks of columns: all first components of some thousand vectors, then all second
ones, and so on.  A vector is cut into parts, each with a codebook that begins as
that part of the vectors with the least ids.  A round is one treeAggregate over
the blocks: squared distances to all entries grow dimension by dimension, the
nearest entry takes the part (np.add.at into int64 tensors of sums and counts),
and the tensors merge through a reduction tree.  Only the tensors, of a fixed size,
reach the driver.  All arithmetic is on integers, so that neither order nor
partitions matter.

Cases: vectors that are null, empty, or hold null or non-finite components are
dropped; a null id is larger than any other and keeps its row; of rows that repeat
an id the smaller vector comes first in the codebook, and each keeps its row; with
fewer vectors than entries a codebook has as many entries as there are vectors;
ties go to the lower entry; null labels are one label; no vector gives an empty
result; other columns are ignored.  Vectors of different lengths, a length that
the parts do not divide, and components beyond LIMIT are errors.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .shared import dropped, written
from .vectors import usable

SCALE = 4096
#: Scaled components stay below this, so that squared distances of a vector fit 64 bits.
LIMIT = 1 << 26
#: Vectors of a block.
BLOCK_ROWS = 2048
BLOCKS = "n int, width int, block binary, head_ids array<long>, heads array<array<int>>"


@dataclass(frozen=True)
class Settings:
    parts: int = 8
    entries: int = 16
    rounds: int = 6
    #: Levels of the reduction tree.
    depth: int = 2


def scaled(matrix: np.ndarray) -> np.ndarray:
    """Integers by column: (width, n)."""
    if matrix.size and not np.abs(matrix).max() < LIMIT / SCALE:
        raise ValueError(f"a component is beyond {LIMIT // SCALE}")
    return np.floor(matrix * SCALE).astype(np.int32).T.copy()


def first_rows(ids: np.ndarray, known: np.ndarray, block: np.ndarray, n: int) -> np.ndarray:
    """Places of the n rows with the least ids (null ids last), the smaller vector first where an id repeats."""
    order = np.lexsort((ids, ~known))
    if len(order) > n:
        last = order[n - 1]
        order = np.flatnonzero((known & ~known[last]) | ((known == known[last]) & (ids <= ids[last])))
    return order[np.lexsort((*block[::-1, order], ids[order], ~known[order]))][:n]


def blocks(vectors: DataFrame, id_col: str, vector: str, s: Settings) -> DataFrame:
    """The vectors as a stored table of column blocks, each with its first rows beside it."""

    def run(batches):
        for batch in batches:
            places, matrix = usable(batch.column(1))
            ids = batch.column(0).take(pa.array(places))
            for at in range(0, len(places), BLOCK_ROWS):
                part = scaled(matrix[at : at + BLOCK_ROWS])
                some = ids.slice(at, BLOCK_ROWS)
                known = some.is_valid().to_numpy(zero_copy_only=False)
                heads = first_rows(some.fill_null(0).to_numpy(zero_copy_only=False), known, part, s.entries)
                row = [[part.shape[1]], [part.shape[0]], [part.tobytes()], [some.take(pa.array(heads)).to_pylist()], [part[:, heads].T.tolist()]]
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.list_(pa.int32()))))], names=["n", "width", "block", "head_ids", "heads"])

    return written(vectors.select(F.col(id_col).cast("long"), vector).mapInArrow(K.tidy(run), BLOCKS), "blocks")


def nearest(block: np.ndarray, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each column's nearest entry; block (width, n), codebook (entries, width)."""
    far = np.zeros((len(codebook), block.shape[1]), np.int64)
    for place, row in enumerate(block):
        step = row.astype(np.int64) - codebook[:, place, None]
        step *= step
        far += step
    entry = np.argmin(far, 0)
    return entry, np.take_along_axis(far, entry[None], 0)[0]


def trained(stored: DataFrame, s: Settings = Settings()) -> np.ndarray | None:
    """Codebooks (parts, entries, width of a part) from stored blocks; None without vectors."""
    heads = stored.select(F.inline(F.arrays_zip("head_ids", "heads"))).orderBy(F.asc_nulls_last("head_ids"), "heads").limit(s.entries).collect()
    if not heads:
        return None
    widths = [r.width for r in stored.select("width").distinct().limit(2).collect()]
    if len(widths) > 1 or widths[0] % s.parts:
        raise ValueError(f"vectors of {' and '.join(map(str, widths))} components in {s.parts} equal parts")
    books = np.array([r.heads for r in heads], np.int64).reshape(len(heads), s.parts, -1).transpose(1, 0, 2).copy()
    rows = stored.select("n", "width", "block").rdd
    for _ in range(s.rounds):
        shipped = rows.context.broadcast(books)

        def add(held, row):
            books = shipped.value
            sums, counts = held or (np.zeros_like(books), np.zeros(books.shape[:2], np.int64))
            parts = np.frombuffer(row.block, np.int32).reshape(len(books), -1, row.n)
            for part, book, total, count in zip(parts, books, sums, counts):
                entry, _ = nearest(part, book)
                np.add.at(total, entry, part.T.astype(np.int64))
                np.add.at(count, entry, 1)
            return sums, counts

        def merge(a, b):
            return b if a is None else a if b is None else (a[0] + b[0], a[1] + b[1])

        sums, counts = rows.treeAggregate(None, add, merge, s.depth)
        used = counts > 0
        books[used] = sums[used] // counts[used][:, None]
        shipped.destroy()
    return books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components by part, entry and place."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def coded(vectors: DataFrame, books: np.ndarray, id_col: str, vector: str, label: str) -> DataFrame:
    """(id, label, code, error) of every usable vector under trained codebooks."""
    shipped = vectors.sparkSession.sparkContext.broadcast(books)
    kept = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector"))

    def run(batches):
        books = shipped.value
        for batch in batches:
            places, matrix = usable(batch.column(2))
            for at in range(0, len(places), BLOCK_ROWS):
                here = pa.array(places[at : at + BLOCK_ROWS])
                block = scaled(matrix[at : at + BLOCK_ROWS])
                found = [nearest(part, book) for part, book in zip(block.reshape(len(books), -1, block.shape[1]), books)]
                codes = np.stack([e for e, _ in found], 1).astype(np.uint8)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(here), batch.column(1).take(here), pa.array([c.tobytes().hex() for c in codes]), pa.array(sum(d for _, d in found))], names=["id", "label", "code", "error"])

    return kept.mapInArrow(K.tidy(run), f"id long, label {dict(kept.dtypes)['label']}, code string, error long")


def vector_codes(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: str = "label", s: Settings = Settings()) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every usable vector."""
    stored = blocks(vectors, id_col, vector, s)
    books = trained(stored, s)
    dropped(stored)
    if books is None:
        return vectors.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    # both sides of the join are stored, so that a hot label's rows can be split
    rows = written(coded(vectors, books, id_col, vector, label), "codes")
    sums = written(rows.groupBy("label").agg(F.sum("error").alias("label_error")), "label_errors")
    joined = rows.join(sums, rows.label.eqNullSafe(sums.label))
    return joined.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def oracle(s: Settings = Settings()) -> str:
    """The result of vector_codes(embeddings) in DuckDB's SQL, where ids are neither null nor repeated."""
    steps = []
    far = "list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    for k in range(s.rounds + 1):
        steps.append(f"a{k} AS MATERIALIZED (SELECT p.vec_id, p.part, any_value(p.x) AS x, min({far} * {s.entries} + c.entry) AS best FROM p JOIN c{k} AS c ON p.part = c.part GROUP BY p.vec_id, p.part)")
        if k < s.rounds:
            steps.append(f"u{k} AS (SELECT part, best % {s.entries} AS entry, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM a{k})")
            steps.append(f"m{k} AS (SELECT part, entry, i, CAST(sum(v) AS BIGINT) AS t, count(*) AS n FROM u{k} GROUP BY part, entry, i)")
            steps.append(f"f{k} AS (SELECT part, entry, list((t - ((t % n) + n) % n) // n ORDER BY i) AS x FROM m{k} GROUP BY part, entry)")
            steps.append(f"c{k + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(f.x, c.x) AS x FROM c{k} AS c LEFT JOIN f{k} AS f ON c.part = f.part AND c.entry = f.entry)")
    made = ",\n".join(steps)
    return f"""
WITH k AS (
  SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS nth, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS xs
  FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, label, nth, part, list_slice(xs, part * (len(xs) // {s.parts}) + 1, (part + 1) * (len(xs) // {s.parts})) AS x FROM k, range({s.parts}) AS r(part)),
c0 AS MATERIALIZED (SELECT part, nth - 1 AS entry, x FROM p WHERE nth <= {s.entries}),
{made},
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{s.rounds}),
e AS (SELECT vec_id, string_agg(printf('%02x', best % {s.entries}), '' ORDER BY part) AS code, CAST(sum(best // {s.entries}) AS BIGINT) AS error FROM a{s.rounds} GROUP BY vec_id)
SELECT e.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM e JOIN k ON e.vec_id = k.vec_id, h
"""


ORACLE_SQL = oracle()
