"""Token counts by separator scan.

Flat token files hold nothing but token ids, each document's followed by an
end-of-document id; there is no index of boundaries.  Files are cut into byte
ranges (blocks), whatever their size, and each task opens the file, reads its
ranges and searches each for the separator in one vectorised comparison;
documents that start and end inside a block are counted at once.  Blocks then
pass on only their length, their number of separators, and the places of the
first and last one, some 40 bytes each.  A prefix scan over a file's blocks
(running sums and a running maximum) gives each block the place of the last
separator before it, which stitches documents across any number of blocks.

Flat files are written by tasks into the shared folder.  A file's name is that of
one attempt of a task, and only files named by the attempts that succeeded are
read, so that a lost executor or a second attempt does no harm.  Files may lie
wherever pyarrow can open them (local or mounted folders, HDFS, object stores).

Cases: a null or empty text has no tokens and counts zero; repeated rows are
documents of their own; null ids keep their rows; tokens after a file's last
separator are a last document marked as not `closed`; an empty file has no
documents; an empty table gives an empty result; a document may be longer than
any number of blocks; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import kernels as K
from .shared import scratch_dir, written

BLOCK_TOKENS = 1 << 18
#: Bytes of flat file that one task reads.
TASK_BYTES = 64 << 20
LISTED = "file string, list long, bytes long, ids array<long>"

_encoders: dict = {}


def encoder(ranks: bytes, pattern: str):
    """A byte-level BPE from a file of ranks; the worker makes it once."""
    import tiktoken

    if (key := hash((ranks, pattern))) not in _encoders:
        made = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _encoders[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=made, special_tokens={})
    return _encoders[key]


def _opened(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if local := re.fullmatch(r"(?:file:/*(?=/))?(/.*)", uri):
        return pafs.LocalFileSystem(), local[1]
    return pafs.FileSystem.from_uri(uri)


def write_flat(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, int]:
    """(files, manifest, separator): one flat file for each input partition, in the shared folder.

    Ids are little-endian unsigned 16-bit numbers, 32-bit for more than 65,536.
    files has file and bytes; manifest has file, list and ids, the documents' ids
    in the file's order, which say nothing about where they start.
    """
    separator = len(ranks.splitlines())
    kind = np.uint16 if separator < 1 << 16 else np.uint32
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(ranks)  # one file of a fixed size
    folder = f"{scratch_dir(spark)}/flat-{uuid.uuid4().hex}"

    def run(batches):
        coder, task = encoder(shipped.value, pattern), TaskContext.get()
        file = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.bin"
        system, path = _opened(file)
        system.create_dir(path.rpartition("/")[0])
        lists = size = 0
        with system.open_output_stream(path) as out:
            for batch in batches:
                column = pc.fill_null(batch.column(1), "")
                for at in range(0, len(column), 512):
                    flat: list[int] = []
                    for ids in coder.encode_ordinary_batch(column.slice(at, 512).to_pylist(), num_threads=1):
                        flat += ids
                        flat.append(separator)
                    size += out.write(np.array(flat, kind).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([lists]), pa.array([None], pa.int64()), pa.array([batch.column(0).to_pylist()], pa.list_(pa.int64()))], names=["file", "list", "bytes", "ids"])
                lists += 1
        if size:
            yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([-1]), pa.array([size]), pa.array([None], pa.list_(pa.int64()))], names=["file", "list", "bytes", "ids"])

    both = written(docs.select(F.col(id_col).cast("long"), text).mapInArrow(K.tidy(run), LISTED), "manifest")
    return both.where("list < 0").select("file", "bytes"), both.where("list >= 0").select("file", "list", "ids"), separator


def list_flat(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes) of the flat token files in a folder, of any size; their content is not read."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("bytes"))


def count(files: DataFrame, separator: int, token_bytes: int = 2, block_tokens: int = BLOCK_TOKENS, task_bytes: int = TASK_BYTES) -> DataFrame:
    """(file, ordinal, n_tokens, closed) of every document in files (file, bytes); separators are not counted."""
    kind, width = np.uint16 if token_bytes == 2 else np.uint32, token_bytes * block_tokens

    def scan(batches):
        for batch in batches:
            out, name, source = [], None, None
            for file, block, size in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if file != name:
                    system, path = _opened(file)
                    name, source = file, system.open_input_file(path)
                ids = np.frombuffer(source.read_at(min(width, size - block * width), block * width), kind)
                ends = np.flatnonzero(ids == separator)
                out.append((file, block, len(ids), len(ends), int(ends[0]) if len(ends) else None, int(ends[-1]) if len(ends) else None, (np.diff(ends) - 1).tolist()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), [pa.string(), *[pa.int64()] * 5, pa.list_(pa.int64())])], names=["file", "block", "n", "k", "first", "last", "inner"])

    total = files.agg(F.sum("bytes")).first()[0] or 0
    tasks = max(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // task_bytes))
    ranges = files.where("bytes > 0").select("file", F.explode(F.sequence(F.lit(0), F.floor((F.col("bytes") - 1) / width))).alias("block"), "bytes")
    # a table, read for the blocks' five numbers, which the scan over a file passes on, and for the lengths inside, which stay with their block
    found = written(ranges.repartition(tasks, "file", "block").sortWithinPartitions("file", "block").mapInArrow(K.tidy(scan), "file string, block long, n long, k long, first long, last long, inner array<long>"), "blocks")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    placed = found.select("file", "block", "n", "k", "first", "last").withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).withColumn("done", F.coalesce(F.sum("k").over(before), F.lit(0)))
    placed = placed.withColumn("open", F.coalesce(F.max(F.col("start") + F.col("last")).over(before) + 1, F.lit(0)))
    heads = placed.where("k > 0").select("file", "done", (F.col("start") + F.col("first") - F.col("open")).alias("n_tokens"), "block")
    inside = found.select("file", "block", F.posexplode("inner").alias("i", "n_tokens")).join(heads.select("file", "block", "done"), ["file", "block"])
    closed = heads.select("file", F.col("done").alias("ordinal"), "n_tokens", F.lit(True).alias("closed")).unionByName(inside.select("file", (F.col("done") + F.col("i") + 1).alias("ordinal"), "n_tokens", F.lit(True).alias("closed")))
    ends = placed.groupBy("file").agg(F.sum("k").alias("ordinal"), (F.sum("n") - F.coalesce(F.max(F.col("start") + F.col("last")) + 1, F.lit(0))).alias("n_tokens")).where("n_tokens > 0").select("file", "ordinal", "n_tokens", F.lit(False).alias("closed"))
    return closed.unionByName(ends)


def token_counts(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text: str = "text", block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(id, file, ordinal, n_tokens) of every row, by way of flat files in the shared folder; file is the name without its folder."""
    files, manifest, separator = write_flat(docs, ranks, pattern, id_col, text)
    before = Window.partitionBy("file").orderBy("list").rowsBetween(Window.unboundedPreceding, -1)
    listed = manifest.withColumn("base", F.coalesce(F.sum(F.size("ids")).over(before), F.lit(0))).select("file", "base", F.posexplode("ids").alias("i", "id"))
    named = listed.select("file", (F.col("base") + F.col("i")).alias("ordinal"), "id")
    counted = count(files, separator, 2 if separator < 1 << 16 else 4, block_tokens).where("closed")
    return named.join(counted.hint("merge"), ["file", "ordinal"]).select(F.col("id").alias(id_col), F.substring_index("file", "/", -1).alias("file"), "ordinal", "n_tokens")
