"""Look-ups in order of priority, and containment of phrases in texts by an inverted index of byte grams.

A gram is up to eight bytes, as a number.  Every phrase has one anchor, the gram of
its own that is rarest among all phrases' grams (phrases of fewer than eight bytes
are one shorter gram).  Texts give their distinct grams that a bit map of the
anchors lets through; grams and anchors meet in an equality join, and only pairs
that meet are compared in full, so that no text is held against every phrase.

Null and empty phrases are contained in nothing, null texts contain nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearth.session import stored

WIDTH = 8
#: Bits of the map of anchors (512 kB); a fixed size, whatever the number of phrases.
MAP_BITS = 22


def _slots(values: np.ndarray, width: int) -> np.ndarray:
    """Places of grams in the map."""
    return ((values ^ np.uint64(width)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - MAP_BITS)


def _grams(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, gram) of every run of `width` bytes inside one row."""
    column = pc.fill_null(column, "").cast(pa.large_binary())
    n, raw = len(column), column.buffers()
    offsets = np.frombuffer(raw[1], np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(raw[2], np.uint8)[offsets[0] : offsets[-1]] if raw[2] is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    padded = np.concatenate([data, np.zeros(WIDTH, np.uint8)])
    at = np.arange(len(data))
    row = np.searchsorted(offsets, at, "right") - 1
    on = at + width <= offsets[1:][row] if len(at) else np.zeros(0, bool)
    values = np.ndarray(len(data), "<u8", padded, 0, (1,))[on] & np.uint64((1 << 8 * width) - 1)
    return row[on], values


def _distinct(row: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((values, row))
    row, values = row[order], values[order]
    new = np.append(True, (row[1:] != row[:-1]) | (values[1:] != values[:-1])) if len(row) else np.zeros(0, bool)
    return row[new], values[new]


def _listed(n: int, row: np.ndarray, width: np.ndarray, values: np.ndarray) -> list[pa.Array]:
    """The widths and grams of each row as arrays."""
    order = np.argsort(row, kind="stable")
    ends = pa.array(np.searchsorted(row[order], np.arange(n + 1)).astype(np.int32))
    return [pa.ListArray.from_arrays(ends, pa.array(width[order].astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(values[order].view(np.int64)))]


def anchors(phrases: DataFrame) -> DataFrame:
    """(phrase, width, gram) for every distinct phrase, a stored table."""

    def run(batches):
        for batch in batches:
            said = batch.column(0)
            sizes = np.minimum(pc.binary_length(said).to_numpy(zero_copy_only=False), WIDTH)
            parts = []
            for width in np.unique(sizes).tolist():
                here = np.flatnonzero(sizes == width)
                row, values = _distinct(*_grams(said.take(pa.array(here)), width))
                parts.append((here[row], np.full(len(row), width), values))
            row, width, values = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
            yield pa.RecordBatch.from_arrays([said, *_listed(len(said), row, width, values)], names=["phrase", "widths", "grams"])

    distinct = phrases.select(F.col("phrase")).where(F.octet_length("phrase") > 0).distinct()
    listed = stored(distinct.mapInArrow(run, "phrase string, widths array<int>, grams array<long>"), "phrases")
    pairs = listed.select("phrase", F.explode(F.arrays_zip("widths", "grams")).alias("g")).select("phrase", F.col("g.widths").alias("width"), F.col("g.grams").alias("gram"))
    counts = stored(pairs.groupBy("width", "gram").agg(F.count("*").alias("n")), "grams")
    rarest = pairs.join(counts, ["width", "gram"]).groupBy("phrase").agg(F.min(F.struct("n", "gram", "width")).alias("a"))
    return stored(rarest.select("phrase", "a.width", "a.gram"), "anchors")


def containing(texts: DataFrame, text: str, phrases: DataFrame, phrase: str) -> DataFrame:
    """Each row of texts beside each row of phrases whose phrase it contains, byte for byte; without the columns of text and phrase."""
    held = anchors(phrases.select(F.col(phrase).alias("phrase")))

    def marked(batches):
        for batch in batches:
            width, gram = (batch.column(i).to_numpy() for i in range(2))
            place = np.unique(np.concatenate([np.zeros(0, np.uint64), *[_slots(gram[width == w].view(np.uint64), int(w)) for w in np.unique(width)]]))
            yield pa.RecordBatch.from_arrays([pa.array((place >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (place & np.uint64(63))).view(np.int64))], names=["word", "bits"])

    words = held.select("width", "gram").mapInArrow(marked, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).collect()  # at most 2**16 rows
    table = np.zeros((1 << MAP_BITS) // 64, np.uint64)
    for r in words:
        table[r.word] = np.int64(r.bits).view(np.uint64)
    widths = [r.width for r in held.select("width").distinct().collect()]  # at most WIDTH rows
    shipped = texts.sparkSession.sparkContext.broadcast(np.unpackbits(table.view(np.uint8), bitorder="little").astype(bool))

    def met(batches):
        lets = shipped.value
        # grams take eight bytes and more for each byte of text
        for batch in (b.slice(at, 256) for b in batches for at in range(0, b.num_rows, 256)):
            parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))]
            for width in widths:
                row, values = _grams(batch.column(0), width)
                on = lets[_slots(values, width)]
                row, values = _distinct(row[on], values[on])
                parts.append((row, np.full(len(row), width), values))
            row, width, values = (np.concatenate(x) for x in zip(*parts))
            yield pa.RecordBatch.from_arrays([*batch.columns, *_listed(batch.num_rows, row, width, values)], names=[*batch.schema.names, "_widths", "_grams"])

    others = [c for c in texts.columns if c != text]
    rows = texts.select(F.col(text).alias("_text"), *others)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    listed = rows.mapInArrow(met, f"{kinds}, _widths array<int>, _grams array<long>")
    grams = listed.select("_text", *others, F.explode(F.arrays_zip("_widths", "_grams")).alias("_g")).select("_text", *others, F.col("_g._widths").alias("width"), F.col("_g._grams").alias("gram"))
    found = grams.join(held, ["width", "gram"]).where(F.col("_text").contains(F.col("phrase"))).select(*others, F.col("phrase").alias("_phrase"))
    return found.join(phrases.withColumnRenamed(phrase, "_phrase"), "_phrase").drop("_phrase")


def starting(texts: DataFrame, text: str, phrases: DataFrame, phrase: str, least: int = 4) -> DataFrame:
    """Each row of texts beside each row of phrases whose phrase it starts with: equal first bytes, then the whole phrase; phrases of fewer than `least` characters by a join for each length."""
    sizes = F.least(F.length(phrase), F.lit(least))
    known = phrases.where(F.length(phrase) > 0).withColumn("_n", sizes).withColumn("_head", F.substring(F.col(phrase), 1, least))
    heads = texts.where(F.col(text).isNotNull()).withColumn("_n", F.explode(F.sequence(F.lit(1), F.lit(least)))).withColumn("_head", F.col(text).substr(F.lit(1), F.col("_n")))
    joined = heads.join(known, ["_n", "_head"]).where(F.col(text).startswith(F.col(phrase)))
    return joined.drop("_n", "_head")


def prioritised(rows: DataFrame, key: str, levels: list[tuple[int, DataFrame]], value: str, default=None) -> DataFrame:
    """The rows with `value` of the hit of the least level, and in it of the least ordinal; null, or the default, without a hit.

    levels: (level, hits) with hits of key, ordinal and value.  Hits of all
    levels meet in one aggregate, combined before the shuffle.
    """
    parts = [hits.select(key, F.struct(F.lit(level).alias("level"), F.col("ordinal"), F.col(value).alias("value")).alias("_hit")) for level, hits in levels]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    best = every.groupBy(key).agg(F.min("_hit").alias("_hit")).select(key, F.col("_hit.value").alias("_value"))
    found = F.col("_value") if default is None else F.coalesce("_value", default)
    return rows.join(best, key, "left").withColumn(value, found).drop("_value")
