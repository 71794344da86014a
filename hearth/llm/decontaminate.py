"""Benchmark decontamination by greedy string tiling.

Tokens are runs of letters, digits and non-ASCII characters, A-Z lower-cased.
Documents are joined with benchmark items on shared seeds: hashes of `min_match`
consecutive tokens.  A pair goes on if the item's tokens under shared seeds reach
the coverage, without which no tiling can.  Then the longest match of unmarked
tokens is marked on both sides as a tile, again and again, until no match of
`min_match` tokens is left (ties: first in the item, then first in the
document).  The longest length is found by bisection over Karp-Rabin windows of
that length, all windows of a length at once, and all tiles of one length are
taken in one sweep; so no pair of places is ever listed, and text that repeats
itself costs no more than other text.  Tiles may stand in any order, so that
reordered passages count.  A pair is a leak if tiles cover `coverage` of the
item's tokens.

Items of `block_bytes` of text together (sizes are summed first) are broadcast and
meet the documents in one pass without a shuffle.  Larger benchmarks are joined on
the cluster: documents put out only seeds that hit a bit map of the items' seeds
(of a fixed size), these meet the items' seeds in an equality join, and only texts
of pairs that can reach the coverage are joined for tiling.  Both ways give the
same rows.

Cases: null or empty texts and items have no tokens and never leak; an item of
fewer than `min_match` tokens must occur whole; repeated items and repeated rows
are all reported; null ids of documents and items keep their rows; very long
texts cost memory in proportion to their length; an empty table gives an empty
result; other columns are ignored, or pass through `clean`.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .shared import written

MIN_MATCH, COVERAGE, BLOCK_BYTES = 5, 0.5, 8 << 20
#: Bits of the map of seeds: 16 MB.
MAP_BITS = 27
#: ASCII that is neither letter nor digit parts tokens.
PARTS = np.zeros(256, bool)
PARTS[:128] = True
PARTS[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)]] = False
LEAKS = "n_item_tokens int, covered_tokens int, n_tiles int, longest_tile int, coverage double"


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of the tokens."""
    data = K.LOWER[data]
    starts, ends, rows = K.word_spans(data, offsets, PARTS)
    return K.spans_hash(data, starts, ends), rows


class Items:
    """A block of benchmark items and their seeds."""

    def __init__(self, ids: list, texts: list, min_match: int):
        self.ids = ids
        data, offsets = K.text_buffers(pa.array(texts, pa.string()))
        self.words, rows = tokens(data, offsets)
        self.length = np.bincount(rows, minlength=len(ids))
        self.start = np.concatenate([[0], np.cumsum(self.length)])
        self.width = np.minimum(self.length, min_match)
        #: By width: distinct seeds, and for each the range of its items, with the seed's places in the item.
        self.seeds = []
        for width in sorted({int(w) for w in self.width if w}):
            keys, valid = K.ngram_hash(self.words, rows, width)
            at = np.flatnonzero(valid & (self.width[rows[: len(keys)]] == width))
            order = at[np.lexsort((rows[at], keys[at]))]
            new_key = np.append(True, np.diff(keys[order]) != 0)
            heads = np.flatnonzero(new_key | np.append(True, np.diff(rows[order]) != 0))
            places = np.diff(np.append(heads, len(order)))
            firsts = np.flatnonzero(new_key[heads])
            may = np.zeros(1 << 22, bool)
            may[keys[order] >> K.U64(42)] = True
            self.seeds.append((width, keys[order[heads[firsts]]], np.append(firsts, len(heads)), rows[order[heads]], places, may))

    def candidates(self, words: np.ndarray, rows: np.ndarray, coverage: float):
        """(row, item) of the pairs whose shared seeds may cover enough of the item."""
        for width, keys, ranges, items, places, may in self.seeds:
            seen, valid = K.ngram_hash(words, rows, width)
            here = np.flatnonzero(valid & may[seen >> K.U64(42)])
            at = np.searchsorted(keys, seen[here])
            hit = keys[np.minimum(at, len(keys) - 1)] == seen[here]
            met = np.unique(rows[here[hit]] * len(keys) + at[hit])  # (row, seed)
            row, seed = met // len(keys), met % len(keys)
            for lo in range(0, len(row), 4096):  # a seed's items, for some seeds of the rows at a time
                lo, hi = (np.searchsorted(row, row[lo]) if lo else 0), (np.searchsorted(row, row[lo + 4096]) if lo + 4096 < len(row) else len(row))
                n = np.diff(ranges)[seed[lo:hi]]
                if not len(n):
                    continue
                nth = np.repeat(ranges[seed[lo:hi]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                pair = np.repeat(row[lo:hi], n) * len(self.ids) + items[nth]
                order = np.argsort(pair, kind="stable")
                heads = np.flatnonzero(np.append(True, np.diff(pair[order]) != 0))
                shared = np.add.reduceat(places[nth][order], heads)
                pair = pair[order[heads]]
                for k in np.flatnonzero(shared * width >= coverage * self.length[pair % len(self.ids)]):
                    yield int(pair[k] // len(self.ids)), int(pair[k] % len(self.ids))


def tiles(item: np.ndarray, doc: np.ndarray, min_match: int, coverage: float = 0.0) -> list[tuple[int, int, int]]:
    """Greedy tiles (item start, document start, length) of two token sequences; none if shared seeds cover less than `coverage`."""
    sides = []
    keys = [K.ngram_hash(x, np.zeros(len(x), np.int64), min_match)[0] for x in (item, doc)]
    for words, mine, others in ((item, *keys), (doc, *keys[::-1])):
        shared = K.covered(np.isin(mine, others), min_match, len(words))
        keep = shared.copy()
        keep[1:] |= shared[:-1]  # one token after each stretch parts it from the next
        at = np.flatnonzero(keep)
        up, down = K.powers(len(at) + 1)
        sums = np.concatenate([[K.U64(0)], np.cumsum(words[at] * up[: len(at)])])
        sides.append((at, ~shared[at], sums, down))
    if sides[0][0].size == 0 or (~sides[0][1]).sum() < coverage * len(item):
        return []

    def windows(side, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and Karp-Rabin hashes of the runs of n tokens without a mark."""
        at, marked, sums, down = side
        if len(at) < n:
            return at[:0], sums[:0]
        marks = np.concatenate([[0], np.cumsum(marked)])
        free = np.flatnonzero(marks[n:] == marks[: len(marks) - n])
        return free, (sums[free + n] - sums[free]) * down[free]

    out: list[tuple[int, int, int]] = []
    longest = min(len(s[0]) for s in sides)
    while longest >= min_match:
        low, high = min_match - 1, longest  # the longest match lies in low..high
        while low < high:
            middle = (low + high + 1) // 2
            if np.isin(windows(sides[0], middle)[1], windows(sides[1], middle)[1]).any():
                low = middle
            else:
                high = middle - 1
        n = low
        if n < min_match:
            break
        (i, hi), (j, hj) = windows(sides[0], n), windows(sides[1], n)
        i, j, hj = i[on := np.isin(hi, hj)], j[has := np.isin(hj, hi)], hj[has]
        hi = hi[on]
        order = np.argsort(hj, kind="stable")
        j, hj = j[order], hj[order]
        ends = np.searchsorted(hj, hi, "right").tolist()
        begins = np.searchsorted(hj, hi, "left").tolist()
        places, next_free = j.tolist(), {}
        taken: list[int] = []  # starts of this length's tiles in the document, sorted
        free_from = 0
        for a, lo, to in zip(i.tolist(), begins, ends):
            if a < free_from:
                continue
            k = next_free.get(lo, lo)
            x, alike = int(sides[0][0][a]), True
            while k < to:
                b = places[k]
                t = bisect_left(taken, b - n + 1)
                if t < len(taken) and taken[t] < b + n:  # on to the first place after the tile in the way
                    k = bisect_left(places, taken[t] + n, k, to)
                    continue
                y = int(sides[1][0][b])
                if np.array_equal(item[x : x + n], doc[y : y + n]):
                    break
                k, alike = k + 1, False  # equal by the window's hash alone
            if alike:
                next_free[lo] = k
            if k < to:
                out.append((x, y, n))
                taken.insert(bisect_left(taken, b), b)
                free_from = a + n
                sides[0][1][a : a + n] = True
                sides[1][1][b : b + n] = True
        longest = n - 1
    return out


def leaks_in(items: Items, data: np.ndarray, offsets: np.ndarray, coverage: float) -> list[tuple]:
    """(row, item index, item tokens, covered, tiles, longest) of every leak in a text buffer."""
    words, rows = tokens(data, offsets)
    cuts = np.searchsorted(rows, np.arange(len(offsets)))
    out = []
    for row, item in items.candidates(words, rows, coverage):
        mine = items.words[items.start[item] : items.start[item + 1]]
        if measured := _leak(mine, words[cuts[row] : cuts[row + 1]], int(items.width[item]), coverage):
            out.append((row, item, *measured))
    return out


def _leak(item: np.ndarray, doc: np.ndarray, width: int, coverage: float) -> tuple | None:
    """(item tokens, covered, tiles, longest) if tiles cover enough of the item."""
    found = tiles(item, doc, width, coverage) if width else []
    covered = sum(t[2] for t in found)
    return (len(item), covered, len(found), max(t[2] for t in found)) if found and covered >= coverage * len(item) else None


_made: dict[str, Items] = {}


def _block(benchmark: DataFrame, item: str, text: str, min_match: int, block_bytes: int):
    """A function that gives the worker's Items, or None if the benchmark is larger than a block."""
    rows = benchmark.select(F.col(item).alias("item"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    if (rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0) > block_bytes:
        return None
    part = rows.collect()  # block_bytes at most
    shipped, key = benchmark.sparkSession.sparkContext.broadcast(([r.item for r in part], [r.text for r in part])), uuid.uuid4().hex

    def items() -> Items:
        if key not in _made:
            _made.clear()
            _made[key] = Items(*shipped.value, min_match)
        return _made[key]

    return items


def _seeds(texts: DataFrame, min_match: int, widths: list[int] | None, bits: np.ndarray | None, map_bits: int) -> DataFrame:
    """(seed, key, width, places, n) of each distinct seed of (key, text): at one width, or at each of `widths` where the map has it."""
    spark = texts.sparkSession
    shipped = spark.sparkContext.broadcast(bits) if bits is not None else None

    def run(batches):
        for batch in batches:
            data, offsets = K.text_buffers(batch.column(1))
            for lo, hi in K.row_chunks(offsets):
                part = offsets[lo : hi + 1]
                words, rows = tokens(data[part[0] : part[-1]], part - part[0])
                length = np.bincount(rows, minlength=hi - lo)
                for width in widths or range(1, min_match + 1):
                    seen, valid = K.ngram_hash(words, rows, width)
                    if not len(seen):
                        continue
                    if widths is None:
                        valid &= np.minimum(length, min_match)[rows[: len(seen)]] == width
                    else:
                        slot = seen >> K.U64(64 - map_bits)
                        valid &= (shipped.value[slot >> K.U64(3)] >> (slot & K.U64(7)).astype(np.uint8)) & 1 > 0
                    at = np.flatnonzero(valid)
                    order = at[np.lexsort((rows[at], seen[at]))]
                    heads = np.flatnonzero(np.append(True, (np.diff(seen[order]) != 0) | (np.diff(rows[order]) != 0))) if len(order) else order
                    first, places = order[heads], np.diff(np.append(heads, len(order)))
                    yield pa.RecordBatch.from_arrays([pa.array(seen[first].view(np.int64)), batch.column(0).take(pa.array(lo + rows[first])), pa.array(np.full(len(first), width, np.int32)), pa.array(places.astype(np.int64)), pa.array(length[rows[first]].astype(np.int32))], names=["seed", "key", "width", "places", "n"])

    return texts.mapInArrow(K.tidy(run), "seed long, key string, width int, places long, n int")


def _joined(docs: DataFrame, benchmark: DataFrame, text: str, item_text: str, min_match: int, coverage: float, map_bits: int) -> DataFrame:
    """(key, item_key, LEAKS) of different texts that leak, joined on the cluster; keys are SHA-256 of the texts."""
    texts = docs.select(F.sha2(text, 256).alias("key"), F.col(text).alias("text")).where("text IS NOT NULL")
    items = written(benchmark.select(F.sha2(item_text, 256).alias("key"), F.col(item_text).alias("text")).where("text IS NOT NULL").dropDuplicates(["key"]), "items")
    seeds = written(_seeds(items, min_match, None, None, map_bits), "seeds")
    slot = F.shiftrightunsigned("seed", 64 - map_bits)
    words = seeds.groupBy(F.shiftright(slot, 5).alias("at")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(31).cast("int"))).alias("bits")).toArrow()  # 2 ** (map_bits - 5) rows at most
    bits = np.zeros(1 << (map_bits - 5), np.uint32)
    bits[words.column(0).to_numpy()] = words.column(1).to_numpy().astype(np.uint32)
    widths = sorted(r.width for r in seeds.select("width").distinct().collect())  # min_match at most
    if not widths:
        widths = [min_match]
    met = _seeds(texts, min_match, widths, bits.view(np.uint8), map_bits).select("seed", "width", "key").distinct()
    pairs = met.join(seeds.withColumnRenamed("key", "item_key"), ["seed", "width"]).groupBy("key", "item_key", "n", "width").agg(F.sum("places").alias("places"))
    pairs = written(pairs.where(F.col("places") * F.col("width") >= coverage * F.col("n")).select("key", "item_key", "width"), "pairs")
    held = texts.join(pairs.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"])
    both = pairs.join(items.select(F.col("key").alias("item_key"), F.col("text").alias("item_text")), "item_key").join(held, "key").select("key", "item_key", "width", "item_text", "text")

    def run(batches):
        for batch in batches:
            sides = []
            for c in (3, 4):
                data, offsets = K.text_buffers(batch.column(c))
                words, rows = tokens(data, offsets)
                sides.append((words, np.searchsorted(rows, np.arange(len(offsets)))))
            (a, ca), (b, cb) = sides
            got = [(k, m) for k, width in enumerate(batch.column(2).to_pylist()) if (m := _leak(a[ca[k] : ca[k + 1]], b[cb[k] : cb[k + 1]], width, coverage))]
            if got:
                at = pa.array([k for k, _ in got])
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *(pa.array(x, pa.int32()) for x in zip(*(m for _, m in got))), pa.array([m[1] / m[0] for _, m in got])], names=["key", "item_key", "n_item_tokens", "covered_tokens", "n_tiles", "longest_tile", "coverage"])

    return written(both.mapInArrow(K.tidy(run), f"key string, item_key string, {LEAKS}"), "leaks")


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", min_match: int = MIN_MATCH, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES, map_bits: int = MAP_BITS) -> DataFrame:
    """A row for each document and item whose tiles reach the coverage: the two ids and LEAKS."""
    kinds = dict(docs.dtypes)[id_col], dict(benchmark.dtypes)[item]
    measures = [c.split()[0] for c in LEAKS.split(", ")]
    items = _block(benchmark, item, item_text, min_match, block_bytes)
    if items is None:
        found = _joined(docs, benchmark, text, item_text, min_match, coverage, map_bits)
        d = docs.select(F.col(id_col).alias("d"), F.sha2(text, 256).alias("key")).join(found, "key")
        i = benchmark.select(F.col(item).alias("i"), F.sha2(item_text, 256).alias("item_key"))
        return d.join(i, "item_key").select(F.col("d").alias(id_col), F.col("i").alias(item), *measures)
    schema_item = pa.string() if kinds[1] == "string" else pa.int32() if kinds[1] == "int" else pa.int64()

    def run(batches):
        block = items()
        for batch in batches:
            data, offsets = K.text_buffers(batch.column(1))
            for lo, hi in K.row_chunks(offsets):
                part = offsets[lo : hi + 1]
                got = leaks_in(block, data[part[0] : part[-1]], part - part[0], coverage)
                if got:
                    row, k, n, hit, count, longest = zip(*got)
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([lo + r for r in row])), pa.array([block.ids[x] for x in k], schema_item), *(pa.array(x, pa.int32()) for x in (n, hit, count, longest)), pa.array([h / m for h, m in zip(hit, n)])], names=["d", "i", *measures])

    return docs.select(id_col, text).mapInArrow(K.tidy(run), f"d {kinds[0]}, i {kinds[1]}, {LEAKS}").withColumnsRenamed({"d": id_col, "i": item})


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", min_match: int = MIN_MATCH, coverage: float = COVERAGE, block_bytes: int = BLOCK_BYTES, map_bits: int = MAP_BITS) -> DataFrame:
    """The rows of `docs` without a leak."""
    items = _block(benchmark, item, item_text, min_match, block_bytes)
    if items is None:
        found = _joined(docs, benchmark, text, item_text, min_match, coverage, map_bits).select("key").distinct()
        return docs.join(found, F.sha2(docs[text], 256) == found["key"], "left_anti")

    def run(batches):
        block = items()
        for batch in batches:
            data, offsets = K.text_buffers(batch.column(text))
            stays = np.ones(len(offsets) - 1, bool)
            for lo, hi in K.row_chunks(offsets):
                part = offsets[lo : hi + 1]
                for got in leaks_in(block, data[part[0] : part[-1]], part - part[0], coverage):
                    stays[lo + got[0]] = False
            yield batch.filter(pa.array(stays))

    return docs.mapInArrow(K.tidy(run), docs.schema)
