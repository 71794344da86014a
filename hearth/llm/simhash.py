"""SimHash near-duplicates by deletion-variant signatures.

Fingerprints link at `distance` or fewer differing bits.  The 64 bits are cut
into so few segments that one differs by at most one bit (three for a distance
of four: with two bits each, six would differ).  Each segment is indexed once for
every bit replaced by a wildcard, so linked fingerprints share a variant.
Variants are joined by equality and every link is verified on all 64 bits.

Not all pairs of a bucket are made.  Equal fingerprints are one node.  In each
bucket every member is first compared with the least and the greatest one, and
the components of those links are found.  Then members of the same bucket in
different components are compared inside the join's condition, so that it puts
out a row only for a link still missing; in a large bucket, where most members
are one cloud of near copies, only those outside its largest component are
compared with all.  Together these give exactly the components of all links.

Cases: a null text is an empty one; texts without words have fingerprint zero
and link like any other; a null doc_id has a fingerprint and takes the component
of its fingerprint, but is no candidate for the component's name (null if there
is none); repeated rows give repeated result rows; an empty table gives an empty
result; very long texts cost memory in proportion to their length; other columns
are ignored, and may have any name.
"""

from __future__ import annotations

from functools import reduce
from itertools import accumulate
from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .shared import components, dropped, merged, met, unused, written


def fingerprints_of(texts: list[str], width: int, seed: int) -> np.ndarray:
    """The fingerprint of each text, as signed 64-bit numbers."""
    from xxhash import xxh64_intdigest as digest

    hashes: list[int] = []
    sizes = np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts):
        words = text.encode().lower().split()
        n = len(words)
        if not n:
            continue
        flat = b" ".join(words)
        if n <= width:
            hashes.append(digest(flat, seed))
            sizes[k] = 1
            continue
        ends = [e + i for i, e in enumerate(accumulate(map(len, words)))]
        starts = [0, *(e + 1 for e in ends)]
        hashes += [digest(flat[s:e], seed) for s, e in zip(starts, ends[width - 1 :])]
        sizes[k] = n - width + 1
    out = np.zeros(len(texts), np.int64)
    full = np.flatnonzero(sizes)
    if len(full):
        at = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        values = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
        for byte in range(8):
            bits = np.unpackbits(values[:, byte : byte + 1], axis=1, bitorder="little")
            ones = np.add.reduceat(bits, at, axis=0, dtype=np.int32)
            on = np.packbits(2 * ones > sizes[full, None], axis=1, bitorder="little")[:, 0]
            out[full] |= (on.astype(np.uint64) << np.uint64(8 * byte)).view(np.int64)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 4, seed: int = 42) -> DataFrame:
    """(id, fp) of every row: lower-cased words, shingles of `width` words, XXH64 with `seed`."""

    def run(batches):
        for batch in batches:
            column = pc.fill_null(batch.column(1), "")
            for at in range(0, len(column), 256):
                texts = column.slice(at, 256).to_pylist()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 256), pa.array(fingerprints_of(texts, width, seed))], names=["id", "fp"])

    return docs.select(id_col, text).mapInArrow(K.tidy(run), "id long, fp long")


def variant_keys(fp, distance: int):
    """The one-wildcard segment variants of a fingerprint, each with its wildcard's place in the high bits."""
    n = distance // 2 + 1  # least n with 2 n > distance
    cuts = [64 * i // n for i in range(n + 1)]
    keys = []
    for lo, hi in zip(cuts, cuts[1:]):
        if hi - lo > 57:
            raise ValueError("a distance below two needs no variants")
        for p in range(lo, hi):
            mask = ((1 << hi) - (1 << lo)) & ~(1 << p)
            mask -= 1 << 64 if mask >> 63 else 0
            keys.append(F.shiftrightunsigned(fp.bitwiseAND(F.lit(mask)), lo).bitwiseOR(F.lit((p << 57) - (1 << 64 if p >= 64 else 0)) if hi - lo > 31 else F.lit(p << 32)))
    return F.array(*keys)


def linked(fps: DataFrame, distance: int = 4, hot_bucket: int = 64) -> DataFrame:
    """(fp, component) for each distinct fingerprint of `fps` (columns id, fp); component is the least id reachable."""

    def close(a, b):
        return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= distance

    nodes = fps.groupBy("fp").agg(F.min("id").alias("id"))
    # a fingerprint is small but has many variants: keep adaptive execution from gathering all of them in a few tasks
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nodes = nodes.repartition(parts, F.xxhash64("fp"))  # (by fp itself it would be optimised away)
    keys = F.explode(variant_keys(F.col("fp"), distance)).alias("key")
    variants = nodes.select("fp", keys)
    groups = written(variants.groupBy("key").agg(F.min("fp").alias("first"), F.max("fp").alias("last"), F.count("*").alias("n")).where("first < last"), "buckets")
    near = close("fp", "first") & (F.col("fp") != F.col("first")) | close("fp", "last") & (F.col("fp") != F.col("last"))
    ends = variants.join(merged(groups.withColumnRenamed("key", "k")), (F.col("key") == F.col("k")) & near).select("fp", F.when(close("fp", "first"), F.col("first")).alias("b1"), F.when(close("fp", "last"), F.col("last")).alias("b2"))
    stars = ends.select(F.col("fp").alias("a"), F.explode(F.array("b1", "b2")).alias("b")).where("a != b").distinct()
    first = written(components(stars), "components")

    # links between components: all members of a bucket meet; in a large one only those outside its largest component meet all
    labelled = nodes.select("fp").join(merged(first), F.col("fp") == first.id, "left").select("fp", F.coalesce("component", "fp").alias("c")).select("fp", "c", keys)
    large = written(groups.where(F.col("n") > hot_bucket).select("key"), "large")
    small = labelled.join(merged(large), "key", "left_anti")
    a, b = small.selectExpr("key", "fp fp1", "c c1"), small.selectExpr("key", "fp fp2", "c c2")
    rest = a.join(merged(b), (a.key == b.key) & (F.col("c1") < F.col("c2")) & close("fp1", "fp2")).selectExpr("c1 a", "c2 b")
    inside = written(labelled.join(merged(large), "key"), "members")
    major = inside.groupBy("key", "c").agg(F.count("*").alias("m")).groupBy(F.col("key").alias("k")).agg(F.max_by("c", F.struct("m", "c")).alias("major"))
    minor = inside.join(merged(major), (F.col("key") == F.col("k")) & (F.col("c") != F.col("major"))).selectExpr("key", "fp fp1", "c c1")
    others = inside.selectExpr("key other", "fp fp2", "c c2")
    rest = rest.union(minor.join(merged(others), (F.col("key") == F.col("other")) & (F.col("c1") != F.col("c2")) & close("fp1", "fp2")).select(F.least("c1", "c2"), F.greatest("c1", "c2"))).distinct()
    second = components(rest).withColumnRenamed("component", "c2").withColumnRenamed("id", "c1")
    whole = nodes.join(merged(first.withColumnRenamed("id", "fp")), "fp", "left").select("fp", "id", F.coalesce("component", "fp").alias("c"))
    whole = written(whole.join(merged(second), whole.c == second.c1, "left").select("fp", "id", F.coalesce("c2", "c").alias("c")), "labels")
    # the least ids are a table of their own, so that adaptive execution can split a label that many fingerprints bear
    names = written(whole.groupBy("c").agg(F.min("id").alias("component")), "names")
    out = written(whole.join(merged(names), "c").select("fp", "component"), "groups")
    dropped(groups, large, inside, first, whole, names)
    return out


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", distance: int = 4, width: int = 4, seed: int = 42) -> DataFrame:
    """id_col, fingerprint (16 hexadecimal digits) and component_id of every row."""
    fps = written(fingerprints(docs, id_col, text, width, seed), "fingerprints")
    names = linked(fps, distance)
    return fps.join(merged(names), "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of `docs` with the least id of each group, one row for each such id; rows without an id stay."""
    stays, turn = (unused(name, docs) for name in ("stays", "turn"))
    groups = simhash_groups(docs, id_col, text, **how)
    stay = groups.where(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias(stays)).distinct()
    named = docs.join(merged(stay), docs[id_col] == stay[stays], "left_semi")
    order = F.row_number().over(Window.partitionBy(id_col).orderBy(F.xxhash64(text)))
    named = named.withColumn(turn, order).where(F.col(turn) == 1).drop(turn)
    return named.unionByName(docs.where(F.col(id_col).isNull()))


# near copies by similarity: wide fingerprints find candidates, texts decide


def wide_fingerprints_of(texts: list[str], width: int) -> np.ndarray:
    """128 bits of each text from its shingles of `width` words, as two signed 64-bit numbers a row."""
    from xxhash import xxh3_128_digest as digest

    out = np.zeros((len(texts), 16), np.uint8)
    for k, text in enumerate(texts):
        words = text.encode().lower().split()
        n = len(words) - width + 1
        if not words:
            continue
        flat = b" ".join(words)
        if n <= 1:
            out[k] = np.frombuffer(digest(flat), np.uint8)
            continue
        ends = [e + i for i, e in enumerate(accumulate(map(len, words)))]
        starts = [0, *(e + 1 for e in ends)]
        hashes = np.frombuffer(b"".join([digest(flat[s:e]) for s, e in zip(starts, ends[width - 1 :])]), np.uint8).reshape(n, 16)
        ones = np.zeros(128, np.int64)
        for at in range(0, n, 65_536):
            ones += np.unpackbits(hashes[at : at + 65_536], axis=1).sum(0, dtype=np.int64)
        out[k] = np.packbits(2 * ones > n)
    return out.view(np.int64)


def _shingle_sets(column, width: int) -> list[np.ndarray]:
    """The distinct shingles of each text; all of a text with fewer words."""
    data, offsets = K.text_buffers(column)
    data = K.LOWER[data]
    starts, ends, rows = K.word_spans(data, offsets)
    words = K.spans_hash(data, starts, ends)
    cuts = np.searchsorted(rows, np.arange(len(offsets)))
    sets = []
    for i, j in zip(cuts, cuts[1:]):
        own = words[i:j]
        sets.append(np.unique(K.ngram_hash(own, np.zeros(len(own), np.int64), min(width, max(len(own), 1)))[0]))
    return sets


def alike(pairs: DataFrame, width: int, similarity: float) -> DataFrame:
    """(a, b) of the pairs (a, b, text_a, text_b) whose shingle sets have this Jaccard similarity."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                left, right = (_shingle_sets(part.column(c), width) for c in (2, 3))
                both = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(left, right)]
                keep = [n >= similarity * (len(x) + len(y) - n) for n, x, y in zip(both, left, right)]
                yield part.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("a", "b", "text_a", "text_b").mapInArrow(K.tidy(run), "a long, b long")


def near_candidates(nodes: DataFrame, distance: int, segment_bits: int, hot_bucket: int = 64) -> DataFrame:
    """(id, c) of nodes (id, f0, f1) that lie in a component of fingerprints `distance` or fewer bits apart that share a segment but for one bit."""

    def apart(a: str, b: str):
        return F.bit_count(F.col(f"{a}0").bitwiseXOR(F.col(f"{b}0"))) + F.bit_count(F.col(f"{a}1").bitwiseXOR(F.col(f"{b}1")))

    keys = []
    for place, lo in enumerate(range(0, 64 - segment_bits + 1, segment_bits)):
        for p in range(segment_bits):
            mask = ((1 << segment_bits) - 1) & ~(1 << p)
            keys.append(F.shiftrightunsigned("f0", lo).bitwiseAND(F.lit(mask)).bitwiseOR(F.lit((place * 64 + p) << 32)))
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    nodes = nodes.repartition(parts, F.xxhash64("id"))
    variants = nodes.select("id", "f0", "f1", F.explode(F.array(*keys)).alias("key"))
    found = variants.groupBy("key").agg(F.min("id").alias("x"), F.max("id").alias("y"), F.count("*").alias("n")).where("x < y")
    x, y = (nodes.select(F.col("id").alias(e), F.col("f0").alias(f"{e}0"), F.col("f1").alias(f"{e}1")) for e in ("x", "y"))
    groups = written(found.withColumnRenamed("key", "k").join(merged(x), "x").join(merged(y), "y"), "buckets")
    to_x, to_y = (apart("f", e) <= distance for e in ("x", "y"))
    ends = variants.join(merged(groups), (F.col("key") == F.col("k")) & (to_x & (F.col("id") != F.col("x")) | to_y & (F.col("id") != F.col("y"))))
    stars = ends.select(F.col("id").alias("a"), F.explode(F.array(F.when(to_x, F.col("x")), F.when(to_y, F.col("y")))).alias("b")).where("a != b").distinct()
    first = written(components(stars), "components")

    labelled = nodes.join(merged(first.withColumnRenamed("component", "c")), "id", "left").withColumn("c", F.coalesce("c", "id")).select("c", "f0", "f1", F.explode(F.array(*keys)).alias("key"))
    shared = written(labelled.join(merged(groups.select(F.col("k").alias("key"), "n")), "key"), "members")
    major = shared.where(F.col("n") > hot_bucket).groupBy("key", "c").agg(F.count("*").alias("m")).groupBy(F.col("key").alias("k")).agg(F.max_by("c", F.struct("m", "c")).alias("major"))
    small = shared.where(F.col("n") <= hot_bucket)
    minor = met(shared.where(F.col("n") > hot_bucket), major.withColumnRenamed("k", "key"), "key").where("c <> major")

    def side(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(F.col("key").alias(f"k{name}"), F.col("c").alias(f"c{name}"), F.col("f0").alias(f"{name}0"), F.col("f1").alias(f"{name}1"))

    close = apart("p", "q") <= distance
    rest = side(small, "p").join(merged(side(small, "q")), (F.col("kp") == F.col("kq")) & (F.col("cp") < F.col("cq")) & close).select(F.col("cp").alias("a"), F.col("cq").alias("b"))
    more = side(minor, "p").join(merged(side(shared.where(F.col("n") > hot_bucket), "q")), (F.col("kp") == F.col("kq")) & (F.col("cp") != F.col("cq")) & close).select(F.least("cp", "cq").alias("a"), F.greatest("cp", "cq").alias("b"))
    # one more run of components over both kinds of links gives the labels without joining on one that many bear
    found = written(components(first.selectExpr("id a", "component b").union(rest.union(more).distinct())), "candidates")
    dropped(groups, first, shared)
    return found.select("id", F.col("component").alias("c"))


#: Places that the shingles of all texts are counted in, to tell frequent ones.
PLACES = 1 << 18
SKETCH_BITS = 256


def _places(shingles: np.ndarray) -> np.ndarray:
    return (K.mix(shingles) % np.uint64(PLACES)).astype(np.int64)


def frequent_places(docs: DataFrame, text: str, width: int) -> np.ndarray:
    """For each place whether far more texts than on average have a shingle there; the driver is given those places only."""

    def run(batches):
        counts = np.zeros(PLACES, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for shingles in _shingle_sets(batch.column(0).slice(at, 256), width):
                    np.add.at(counts, _places(shingles), 1)
        met_ = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(met_), pa.array(counts[met_])], names=["place", "n"])

    counts = written(docs.select(text).mapInArrow(K.tidy(run), "place long, n long").groupBy("place").agg(F.sum("n").alias("n")), "places")
    total = counts.agg(F.sum("n")).first()[0] or 0
    out = np.zeros(PLACES, bool)
    out[[r.place for r in counts.where(F.col("n") > max(4 * total / PLACES, 32)).select("place").collect()]] = True
    dropped(counts)
    return out


def prefix(shingles: np.ndarray, similarity: float, frequent: np.ndarray) -> np.ndarray:
    """So many of a set's shingles, rare ones first, that any set of this similarity shares one of as many of its own; all sets without shingles share 0."""
    n = len(shingles)
    if not n:
        return np.zeros(1, np.int64)
    often = frequent[_places(shingles)]
    return np.concatenate([shingles[~often], shingles[often]])[: n - ceil(similarity * n - 1e-9 * n) + 1].view(np.int64)


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Parities of the shingles by hash: two sets' sketches differ in no more bits than the sets in shingles."""
    odd = np.bincount((K.mix(~shingles) % np.uint64(SKETCH_BITS)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def missed_links(docs: DataFrame, sets: DataFrame, links: DataFrame, width: int, similarity: float) -> DataFrame:
    """(a, b) of ids in different components of `links` (a, b) so that all components of alike texts are found.

    docs: id, h1, h2, text; sets: id, h1, h2, n, prefix, sketch of each distinct text.
    Sets of this similarity share a shingle of their prefixes, so pairs are made
    where texts of different components meet there, each with one side outside the
    bucket's largest component, and kept if sizes, sketches and the number of
    shingles that their prefixes share allow the similarity.
    The texts decide: first on one pair for each two components, then on all pairs
    of those still apart.
    """
    first = components(links)
    parts = sets.join(merged(first), "id", "left").select("id", F.coalesce("component", "id").alias("c"), "n", (F.col("n") - F.size("prefix")).alias("rest"), "sketch", "prefix")
    parts = written(parts, "labelled")
    keys = parts.select("c", F.explode("prefix").alias("key")).groupBy("key").agg(F.min("c").alias("x"), F.max("c").alias("y")).where("x < y").select("key")
    keys = written(keys, "keys")
    shared = written(parts.select("id", "c", "n", "rest", "sketch", F.explode("prefix").alias("key")).join(merged(keys), "key"), "shared")
    major = written(shared.groupBy("key", "c").agg(F.count("*").alias("m")).groupBy("key").agg(F.max_by("c", F.struct("m", "c")).alias("major")), "major")
    minor = shared.join(merged(major), "key").where("c <> major")

    def side(rows: DataFrame, name: str, *more: str) -> DataFrame:
        return rows.select(F.col("key").alias(f"k{name}"), F.col("id").alias(f"i{name}"), F.col("c").alias(f"c{name}"), F.col("n").alias(f"n{name}"), F.col("rest").alias(f"r{name}"), *[F.col("sketch")[j].alias(f"{name}{j}") for j in range(SKETCH_BITS // 64)], *more)

    differ = reduce(Column.__add__, [F.bit_count(F.col(f"p{j}").bitwiseXOR(F.col(f"q{j}"))) for j in range(SKETCH_BITS // 64)])
    both = F.col("np") + F.col("nq")
    # sets of similarity s share s / (1 + s) of their summed sizes at least, and differ in the rest
    least = both * similarity / (1 + similarity) - 1e-6
    may = (F.least("np", "nq") >= similarity * F.greatest("np", "nq") - 1e-6) & (differ <= both - 2 * least)
    once = (F.col("cq") == F.col("major")) | (F.col("cp") < F.col("cq"))
    met_ = side(minor, "p", "major").join(merged(side(shared, "q")), (F.col("kp") == F.col("kq")) & (F.col("cp") != F.col("cq")) & once & may)
    ends = [F.struct(F.col(f"c{e}").alias("c"), F.col(f"i{e}").alias("id")) for e in "pq"]
    pairs = met_.select(F.least(*ends).alias("x"), F.greatest(*ends).alias("y"), (differ / F.greatest(both, F.lit(1))).alias("far"), (F.ceil(least) - F.greatest("rp", "rq")).alias("need")).selectExpr("x.c cx", "x.id a", "y.c cy", "y.id b", "far", "need")
    # of two sets' shared shingles all but as many as one of them holds after its prefix lie in both prefixes: each is a row here
    pairs = found = written(pairs.groupBy("cx", "a", "cy", "b").agg(F.min("far").alias("far"), F.min("need").alias("need"), F.count("*").alias("n")).where("n >= need").select("cx", "a", "cy", "b", "far"), "pairs")
    members = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    texts = docs.join(merged(sets.select("id", "h1", "h2").join(merged(members), "id", "left_semi")), ["id", "h1", "h2"], "left_semi").dropDuplicates(["id", "h1", "h2"]).select("id", "text")
    texts = written(texts, "pair_texts")

    def confirmed(some: DataFrame) -> DataFrame:
        a, b = (texts.select(F.col("id").alias(e), F.col("text").alias(f"text_{e}")) for e in "ab")
        return written(alike(some.join(merged(a), "a").join(merged(b), "b"), width, similarity), "links")

    near = confirmed(pairs.groupBy("cx", "cy").agg(F.min_by(F.struct("a", "b"), F.struct("far", "a", "b")).alias("p")).select("p.a", "p.b"))
    joined = near.join(merged(pairs.select("a", "b", "cx", "cy")), ["a", "b"]).select(F.col("cx").alias("a"), F.col("cy").alias("b"))
    now = written(components(joined), "components")
    for e in "xy":
        pairs = pairs.join(merged(now.select(F.col("id").alias(f"c{e}"), F.col("component").alias(f"now_{e}"))), f"c{e}", "left").withColumn(f"now_{e}", F.coalesce(f"now_{e}", f"c{e}"))
    rest = confirmed(pairs.where("now_x <> now_y").select("a", "b"))
    dropped(parts, keys, shared, major, found, texts, now)
    return near.union(rest)


def one_of_alike(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 5, similarity: float = 0.8, feature_words: int = 2, distance: int = 26, segment_bits: int = 16, functions: int = 16, at_once: int = 4) -> DataFrame:
    """The rows of `docs` without near copies: of each group of texts that are alike, those of the least id; rows without an id stay.

    Texts are alike if their `width`-word shingles have a Jaccard similarity of
    `similarity`.  Equal texts are one node.  Candidates are texts whose 128-bit
    fingerprints (of `feature_words`-word shingles, which an edit changes less)
    share a segment of the first 64 bits but for one bit and lie within `distance`
    bits.  In each component of candidates every text is compared with the least
    id.  What is left is grouped by min-hashes of its shingles, `at_once` of
    `functions` at a time, and compared with the least ids of its groups: work grows
    with the texts, never with the pairs of a group of copies.  This finds most
    links; `missed_links` adds what the groups of all links still lack.
    Links that the texts confirm make the groups.
    """
    stays, turn = (unused(name, docs) for name in ("stays", "turn"))
    plain = F.coalesce(F.col(text), F.lit(""))
    named = docs.where(F.col(id_col).isNotNull())
    keyed = named.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(plain).alias("h1"), F.xxhash64(plain, F.lit(1)).alias("h2"), plain.alias("text"))

    frequent = frequent_places(keyed, "text", width)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                bits = wide_fingerprints_of(part.column(3).to_pylist(), feature_words)
                sets = _shingle_sets(part.column(3), width)
                sizes, sketches, prefixes = pa.array([len(x) for x in sets], pa.int32()), [sketch(x) for x in sets], [prefix(x, similarity, frequent) for x in sets]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(3)), pa.array(bits[:, 0]), pa.array(bits[:, 1]), sizes, pa.array(sketches, pa.list_(pa.int64())), pa.array(prefixes, pa.list_(pa.int64()))], names=["id", "h1", "h2", "f0", "f1", "n", "sketch", "prefix"])

    every = written(keyed.mapInArrow(K.tidy(run), "id long, h1 long, h2 long, f0 long, f1 long, n int, sketch array<long>, prefix array<long>"), "fingerprints")
    # equal texts are one node, and so are texts of one id
    sets = written(every.groupBy("h1", "h2").agg(F.min(F.struct("id", "f0", "f1", "n", "sketch", "prefix")).alias("p")).select("p.*", "h1", "h2"), "texts")
    dropped(every)
    prints = sets.select("id", "f0", "f1", "h1", "h2")
    nodes = prints.groupBy("f0", "f1").agg(F.min("id").alias("id"))
    labels = near_candidates(nodes, distance, segment_bits)
    # texts of one fingerprint are candidates too
    grouped = prints.join(merged(nodes.withColumnRenamed("id", "node")), ["f0", "f1"]).join(merged(labels.withColumnRenamed("id", "node")), "node", "left").select("id", "h1", "h2", F.coalesce("c", "node").alias("c"))
    grouped = written(grouped, "grouped")
    sizes = written(grouped.groupBy("c").agg(F.count("*").alias("n")).where("n > 1").select("c"), "sizes")
    open_ = written(grouped.join(merged(sizes), "c"), "open")
    held = keyed.join(merged(open_.select("id", "h1", "h2")), ["id", "h1", "h2"], "left_semi").groupBy("id").agg(F.min("text").alias("text"))

    def hashed(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                least_hashes = [[K.mix(x ^ K.mix(np.full(1, r + 1, np.uint64))).min().view(np.int64) if len(x) else 0 for r in range(functions)] for x in _shingle_sets(part.column(1), width)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(least_hashes, pa.list_(pa.int64()))], names=["id", "text", "mins"])

    texts = written(held.mapInArrow(K.tidy(hashed), "id long, text string, mins array<long>"), "open_texts")
    open_ = written(open_.select("id", "c").distinct().join(merged(texts.select("id", "mins")), "id"), "open")
    least = prints.select("id").distinct()
    links = []
    for r in range(-at_once, functions, at_once):
        keys = F.array(*[F.struct(F.lit(k).alias("f"), F.col("mins")[k].alias("m")) for k in range(r, min(r + at_once, functions))]) if r >= 0 else F.array(F.struct(F.lit(-1).alias("f"), F.lit(0).cast("long").alias("m")))
        at = open_.select(F.col("id").alias("a"), "c", F.inline(keys))
        heads = written(at.groupBy("c", "f", "m").agg(F.min("a").alias("b"), F.count("*").alias("n")).where("n > 1").select("c", "f", "m", "b"), "heads")
        pairs = at.join(merged(heads), ["c", "f", "m"]).where("a <> b").select("a", "b").distinct()
        both = pairs.join(merged(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))), "a").join(merged(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))), "b")
        links.append(written(alike(both, width, similarity), "links"))
        open_, before = written(open_.join(merged(links[-1].select(F.col("a").alias("id")).distinct()), "id", "left_anti"), "open"), open_
        dropped(heads, before)
        if open_.isEmpty():
            break
    links.append(missed_links(keyed, sets, reduce(DataFrame.union, links), width, similarity))
    gone = components(reduce(DataFrame.union, links)).where("id <> component").select("id")
    stay = written(least.join(merged(gone), "id", "left_anti"), "stay")
    dropped(texts, *links[:-1])
    kept = named.join(merged(stay.withColumnRenamed("id", stays)), F.col(id_col).cast("long") == F.col(stays), "left_semi")
    order = F.row_number().over(Window.partitionBy(id_col).orderBy(F.xxhash64(text)))
    kept = kept.withColumn(turn, order).where(F.col(turn) == 1).drop(turn)
    return kept.unionByName(docs.where(F.col(id_col).isNull()))
