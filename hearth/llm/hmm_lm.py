"""A hidden Markov language model, trained by Baum-Welch over the whole corpus.

Model.  A word's probability given the hidden state is B[state, class(word)] *
P(word | class).  A word's class is the top bits of its hash, so the trained
tables have a fixed size (states x classes) however large the vocabulary grows;
a class is thus a random group of words, in which frequent words weigh most (in
the README, what the states gain nevertheless).
P(word | class) comes from counts over all training texts with absolute
discounting; what is taken off is the class's share for words not seen in
training, which count as one type of the class.  The end of a text is a token
with a class of its own.

Training.  Texts are kept as batches of dictionary-coded tokens in the shared
folder.  Each Baum-Welch round is one pass: every task runs the scaled
forward-backward recursion over its training texts and puts out its expected
counts, which are summed across partitions; only the summed tables (fixed size)
reach the driver.

Recursion.  Texts are cut into blocks of STEPS tokens and all blocks advance
together.  A block's states x states transfer matrix is its tokens' product,
scaled every few steps; blocks of a text are then chained in order, which gives
the exact likelihood and the exact forward and backward vectors at every block
edge, however long the text is.

Scoring.  A batch's dictionary is joined with the vocabulary by word (one row a
batch and word, so that a frequent word adds no large group) and comes back to
its batch by a cogroup.

Words are compared by a 64-bit hash: among V distinct words the odds of any
confusion are about V*V / 2**65.

Cases: a null text is an empty one and is scored as one end token; a null id is
never held out; repeated rows count and are scored each; without training texts
all words are unknown and the state tables stay as they began; very long texts
cost memory in proportion to their length; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .shared import written

END = np.uint64(1)
STEPS, RESCALE = 64, 8
CODED = "batch long, ids array<long>, held array<boolean>, n_tokens array<int>, codes binary, words array<long>, counts array<long>"
SCORES = "n_tokens long, n_known long, train_tokens long, base_score double, score double"


@dataclass(frozen=True)
class Settings:
    states: int = 4
    class_bits: int = 12
    rounds: int = 3
    seed: int = 7
    #: Pseudo-counts of the class unigram in each state's emissions.
    prior: float = 10.0
    #: Text bytes in a batch, at most (one longer text stands alone).
    batch_bytes: int = 6 << 20

    @property
    def classes(self) -> int:
        return (1 << self.class_bits) + 1


def class_of(words: np.ndarray, s: Settings) -> np.ndarray:
    out = (words >> np.uint64(64 - s.class_bits)).astype(np.int64)
    out[words == END] = s.classes - 1
    return out


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes with an END after every row, tokens per row)."""
    data = K.LOWER[data]
    starts, ends, rows = K.word_spans(data, offsets)
    n = len(offsets) - 1
    sizes = np.bincount(rows, minlength=n) + 1
    out = np.full(len(rows) + n, END, np.uint64)
    out[np.arange(len(rows)) + rows] = K.spans_hash(data, starts, ends)
    return out, sizes


def packed(codes: np.ndarray) -> bytes:
    """Codes as four planes of bytes, compressed."""
    return pa.compress(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def unpacked(raw: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(raw, decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel().astype(np.int64)


def coded(docs: DataFrame, held_out, id_col: str, text: str, s: Settings) -> DataFrame:
    """The corpus as batches of dictionary-coded tokens (a table in the shared folder)."""

    def run(batches):
        part, turn = TaskContext.get().partitionId(), 0
        for batch in batches:
            data, offsets = K.text_buffers(batch.column(2))
            for lo, hi in K.row_chunks(offsets, s.batch_bytes):
                words, sizes = [], []
                for i, j in K.row_chunks(offsets[lo : hi + 1]):
                    cut = offsets[lo + i : lo + j + 1]
                    w, n = tokens_of(data[cut[0] : cut[-1]], cut - cut[0])
                    words.append(w)
                    sizes.append(n)
                words, sizes = np.concatenate(words), np.concatenate(sizes)
                held = np.array(batch.column(1).slice(lo, hi - lo).to_pylist(), bool)
                own, codes, often = np.unique(words, return_inverse=True, return_counts=True)
                order = np.argsort(-often, kind="stable")  # frequent words get small codes
                place = np.empty(len(own), np.int64)
                place[order] = np.arange(len(own))
                own, codes = own[order], place[codes]
                counts = np.bincount(codes[np.repeat(~held, sizes)], minlength=len(own))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part << 32 | turn]), pa.array([batch.column(0).slice(lo, hi - lo).to_pylist()], pa.list_(pa.int64())), pa.array([held]), pa.array([sizes.astype(np.int32)]), pa.array([packed(codes)]), pa.array([own.view(np.int64)]), pa.array([counts.astype(np.int64)])],
                    names=["batch", "ids", "held", "n_tokens", "codes", "words", "counts"],
                )
                turn += 1

    chosen = docs.select(F.col(id_col).cast("long"), F.coalesce(held_out, F.lit(False)).alias("held"), text)
    return written(chosen.mapInArrow(K.tidy(run), CODED), "coded")


def _batches(batch: pa.RecordBatch):
    """(held, sizes, codes, words) of each row of a coded table's Arrow batch."""
    at = {name: batch.schema.get_field_index(name) for name in ("held", "n_tokens", "codes", "words")}
    for k in range(batch.num_rows):
        held = np.array(batch.column(at["held"])[k].as_py(), bool)
        sizes = batch.column(at["n_tokens"])[k].values.to_numpy(zero_copy_only=False).astype(np.int64)
        codes = unpacked(batch.column(at["codes"])[k].as_py(), int(sizes.sum()))
        words = batch.column(at["words"])[k].values.to_numpy(zero_copy_only=False).view(np.uint64)
        yield held, sizes, codes, words


class Blocks:
    """Texts cut into blocks that advance together, the longest first."""

    def __init__(self, sizes: np.ndarray):
        per = -(-sizes // STEPS)
        self.doc = np.repeat(np.arange(len(sizes)), per)
        self.nth = np.arange(len(self.doc)) - np.repeat(np.cumsum(per) - per, per)
        self.start = np.repeat(np.cumsum(sizes) - sizes, per) + self.nth * STEPS
        self.size = np.minimum(STEPS, np.repeat(sizes, per) - self.nth * STEPS)
        order = np.argsort(-self.size, kind="stable")
        self.doc, self.nth, self.start, self.size = (x[order] for x in (self.doc, self.nth, self.start, self.size))
        self.first = self.nth == 0
        self.active = [int(np.searchsorted(-self.size, -t, "left")) for t in range(STEPS)]  # blocks longer than t
        by_nth = np.lexsort((self.doc, self.nth))
        cuts = np.flatnonzero(np.append(True, np.diff(self.nth[by_nth]) != 0)) if len(by_nth) else []
        self.turns = np.split(by_nth, cuts[1:]) if len(by_nth) else []


def transfers(blocks: Blocks, emit: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each block's scaled transfer matrix and the log of its scale; emit has a row for each token."""
    n, k = len(blocks.start), a.shape[0]
    m = np.where(blocks.first[:, None, None], np.eye(k), a) * emit[blocks.start][:, None, :]
    logs = np.zeros(n)
    for t in range(1, STEPS):
        live = blocks.active[t]
        if not live:
            break
        m[:live] = (m[:live].reshape(-1, k) @ a).reshape(live, k, k) * emit[blocks.start[:live] + t][:, None, :]
        if t % RESCALE == 0:
            top = m[:live].max(axis=(1, 2))
            m[:live] /= top[:, None, None]
            logs[:live] += np.log(top)
    top = m.max(axis=(1, 2)) if n else np.zeros(0)
    return m / top[:, None, None], logs + np.log(top)


def forward(blocks: Blocks, m: np.ndarray, logs: np.ndarray, start: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """(log-likelihood of each text, forward vector before each block)."""
    v, total = np.tile(start, (docs, 1)), np.zeros(docs)
    at = np.zeros((len(blocks.start), len(start)))
    for turn in blocks.turns:
        d = blocks.doc[turn]
        at[turn] = v[d]
        w = np.einsum("bi,bij->bj", v[d], m[turn])
        s = w.sum(1)
        v[d] = w / s[:, None]
        total[d] += np.log(s) + logs[turn]
    return total, at


def expected(classes: np.ndarray, sizes: np.ndarray, start: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """(log-likelihood, start counts, transition counts, emission counts) of texts under a model."""
    k = len(start)
    blocks, table = Blocks(sizes), np.ascontiguousarray(b.T)
    emit = table[classes]
    m, logs = transfers(blocks, emit, a)
    total, before = forward(blocks, m, logs, start, len(sizes))
    after = np.ones((len(blocks.start), k))
    w = np.ones((len(sizes), k))
    for turn in reversed(blocks.turns):
        d = blocks.doc[turn]
        after[turn] = w[d]
        v = np.einsum("bij,bj->bi", m[turn], w[d])
        w[d] = v / v.sum(1)[:, None]
    path = np.zeros((STEPS, len(blocks.start), k))
    for t in range(STEPS):
        live = blocks.active[t]
        if not live:
            break
        if t:
            u = path[t - 1, :live] @ a
        else:
            u = np.where(blocks.first[:, None], before, before @ a)
        u = u * emit[blocks.start[:live] + t]
        path[t, :live] = u / u.sum(1)[:, None]
    starts, moves, gamma = np.zeros(k), np.zeros((k, k)), np.zeros((len(classes), k))
    beta = after
    for t in range(STEPS - 1, -1, -1):
        live = blocks.active[t]
        if not live:
            continue
        g = path[t, :live] * beta[:live]
        g /= g.sum(1)[:, None]
        here = blocks.start[:live] + t
        gamma[here] = g
        e = emit[here] * beta[:live]
        if t:
            prior = path[t - 1, :live]
        else:
            prior = before
            starts += g[blocks.first].sum(0)
        back = e @ a.T
        weight = 1.0 / (prior * back).sum(1)
        if t:
            moves += prior.T @ (e * weight[:, None])
            beta[:live] = back / back.sum(1)[:, None]
        else:
            on = ~blocks.first
            moves += prior[on].T @ (e[on] * weight[on, None])
    emits = np.stack([np.bincount(classes, gamma[:, i], b.shape[1]) for i in range(k)])
    return float(total.sum()), starts, moves * a, emits


@dataclass(frozen=True)
class Model:
    start: np.ndarray
    moves: np.ndarray
    emits: np.ndarray
    #: Training tokens and distinct words, in all and by class.
    tokens: int
    distinct: int
    class_tokens: np.ndarray
    class_distinct: np.ndarray
    discount: float
    #: Log-likelihood per training token before each round.
    history: tuple


def begun(class_tokens: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sticky states whose emissions are the class unigram with strong fixed noise."""
    noise = np.random.default_rng(s.seed).gamma(0.5, size=(s.states, s.classes)) + 0.05
    emits = (class_tokens + 1.0) * noise
    moves = np.full((s.states, s.states), 0.001 / max(s.states - 1, 1)) + np.eye(s.states) * 0.999
    return np.full(s.states, 1.0 / s.states), moves / moves.sum(1, keepdims=True), emits / emits.sum(1, keepdims=True)


def vocabulary(corpus: DataFrame) -> DataFrame:
    """(word, c) over the training texts, a table in the shared folder."""
    pairs = corpus.select(F.explode(F.arrays_zip("words", "counts")).alias("p")).where("p.counts > 0")
    return written(pairs.groupBy(F.col("p.words").alias("word")).agg(F.sum("p.counts").alias("c")), "vocabulary")


def train(corpus: DataFrame, vocab: DataFrame, s: Settings = Settings()) -> Model:
    spark = corpus.sparkSession
    group = F.when(F.col("word") == int(END), s.classes - 1).otherwise(F.shiftrightunsigned("word", 64 - s.class_bits).cast("int"))
    rows = vocab.groupBy(group.alias("class")).agg(F.sum("c"), F.count("*"), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)).collect()  # a row for each class at most
    class_tokens, class_distinct = np.zeros(s.classes), np.zeros(s.classes)
    for r in rows:
        class_tokens[r[0]], class_distinct[r[0]] = r[1], r[2]
    once, twice = sum(r[3] for r in rows), sum(r[4] for r in rows)
    discount = min(0.95, max(0.05, once / (once + 2 * twice))) if once else 0.5
    start, moves, emits = begun(class_tokens, s)
    unigram = (class_tokens + 1e-3) / (class_tokens + 1e-3).sum()
    history = []
    for _ in range(s.rounds):
        shipped = spark.sparkContext.broadcast((start, moves, emits))

        def run(batches):
            start, moves, emits = shipped.value
            total, sums = 0.0, None
            for batch in batches:
                for held, sizes, codes, words in _batches(batch):
                    classes = class_of(words, s)[codes[np.repeat(~held, sizes)]]
                    sizes = sizes[~held]
                    ends = np.cumsum(sizes)
                    for i, j in K.row_chunks(np.append(0, ends), 300_000):  # tokens at a time
                        lo = ends[i] - sizes[i]
                        got = expected(classes[lo : ends[j - 1]], sizes[i:j], start, moves, emits)
                        total += got[0]
                        sums = got[1:] if sums is None else tuple(x + y for x, y in zip(sums, got[1:]))
            if sums is not None:
                flat = np.concatenate([[total], *(x.ravel() for x in sums)])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["place", "value"])

        counts = corpus.select("held", "n_tokens", "codes", "words").mapInArrow(K.tidy(run), "place long, value double")
        flat = np.zeros(1 + s.states * (1 + s.states + s.classes))
        for r in counts.groupBy("place").agg(F.sum("value").alias("value")).collect():  # as many rows as the model has numbers
            flat[r.place] = r.value
        history.append(float(flat[0]))
        k = s.states
        begins, steps, seen = flat[1 : 1 + k], flat[1 + k : 1 + k + k * k].reshape(k, k), flat[1 + k + k * k :].reshape(k, -1)
        if seen.sum():
            start = (begins + 1) / (begins + 1).sum()
            moves = (steps + 1) / (steps + 1).sum(1, keepdims=True)
            seen = seen + s.prior * unigram
            emits = seen / seen.sum(1, keepdims=True)
    tokens = int(class_tokens.sum())
    return Model(start, moves, emits, tokens, int(class_distinct.sum()), class_tokens, class_distinct, discount, tuple(h / max(tokens, 1) for h in history))


def word_logs(model: Model, classes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """log10 P(word | class) for words with their training counts (zero: unknown)."""
    n, v, d = model.class_tokens[classes], model.class_distinct[classes], model.discount
    with np.errstate(divide="ignore", invalid="ignore"):
        share = np.where(counts > 0, (counts - d) / n, d * v / n)
    share = np.where(n > 0, share, 1.0)
    share = np.where(classes == len(model.class_tokens) - 1, 1.0, share)
    return np.log10(share)


def scored(corpus: DataFrame, vocab: DataFrame, model: Model, id_col: str, s: Settings = Settings()) -> DataFrame:
    """id_col, held_out and SCORES of every text."""
    shipped = corpus.sparkSession.sparkContext.broadcast(model)
    own = corpus.select(F.col("batch").alias("of"), F.posexplode("words").alias("place", "word"))
    known = own.join(vocab, "word").select("of", "place", "c")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        model = shipped.value
        out = []
        table = np.ascontiguousarray(model.emits.T)
        left, right = left.combine_chunks(), right.combine_chunks()
        for batch in left.to_batches():
            for row, (held, sizes, codes, words) in enumerate(_batches(batch)):
                counts = np.zeros(len(words), np.int64)
                if right.num_rows:
                    counts[right.column("place").to_numpy()] = right.column("c").to_numpy()
                classes = class_of(words, s)
                base, own_logs = np.log10((counts + 1.0) / (model.tokens + model.distinct + 1.0)), word_logs(model, classes, counts)
                at = np.cumsum(sizes) - sizes
                likelihood = np.zeros(len(sizes))
                for i, j in K.row_chunks(np.append(at, len(codes)), 300_000):
                    lo, hi = at[i], at[j - 1] + sizes[j - 1]
                    blocks = Blocks(sizes[i:j])
                    m, logs = transfers(blocks, table[classes[codes[lo:hi]]], model.moves)
                    likelihood[i:j] = forward(blocks, m, logs, model.start, j - i)[0]
                out.append(
                    pa.table(
                        {
                            id_col: batch.column(batch.schema.get_field_index("ids"))[row].values,
                            "held_out": pa.array(held),
                            "n_tokens": pa.array(sizes),
                            "n_known": pa.array(np.add.reduceat((counts > 0)[codes].astype(np.int64), at)),
                            "train_tokens": pa.array(np.full(len(sizes), model.tokens, np.int64)),
                            "base_score": pa.array(np.add.reduceat(base[codes], at)),
                            "score": pa.array(np.add.reduceat(own_logs[codes], at) + likelihood / np.log(10)),
                        }
                    )
                )
        return pa.concat_tables(out) if out else pa.table({id_col: pa.array([], pa.int64()), "held_out": pa.array([], pa.bool_()), **{c: pa.array([], pa.int64()) for c in ("n_tokens", "n_known", "train_tokens")}, "base_score": pa.array([], pa.float64()), "score": pa.array([], pa.float64())})

    # a task holds few batches, however many there are
    tasks = max(int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * corpus.count())
    left, right = corpus.drop("counts").repartition(tasks, "batch"), known.repartition(tasks, "of")
    return left.groupBy("batch").cogroup(right.groupBy("of")).applyInArrow(run, f"`{id_col}` long, held_out boolean, {SCORES}")


def hmm_scores(docs: DataFrame, held_out, id_col: str = "doc_id", text: str = "text", s: Settings = Settings()) -> DataFrame:
    """Trains on the rows that are not held out and scores all."""
    corpus = coded(docs, held_out, id_col, text, s)
    vocab = vocabulary(corpus)
    return scored(corpus, vocab, train(corpus, vocab, s), id_col, s)
