"""SentencePiece encoding (merge type) by backtracking, and decoding.

The model's pieces and scores are read from a file; a better score merges first.
A text is cut where no piece can reach across: before a word mark that follows
something else.  Each such chunk is encoded exactly:

* an Aho-Corasick automaton over the reversed pieces gives, for every position,
  the longest piece that starts there;
* pieces are laid one after another, the longest first.  Two neighbours are
  compatible if merging their joint text again would not cross the boundary;
  this is found by undoing the merges of both, the latest first;
* where nothing fits, the position is marked in a bit field of failed positions
  and the last piece is replaced by its next shorter prefix.

Characters without a piece become bytes.  Pieces of word marks alone share the
last score, so they merge after all others, the leftmost pair first: the word
that ends a run of marks is encoded on its own, and the marks left before it are
merged from the left over a stack.  A model in which other pieces share a score,
or reach across words, has no such order and is refused.

Cases: a null or empty text encodes to the end id alone and decodes to an empty
text; repeated rows have a result each; an empty table gives an empty result;
columns kept beside the result may have any name but the result's own; a very
long text, or a very long chunk without spaces, costs memory in proportion to its
length.  Equal chunks are encoded once per worker while they stay in a memory
bounded in bytes; long chunks are not remembered.
"""

from __future__ import annotations

import hashlib
import re
from array import array

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import kernels as K

MARK = "▁"
#: Bytes in each of the two generations of chunks that a worker remembers; more save time where words repeat.
MEMO_BYTES = 32 << 20
#: Characters of the longest chunk that is remembered, and what an entry takes besides its text and ids.
MEMO_LONGEST, MEMO_ENTRY = 64, 250


class Bpe:
    """An encoder and decoder for one merge-type model."""

    def __init__(self, model: bytes):
        import ahocorasick
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = library.get_piece_size()
        self.texts = [library.id_to_piece(i) for i in range(n)]
        self.eos = library.eos_id()
        self.unknown = library.unk_id()
        self.bytes = [0] * 256
        self.kinds = ["byte" if library.is_byte(i) else "control" if library.is_control(i) else "unknown" if library.is_unknown(i) else "piece" for i in range(n)]
        for i in range(n):
            if self.kinds[i] == "byte":
                self.bytes[int(self.texts[i][3:5], 16)] = i
        pieces = [i for i in range(n) if self.kinds[i] == "piece" and not library.is_unused(i)]
        self.ids = {self.texts[i]: i for i in pieces}
        scores = sorted({library.get_score(i) for i in pieces}, reverse=True)
        place = {s: k for k, s in enumerate(scores)}
        self.rank = {i: place[library.get_score(i)] for i in pieces}
        shared: dict[int, list[int]] = {}
        for i in pieces:
            if len(self.texts[i]) > 1:
                shared.setdefault(self.rank[i], []).append(i)
        marks = [self.rank[i] for i in pieces if not self.texts[i].strip(MARK) and len(self.texts[i]) > 1]
        if any(self.texts[i].strip(MARK) for k in shared.values() if len(k) > 1 for i in k) or marks and min(marks) < max(self.rank[i] for i in pieces):
            raise ValueError("the model's pieces have no order: other pieces than runs of word marks share a score")
        if any(MARK in t.lstrip(MARK) or t.startswith(MARK * 2) and t.strip(MARK) for t in self.ids):
            raise ValueError("the model's pieces reach across words")
        #: A line feed has no piece, so that no merge reaches across it.
        self.cuts_lines = not any("\n" in t for t in self.ids)
        #: Pairs of characters that stand side by side in a piece: no merge reaches across any other.
        self.reached = {t[i : i + 2] for t in self.ids for i in range(len(t) - 1)}
        self.pairs: dict[int, bool] = {}
        self.halves: dict[int, tuple[int, int] | None] = {}
        for i in sorted(pieces, key=lambda i: (len(self.texts[i]) > 1, self.rank[i])):
            self._split(i)
        self.automaton = ahocorasick.Automaton()
        for i in self.halves:  # pieces that merging can make
            self.automaton.add_word(self.texts[i][::-1], i)
        self.automaton.make_automaton()
        self.lengths = [len(t) for t in self.texts]
        self.shorter = [self._prefix(t) for t in self.texts]
        self.spaced = [f" {i}" for i in range(n)]
        self.plain = {str(i): self.texts[i].replace(MARK, " ") for i in pieces} | {str(i): chr(c) for c, i in enumerate(self.bytes[:128])} | {str(self.eos): ""}
        self.memo, self.memo_bytes = _Memo(self.encode_chunk), MEMO_BYTES

    def _split(self, i: int) -> None:
        """The last merge that makes the piece, None for one character; a piece that no merge makes is left out."""
        t = self.texts[i]
        if len(t) == 1:
            self.halves[i] = None
            return
        if t.startswith(MARK * 2):
            return
        for k in range(len(t) - 1, 0, -1):
            a, b = self.ids.get(t[:k]), self.ids.get(t[k:])
            if a in self.halves and b in self.halves and self.compatible(a, b, self.rank[i]):
                self.halves[i] = (a, b)
                return

    def compatible(self, a: int, b: int, limit: int | None = None) -> bool:
        """Whether merging the two pieces' text again keeps the boundary, up to the rank `limit`.

        The piece merged last is undone first.  What touches the boundary then
        exists until that merge; if the two touching parts would merge earlier,
        the boundary goes.  On equal ranks the left merge comes first.
        """
        rank, halves, ids, texts = self.rank, self.halves, self.ids, self.texts
        end, left_first = (limit, False) if limit is not None else (len(rank) + 1, False)
        x, y = a, b
        while True:
            joint = ids.get(texts[x] + texts[y])
            if joint is not None and joint in rank and (rank[joint] < end or left_first and rank[joint] == end):
                return False
            hx, hy = halves[x], halves[y]
            if hx is None and hy is None:
                return True
            if hy is None or hx is not None and rank[x] > rank[y]:
                end, x, left_first = rank[x], hx[1], False
            else:
                end, y, left_first = rank[y], hy[0], True

    def _prefix(self, t: str) -> int:
        """The longest proper prefix that is a piece, or -1."""
        return next((self.ids[t[:k]] for k in range(len(t) - 1, 0, -1) if self.ids.get(t[:k]) in self.halves), -1)

    def encode_chunk(self, chunk: str) -> str:
        """The ids of one chunk, each after a space; a chunk without a word mark is a word after one space, or begins a line."""
        end = len(chunk)
        while end > 1 and chunk[end - 2 : end] not in self.reached:  # last characters that no piece joins to those before
            end -= 1
        if 1 < end < len(chunk):
            tail = [i for c in chunk[end:] for i in ([self.ids[c]] if c in self.ids else [self.bytes[x] for x in c.encode()])]
            return self.memo[chunk[:end]] + "".join([self.spaced[i] for i in tail])
        if MARK not in chunk and not chunk.startswith("\n"):
            chunk = MARK + chunk
        marks = len(chunk) - len(chunk.lstrip(MARK))
        if marks > 1:
            ids = self.backtracked(chunk[marks - 1 :])
            alone = self.texts[ids[0]] == MARK
            ids = self.run_of_marks(marks - 1 + alone) + ids[alone:]
        else:
            ids = self.backtracked(chunk)
        spaced = self.spaced
        return "".join([spaced[i] for i in ids])

    def run_of_marks(self, n: int) -> list[int]:
        """The pieces of n word marks: of all pairs that merge, always the leftmost."""
        out: list[int] = []
        for _ in range(n):
            out.append(1)
            while len(out) > 1 and MARK * (out[-2] + out[-1]) in self.ids:
                out[-2:] = [out[-2] + out[-1]]
        return [self.ids[MARK * k] for k in out]

    def backtracked(self, chunk: str) -> list[int]:
        n = len(chunk)
        matches = self.automaton.iter(chunk[::-1])
        longest: dict[int, int] | array
        if n <= 4096:
            # by end in the reversed chunk; longer matches come first, so they are written last
            longest = dict(reversed(list(matches)))
            if len(longest) == n:
                return self._stretch(longest, n, 0, n)
            longest = array("i", [longest.get(i, -1) for i in range(n)])
        else:
            longest = array("i", [-1]) * n
            for end, piece in matches:
                if longest[end] < 0:
                    longest[end] = piece
        out: list[int] = []
        at = 0
        while at < n:  # stretches between characters without a piece
            if longest[n - 1 - at] < 0:
                out += [self.bytes[c] for c in chunk[at].encode()]
                at += 1
                continue
            to = at
            while to < n and longest[n - 1 - to] >= 0:
                to += 1
            out += self._stretch(longest, n, at, to)
            at = to
        return out

    def _stretch(self, longest: dict[int, int] | array, n: int, start: int, end: int) -> list[int]:
        lengths, pairs, shorter = self.lengths, self.pairs, self.shorter
        out: list[int] = []
        failed = bytearray((end - start >> 3) + 1)  # bit i: no way on from start + i
        at, last, piece = start, -1, longest[n - 1 - start]
        while True:
            to = at + lengths[piece]
            if not failed[to - start >> 3] >> (to - start & 7) & 1:
                if last < 0:
                    fits = True
                else:
                    key = last << 20 | piece
                    fits = pairs.get(key)
                    if fits is None:
                        fits = pairs[key] = self.compatible(last, piece)
                if fits:
                    out.append(piece)
                    if to == end:
                        return out
                    at, last, piece = to, piece, longest[n - 1 - to]
                    continue
            piece = shorter[piece]
            while piece < 0:
                failed[at - start >> 3] |= 1 << (at - start & 7)
                piece = out.pop()
                at -= lengths[piece]
                last = out[-1] if out else -1
                piece = shorter[piece]

    def parts(self, text: str) -> list[str]:
        """The ids of each chunk of a text, each id after a space; without the end id."""
        if not text:
            return []
        self.trim()
        memo = self.memo.__getitem__
        if MARK not in text and "  " not in text and text[0] not in " \n" and text[-1] != " " and " \n" not in text:
            if self.cuts_lines:
                text = text.replace("\n", " \n")
            return [memo(w) for w in text.split(" ")]
        return [memo(c) for c in re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", MARK + text.replace(" ", MARK))]

    def trim(self) -> None:
        """Drops the older generation of what is remembered once the younger is full."""
        self.memo.turn(self.memo_bytes)
        if len(self.pairs) > 300_000:
            self.pairs.clear()

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in "".join(self.parts(text)).split()] + [self.eos]

    def decode(self, ids: list[str]) -> str:
        """The text of ids given as decimal strings; the mark before the first word goes."""
        plain = self.plain
        try:
            text = "".join([plain[i] for i in ids])
        except KeyError:  # bytes of longer characters, control ids
            text = self._decode_bytes(ids)
        return text[1:] if text.startswith(" ") else text

    def _decode_bytes(self, ids: list[str]) -> str:
        out: list[str] = []
        pending = bytearray()

        def flush() -> None:
            at = 0
            while at < len(pending):
                for width in (1, 2, 3, 4):
                    try:
                        out.append(pending[at : at + width].decode())
                        at += width
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    at += 1
            pending.clear()

        for i in map(int, ids):
            kind = self.kinds[i]
            if kind == "byte":
                pending.append(int(self.texts[i][3:5], 16))
                continue
            flush()
            if kind == "piece":
                out.append(self.texts[i].replace(MARK, " "))
            elif kind == "unknown":
                out.append(" ⁇ ")
        flush()
        return "".join(out)


class _Memo(dict):
    """Results by chunk, in two generations: what is asked for again moves to the younger, so that frequent chunks stay."""

    def __init__(self, make):
        super().__init__()
        self.make, self.older, self.size = make, {}, 0

    def __missing__(self, key):
        if len(key) > MEMO_LONGEST:
            return self.make(key)
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        self.size += MEMO_ENTRY + 4 * len(key) + len(value)
        return value

    def turn(self, limit: int) -> None:
        if self.size > limit:
            self.older = dict(self)
            self.clear()
            self.size = 0


_models: dict[str, Bpe] = {}


def loaded(model: bytes) -> Bpe:
    """The worker's encoder for a model, made once."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _models:
        _models[key] = Bpe(model)
    return _models[key]


def _rows(batch: pa.RecordBatch, text: str, rows: int = 512):
    """The batch's texts, a few at a time; nulls as empty."""
    column = pc.fill_null(batch.column(text), "")
    for at in range(0, len(column), rows):
        yield at, column.slice(at, rows).to_pylist()


def _declared(docs: DataFrame, keep: list[str]) -> str:
    kinds = dict(docs.dtypes)
    return "".join(f"`{c}` {kinds[c]}, " for c in keep)


def digests(docs: DataFrame, model: bytes, keep: list[str], text: str = "text", memo_bytes: int = MEMO_BYTES) -> DataFrame:
    """keep, n_tokens, ids_sha256 and decoded_sha256 of each row: encoded with an end id, then decoded from the ids."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # one file of a fixed size

    def run(batches):
        bpe = loaded(shipped.value)
        bpe.memo_bytes = memo_bytes
        for batch in batches:
            for at, texts in _rows(batch, text):
                n, coded, decoded = [], [], []
                for t in texts:
                    parts = bpe.parts(t)
                    ids = f"{''.join(parts)} {bpe.eos}"
                    n.append(ids.count(" "))
                    coded.append(hashlib.sha256(ids[1:].encode()).hexdigest())
                    decoded.append(hashlib.sha256(bpe.decode(ids.split()).encode()).hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(at, len(texts)) for c in keep] + [pa.array(n, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], names=[*keep, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(K.tidy(run), _declared(docs, keep) + "n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, model: bytes, keep: list[str], text: str = "text", out: str = "token_ids") -> DataFrame:
    """keep and the ids of each row, the end id last."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        bpe = loaded(shipped.value)
        for batch in batches:
            for at, texts in _rows(batch, text):
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(at, len(texts)) for c in keep] + [pa.array([bpe.encode(t) for t in texts], pa.list_(pa.int32()))], names=[*keep, out])
    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(K.tidy(run), _declared(docs, keep) + f"`{out}` array<int>")


def decode(tokens: DataFrame, model: bytes, keep: list[str], ids: str = "token_ids", out: str = "text") -> DataFrame:
    """keep and the text of each row's ids; null ids give an empty text."""
    shipped = tokens.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        bpe = loaded(shipped.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array([bpe.decode([str(i) for i in x or []]) for x in batch.column(ids).to_pylist()], pa.string())], names=[*keep, out])

    return tokens.select(*keep, ids).mapInArrow(K.tidy(run), _declared(tokens, keep) + f"`{out}` string")
