"""Quality rules by repetition coverage.

For several n-gram lengths, rolling hashes of all n-grams of a text are sorted
and the characters inside n-grams that occur twice or more are measured; the
same is done for lines.  A text whose repeated share is too large is rejected,
and so are very short texts and texts full of symbols.

Cases: a null or empty text has no words, zero counts and is rejected (too few
words); repeated rows are judged one by one; a very long text is one row of one
batch and costs memory in proportion to its own length; an empty table gives an
empty result; other columns of the input, whatever their names, pass through
`filtered` untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import kernels as K

MEASURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, dup_line_chars long, dup_ngram_chars array<long>, kept boolean"
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


@dataclass(frozen=True)
class Rules:
    min_words: int = 10
    #: Per cent of words that may stand in repeated windows of five words.
    repeat_words_percent: int = 20
    #: (n, per cent of word characters that may stand in repeated n-grams of n words).
    ngrams: tuple = ((5, 20), (7, 18), (10, 15))
    #: Per cent of word characters that may stand in lines equal to an earlier line.
    line_chars_percent: int = 20
    #: Symbols per hundred words.
    symbols_percent: int = 10


def measure(data: np.ndarray, offsets: np.ndarray, rules: Rules = Rules()) -> dict[str, np.ndarray]:
    """The measures of every row of a text buffer."""
    n = len(offsets) - 1
    starts, ends, rows = K.word_spans(data, offsets)
    n_words = np.bincount(rows, minlength=n)
    chars = ((data & 0xC0) != 0x80) & ~K.SPACE[data]
    upto = np.zeros(len(data) + 1, np.int64)
    np.cumsum(chars, out=upto[1:])
    lengths = upto[ends] - upto[starts]
    word_chars = upto[offsets[1:]] - upto[offsets[:-1]]
    n_symbols = K.per_row(SYMBOLS[data], offsets)

    ls, le, lr = K.line_spans(data, offsets)
    inked = upto[le] > upto[ls]
    ls, le, lr = ls[inked], le[inked], lr[inked]
    again = K.seen_before(K.with_row(K.spans_hash(data, ls, le), lr))
    n_dup_lines = np.bincount(lr[again], minlength=n)
    line_chars = np.bincount(lr[again], (upto[le] - upto[ls])[again], n).astype(np.int64)

    words = K.spans_hash(data, starts, ends)

    def inside(width: int) -> np.ndarray:
        keys, valid = K.ngram_hash(words, rows, width)
        windows = np.zeros(len(keys), bool)
        windows[valid] = K.repeated(K.with_row(keys[valid], rows[: len(keys)][valid]))
        return K.covered(windows, width, len(words))

    in_five = inside(5)
    n_repeat = np.bincount(rows[in_five], minlength=n)
    shares = []
    for width, _ in rules.ngrams:
        mask = in_five if width == 5 else inside(width)
        shares.append(np.bincount(rows[mask], lengths[mask], n).astype(np.int64))
    failed = (n_words < rules.min_words) | (100 * n_repeat > rules.repeat_words_percent * n_words)
    kept = ~failed & (100 * line_chars <= rules.line_chars_percent * word_chars) & (100 * n_symbols <= rules.symbols_percent * n_words)
    for (_, percent), share in zip(rules.ngrams, shares):
        kept &= 100 * share <= percent * word_chars
    return {"n_words": n_words, "word_chars": word_chars, "n_symbols": n_symbols, "n_dup_lines": n_dup_lines, "n_repeat_words": n_repeat, "base_failed": failed, "dup_line_chars": line_chars, "dup_ngram_chars": np.stack(shares, 1) if shares else np.zeros((n, 0), np.int64), "kept": kept}


def _chunks(batch: pa.RecordBatch, text: str, rules: Rules):
    data, offsets = K.text_buffers(batch.column(text))
    for i, j in K.row_chunks(offsets):
        part = offsets[i : j + 1]
        yield i, j, measure(data[part[0] : part[-1]], part - part[0], rules)


def quality(docs: DataFrame, keep: list[str], text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The columns `keep` and MEASURES of each row; one pass, no shuffle."""
    others = [c for c in keep if c != text]

    def run(batches):
        for batch in batches:
            for i, j, m in _chunks(batch, text, rules):
                made = []
                for name, values in m.items():
                    if name == "dup_ngram_chars":
                        width = values.shape[1]
                        made.append(pa.ListArray.from_arrays(pa.array(np.arange(0, (j - i) * width + 1, max(width, 1), dtype=np.int32) if width else np.zeros(j - i + 1, np.int32)), pa.array(values.ravel())))
                    else:
                        made.append(pa.array(values))
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(i, j - i) for c in keep] + made, names=keep + list(m))

    kept = docs.select(*others, text)
    return kept.mapInArrow(K.tidy(run), f"{', '.join(f'`{c}` {dict(kept.dtypes)[c]}' for c in keep)}{', ' if keep else ''}{MEASURES}")


def filtered(docs: DataFrame, text: str = "text", rules: Rules = Rules()) -> DataFrame:
    """The rows that the rules keep, with the input's columns."""

    def run(batches):
        for batch in batches:
            masks = [m["kept"] for _, _, m in _chunks(batch, text, rules)]
            if masks:
                yield batch.filter(pa.array(np.concatenate(masks)))

    return docs.mapInArrow(K.tidy(run), docs.schema)


def oracle(rules: Rules = Rules()) -> str:
    """The result of quality(documents, ["doc_id"]) in DuckDB's SQL, with a column for each n-gram length."""
    widths = sorted({5, *(n for n, _ in rules.ngrams)})
    grams = ", ".join(f"CASE WHEN i + {n - 1} <= n THEN array_to_string(list_slice(ws, i, i + {n - 1}), ' ') END AS g{n}" for n in widths)
    again = ", ".join(f"g{n} IS NOT NULL AND count(g{n}) OVER (PARTITION BY r, g{n}) > 1 AS d{n}" for n in widths)
    inside = ", ".join(f"max(d{n}) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) AS c{n}" for n in widths)
    chars = ", ".join(f"coalesce(CAST(sum(length(word)) FILTER (c{n}) AS BIGINT), 0)" for n, _ in rules.ngrams)
    kept = " AND ".join(f"100 * coalesce(shares[{k + 1}], 0) <= {percent} * word_chars" for k, (_, percent) in enumerate(rules.ngrams))
    shown = ", ".join(f"shares[{k + 1}] AS dup_{n}gram_chars" for k, (n, _) in enumerate(rules.ngrams))
    none = ", ".join("CAST(0 AS BIGINT)" for _ in rules.ngrams)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT r, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
w AS (SELECT r, ws, len(ws) AS n, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM s),
g AS (SELECT r, i, word, {grams} FROM w),
a AS (SELECT r, i, word, {again} FROM g),
c AS (SELECT r, word, {inside} FROM a),
m AS (SELECT r, CAST(count(*) AS BIGINT) AS n_words, CAST(sum(length(word)) AS BIGINT) AS word_chars, count(*) FILTER (c5) AS n_repeat_words, [{chars}] AS shares FROM c GROUP BY r),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM s),
k AS (SELECT r, length(regexp_replace(line, '[\\x20\\x09-\\x0D]', '', 'g')) AS size, row_number() OVER (PARTITION BY r, line ORDER BY i) AS nth FROM l),
b AS (SELECT r, count(*) FILTER (size > 0 AND nth > 1) AS n_dup_lines, CAST(coalesce(sum(size) FILTER (nth > 1), 0) AS BIGINT) AS dup_line_chars FROM k GROUP BY r),
f AS (
  SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, CAST(length(regexp_replace(d.t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         coalesce(n_words, 0) < {rules.min_words} OR 100 * n_repeat_words > {rules.repeat_words_percent} * n_words AS base_failed, dup_line_chars, coalesce(shares, [{none}]) AS shares
  FROM d JOIN b USING (r) LEFT JOIN m USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, dup_line_chars, {shown},
       NOT base_failed AND 100 * dup_line_chars <= {rules.line_chars_percent} * word_chars AND 100 * n_symbols <= {rules.symbols_percent} * n_words AND {kept} AS kept
FROM f
"""
