"""Entity extraction from notes: sentences, phases, lexicons, negation and hedging, measurements, spans.

Vocabularies, headers and patterns are parameters: a caller brings its own.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearth.functions.strings import collapse_spaces


def normalised(docs: DataFrame, text: str = "text") -> DataFrame:
    """White space collapsed once, so that all later offsets refer to one text; null as empty."""
    return docs.withColumn(text, collapse_spaces(F.coalesce(F.col(text), F.lit(""))))


def sentences(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, sentence_no, sentence): split at a space after . ! or ? and before an upper-case letter A to Z."""
    parts = F.split(collapse_spaces(F.coalesce(F.col(text), F.lit(""))), r"(?<=[.!?]) (?=[A-Z])")
    return docs.select(F.col(id_col), F.posexplode(parts).alias("sentence_no", "sentence")).where("sentence <> ''")


def phased(rows: DataFrame, id_col: str, headers: list[tuple[str, str]], topics: list[tuple[str, str]], default: str = "UNKNOWN", opening: str | None = None) -> DataFrame:
    """phase and confidence of each sentence: a header (.95), else a topic (.65), else the phase before it (.40).

    Patterns are tried in order on the lower-cased sentence.  With `opening`, a
    first sentence without header or topic gets that phase at .55.
    """
    low = F.lower("sentence")

    def first_of(rules: list[tuple[str, str]]) -> Column:
        out = F.lit(None).cast("string")
        for pattern, phase in reversed(rules):
            out = F.when(low.rlike(pattern), phase).otherwise(out)
        return out

    marked = rows.withColumn("_h", first_of(headers)).withColumn("_t", first_of(topics))
    own = F.coalesce("_h", "_t")
    first = F.col("sentence_no") == 0
    if opening:
        own = F.coalesce(own, F.when(first, opening))
    w = Window.partitionBy(id_col).orderBy("sentence_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = marked.withColumn("_own", own).withColumn("phase", F.coalesce(F.last("_own", ignorenulls=True).over(w), F.lit(default)))
    confidence = F.when(F.col("_h").isNotNull(), 0.95).when(F.col("_t").isNotNull(), 0.65)
    if opening:
        confidence = confidence.when(first, 0.55)
    return marked.withColumn("confidence", confidence.otherwise(0.40)).drop("_h", "_t", "_own")


def by_phase(rows: DataFrame, id_col: str) -> DataFrame:
    """The sentences of each phase of a document, in order (a document's own sentences bound the array)."""
    return rows.groupBy(id_col, "phase").agg(F.sort_array(F.collect_list(F.struct("sentence_no", "sentence"))).alias("s")).select(id_col, "phase", F.col("s.sentence").alias("sentences"))


@dataclass(frozen=True)
class Extraction:
    """What to extract and how."""

    #: kind -> {phrase: code}
    lexicons: dict[str, dict[str, str]] = field(default_factory=dict)
    #: (kind, regular expression, confidence, attributes by group name are kept as JSON)
    patterns: tuple[tuple[str, str, float], ...] = ()
    negations: tuple[str, ...] = ()
    hedges: tuple[str, ...] = ()
    negation_window: int = 5
    hedge_window: int = 6
    #: Kinds that a mode leaves out.
    skip: dict[str, tuple[str, ...]] = field(default_factory=dict)


ENTITY = "kind string, text string, char_start int, char_end int, code string, attributes map<string,string>, negated boolean, uncertain boolean, confidence double"
#: Fixed value: what counts as a token before a cue's entity.
_TOKEN = re.compile(r"\b[\w/]+\b")
_SENTENCE = re.compile(r"(?<=[.!?]) (?=[A-Z])")


class Tokens:
    """The tokens of a text, found once; asks for the last n before a place cost a search."""

    def __init__(self, text: str):
        self.text = text
        self.sentences = [0, *(m.end() for m in _SENTENCE.finditer(text))]
        self.starts, self.ends = [], []
        for m in _TOKEN.finditer(text):
            self.starts.append(m.start())
            self.ends.append(m.end())

    def before(self, at: int, n: int) -> list[str]:
        """The last n lower-cased tokens between the sentence's start and a place; a token that the place cuts counts up to it."""
        first = bisect_left(self.starts, self.sentences[bisect_right(self.sentences, at) - 1])
        last = bisect_right(self.ends, at)
        cut = _TOKEN.findall(self.text[self.starts[last] : at]) if last < len(self.starts) and self.starts[last] < at else []
        found = [self.text[self.starts[k] : self.ends[k]] for k in range(max(first, last - n), last)] + cut
        return [t.lower() for t in found[-n:]]


def _cued(tokens: list[str], cues: tuple[str, ...]) -> bool:
    """Whether a cue stands among tokens: one word as a token, several as part of the joined window."""
    joined = " ".join(tokens)
    return any(c in joined if " " in c else c in tokens for c in cues)


def _lower(text: str) -> str:
    """Lower case that keeps every character's place."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


class Finder:
    """All phrases of a lexicon in one pass; among overlapping ones the longest wins, whichever comes first."""

    def __init__(self, lexicon: dict[str, str]):
        import ahocorasick

        self.codes = {_lower(p): (p, code) for p, code in lexicon.items()}
        self.automaton = ahocorasick.Automaton()
        for phrase in self.codes:
            self.automaton.add_word(phrase, phrase)
        self.automaton.make_automaton()

    def spans(self, low: str) -> list[tuple[int, int, str]]:
        """(start, end, phrase) at word bounds, by start."""

        def word(i: int) -> bool:
            return 0 <= i < len(low) and (low[i].isalnum() or low[i] == "_")

        def bound(i: int) -> bool:
            return word(i - 1) != word(i)

        met = [(e + 1 - len(p), e + 1, p) for e, p in self.automaton.iter(low)] if self.codes else []
        taken: list[tuple[int, int, str]] = []
        for m in sorted((m for m in met if bound(m[0]) and bound(m[1])), key=lambda m: (m[0] - m[1], self.codes[m[2]][0], m[0])):
            k = bisect_right(taken, (m[0], len(low) + 1, ""))  # the spans on both sides of the start
            if not (k and m[0] < taken[k - 1][1] or k < len(taken) and taken[k][0] < m[1] <= taken[k][1]):
                taken.insert(k, m)
        return taken


_finders: dict[tuple, Finder] = {}
_patterns: dict[str, re.Pattern] = {}


def _finder(lexicon: dict[str, str]) -> Finder:
    key = tuple(lexicon.items())
    if key not in _finders:
        _finders[key] = Finder(lexicon)
    return _finders[key]


def _pattern(source: str) -> re.Pattern:
    if source not in _patterns:
        _patterns[source] = re.compile(source, re.I)
    return _patterns[source]


def extract_text(text: str, how: Extraction, mode: str = "default") -> list[dict]:
    """The entities of one normalised text, by start (lexicons before patterns at the same place)."""
    left_out, window = how.skip.get(mode, ()), Tokens(text)
    met: list[tuple] = []
    low = _lower(text) if how.lexicons else ""
    for kind, lexicon in how.lexicons.items():
        if kind not in left_out:
            finder = _finder(lexicon)
            met += [(start, end, kind, finder.codes[p][1], {}, 0.88 if len(p) > 6 else 0.78) for start, end, p in finder.spans(low)]
    for kind, pattern, confidence in how.patterns:
        if kind not in left_out:
            met += [(*m.span(), kind, None, {k: v for k, v in m.groupdict().items() if v is not None}, confidence) for m in _pattern(pattern).finditer(text)]
    reach, found = max(how.negation_window, how.hedge_window), []
    for start, end, kind, code, attributes, confidence in sorted(met, key=lambda m: m[0]):
        tokens = window.before(start, reach)
        found.append({"kind": kind, "text": text[start:end], "char_start": start, "char_end": end, "code": code, "attributes": attributes, "negated": _cued(tokens[-how.negation_window :], how.negations), "uncertain": _cued(tokens[-how.hedge_window :], how.hedges), "confidence": confidence})
    return found


def entities(docs: DataFrame, how: Extraction, id_col: str = "doc_id", text: str = "text", mode: str = "default") -> DataFrame:
    """One row for each entity of each document; automata and patterns are made once in a worker."""
    columns = [c.split()[0] for c in ENTITY.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()), pa.bool_(), pa.bool_(), pa.float64()]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [(k, e) for k, t in enumerate(part.column(1).to_pylist()) for e in extract_text(t, how, mode)]
                if found:
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array([k for k, _ in found])), *(pa.array([list(e[c].items()) if c == "attributes" else e[c] for _, e in found], t) for c, t in zip(columns, kinds))], names=["id", *columns])

    kind = dict(docs.dtypes)[id_col]
    return normalised(docs, text).select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {kind}, {ENTITY}").withColumnRenamed("id", id_col)


def phase_of(found: DataFrame, phases: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Entities with the phase of the sentence they start in; phases: id, start, end, phase."""
    on = (found[id_col] == phases[id_col]) & (found["char_start"] >= phases["start"]) & (found["char_start"] < phases["end"])
    return found.join(phases, on, "left").select(*[found[c] for c in found.columns], F.coalesce(phases["phase"], F.lit("UNKNOWN")).alias("phase"))


def keyword_counts(docs: DataFrame, words: dict[str, str], id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """How often each pattern occurs in each document, as columns; one pass in the JVM."""
    return docs.select(id_col, *[F.size(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(p), 0)).cast("long").alias(name) for name, p in words.items()])


def uncontained(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Entities not strictly inside a longer one of the same document, whatever its kind.

    In the order of start (longer first) an entity lies inside an earlier one
    exactly if some earlier end reaches its own; a running maximum decides.
    """
    w = Window.partitionBy(id_col).orderBy("char_start", F.desc("char_end")).rowsBetween(Window.unboundedPreceding, -1)
    outer = F.max(F.struct(F.col("char_end").alias("e"), (-F.col("char_start")).alias("s"))).over(w)
    longer = (outer["e"] > F.col("char_end")) | ((outer["e"] == F.col("char_end")) & (-outer["s"] < F.col("char_start")))
    return found.withColumn("_in", F.coalesce(longer, F.lit(False))).where("NOT _in").drop("_in")


def not_overlapping(spans: list[tuple[int, int]]) -> list[int]:
    """Places of the spans kept when taken by start, the longer first, without overlap."""
    kept, end = [], -1
    for i in sorted(range(len(spans)), key=lambda i: (spans[i][0], -spans[i][1])):
        if spans[i][0] >= end:
            kept.append(i)
            end = spans[i][1]
    return kept


def routed(rows: DataFrame, species: Column, adapters: dict[str, str], default: str) -> DataFrame:
    """The prompt prefix and adapter that a model backend would use for a species (no model is called)."""
    table = F.create_map(*[F.lit(x) for pair in adapters.items() for x in pair])
    return rows.withColumn("prefix", F.concat(F.lit("["), F.upper(species), F.lit("]"))).withColumn("adapter", F.coalesce(table[species], F.lit(default)))


def handed_back(found: DataFrame, decisions: DataFrame, threshold: float = 0.75, id_col: str = "doc_id") -> DataFrame:
    """Entities below the threshold with a reviewer's decision, or pending."""
    on = [id_col, "char_start", "char_end", "kind"]
    return found.where(F.col("confidence") < threshold).join(decisions.select(*on, "decision"), on, "left").withColumn("decision", F.coalesce("decision", F.lit("pending")))


def annotate(text: str, lexicons: dict[str, dict[str, str]], negations: tuple[str, ...], hedges: tuple[str, ...], negation_chars: int = 30, hedge_chars: int = 50) -> list[dict]:
    """A simple gold annotation to score extractors against: longest phrases first, at bounds of letters and digits, cues within so many characters before."""
    low, taken, found = text.lower(), [], []
    for phrase, kind, code in sorted(((p, k, c) for k, lex in lexicons.items() for p, c in lex.items()), key=lambda x: (-len(x[0]), x)):
        at = low.find(phrase.lower())
        while at >= 0:
            end = at + len(phrase)
            bounded = (at == 0 or not low[at - 1].isalnum()) and (end == len(low) or not low[end].isalnum())
            if bounded and not any(a < end and at < b for a, b in taken):
                taken.append((at, end))
                found.append({"kind": kind, "code": code, "char_start": at, "char_end": end, "negated": any(c in low[max(0, at - negation_chars) : at] for c in negations), "uncertain": any(c in low[max(0, at - hedge_chars) : at] for c in hedges)})
            at = low.find(phrase.lower(), at + 1)
    return sorted(found, key=lambda e: (e["char_start"], -e["char_end"]))


def gold(docs: DataFrame, lexicons: dict[str, dict[str, str]], negations: tuple[str, ...], hedges: tuple[str, ...], id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """`annotate` over documents."""
    columns = ["kind", "code", "char_start", "char_end", "negated", "uncertain"]

    def run(frames):
        for frame in frames:
            yield pd.DataFrame([(i, *[e[c] for c in columns]) for i, t in zip(frame["id"], frame["text"]) for e in annotate(t, lexicons, negations, hedges)], columns=["id", *columns])

    kind = dict(docs.dtypes)[id_col]
    return normalised(docs, text).select(F.col(id_col).alias("id"), F.col(text).alias("text")).mapInPandas(run, f"id {kind}, kind string, code string, char_start int, char_end int, negated boolean, uncertain boolean").withColumnRenamed("id", id_col)
