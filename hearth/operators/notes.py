"""Typed measurements in notes as column expressions, and lexicons built from terminologies.

All matches of a pattern with their offsets come from two built-in functions: the
matches themselves and the lengths of the text between them.  So vitals, ages,
durations and exposures stay in the JVM and need no Python worker.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearth.operators.text import normalised

# Patterns, units, number words and cues whose results must agree with other systems.
VITALS = [
    ("blood_pressure", r"\bBP\s*[:= ]?\s*(\d{2,3})\s*/\s*(\d{2,3})\b", "mmHg"),
    ("heart_rate", r"\bHR\s*[:= ]?\s*(\d{2,3})\b", "bpm"),
    ("respiratory_rate", r"\bRR\s*[:= ]?\s*(\d{1,3})\b", "/min"),
    ("temperature_f", r"\b(?:T|Temp|Temperature)\s*[:= ]?\s*(\d{2,3}(?:\.\d)?)\s*(?:F|°F)?\b", "F"),
    ("spo2", r"\bSpO2\s*[:= ]?\s*(\d{1,3})\s*%?\b", "%"),
]
WORDED_AGE = r"\b(twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety)[\s-]?(one|two|three|four|five|six|seven|eight|nine)?[\s-]year[\s-]old\b"
AGES = [r"\b(\d{1,3})[ -]year[ -]old\b", r"\b(\d{1,3})\s*y/?o\b", r"\b(\d{1,3})\s*yr\b"]
SEXES = [("male", r"\b(male|man|gentleman|m/|M\b)\b"), ("female", r"\b(female|woman|lady|f/|F\b)\b")]
DURATION = r"\b(?:for|since|times?|x)\s+(\d+|one|two|three|four|five|six|seven|eight|nine|ten)\s+(day|week|month|year)s?\b"
DAYS = {"day": 1, "week": 7, "month": 30, "year": 365}
EXPOSURES = [
    ("tick_exposure", r"\btick(?:s|\sbite|\sexposure|\sattached|\sembedded)?\b"),
    ("rodent_exposure", r"\b(rodent|mouse|mice|rat\b|rat\s)\b"),
    ("dog_exposure", r"\b(dog|canine|puppy)\b"),
    ("cat_exposure", r"\b(cat|feline|kitten)\b"),
    ("soil_dust", r"\b(dust\sstorm|soil\sdust|excavation|dust\sexposure|gardening)\b"),
    ("freshwater", r"\b(canal|pond|lake\sswim|stream|river\sswim|freshwater)\b"),
    ("outdoor_activity", r"\b(hike|hiking|camp|camping|outdoor)\b"),
]
NUMBER_WORDS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90}
NEGATIONS = ("no", "denies", "denied", "not", "without", "absent", "negative for", "free of")
HEDGES = ("possible", "probable", "suspected", "consider", "rule out", "r/o", "differential", "likely", "suggestive of", "consistent with")

SENTENCE_BREAK = r"(?<=[.!?])\s+(?=[A-Z])"
FIELDS = "kind string, name string, said string, char_start int, char_end int, value double, value2 double, unit string, negated boolean, uncertain boolean, confidence double"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def running_sums(values: Column) -> Column:
    """The sums of an array's first, first two, ... numbers, in as many passes as the size has binary digits: each adds what stands 1, 2, 4, ... places before."""
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(values))).cast("int") - 1)

    def add(sums: Column, step: Column) -> Column:
        back = F.pow(F.lit(2), step).cast("int")
        return F.transform(sums, lambda x, i: x + F.when(i >= back, F.get(sums, i - back)).otherwise(0))

    return F.when(F.size(values) < 2, values).otherwise(F.aggregate(steps, values, add))


def matches(text: Column, pattern: str) -> Column:
    """array<struct<said, start, end>> of all matches, in order; offsets count characters from 0."""
    between = F.split(text, pattern, -1)

    def placed(said: Column) -> Column:
        lengths = F.zip_with(said, F.slice(between, 1, F.size(said)), lambda s, gap: F.length(gap) + F.length(s))
        return F.zip_with(said, once(lengths, running_sums), lambda s, end: F.struct(s.alias("said"), (end - F.length(s)).alias("start"), end.alias("end")))

    return once(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda said: F.when(F.size(said) == 0, F.array().cast("array<struct<said:string,start:int,end:int>>")).otherwise(placed(said)))


def cued(text: Column, breaks: Column, start: Column, cues: tuple[str, ...], n: int) -> Column:
    """Whether a cue stands among the n tokens before `start` in its sentence: a word as a token, several as part of the joined window.

    breaks: where sentences after the first begin, in order.
    """
    begin = F.coalesce(F.array_max(F.filter(breaks, lambda b: b <= start)), F.lit(0))
    tokens = F.regexp_extract_all(F.lower(F.substring(text, begin + 1, start - begin)), F.lit(r"(?U)\b[\w/]+\b"), F.lit(0))
    window = F.slice(tokens, F.greatest(F.size(tokens) - n, F.lit(0)) + 1, n)
    words, phrases = [c for c in cues if " " not in c], [c for c in cues if " " in c]
    hit = F.arrays_overlap(window, F.array(*map(F.lit, words))) if words else F.lit(False)
    return reduce(lambda a, p: a | F.array_join(window, " ").contains(p), phrases, hit)


def number(word: Column) -> Column:
    """A number in digits or as a word; null for others."""
    table = F.create_map(*[F.lit(x) for pair in NUMBER_WORDS.items() for x in pair])
    return F.coalesce(word.try_cast("int"), table[F.lower(word)])


def _row(kind: str, name, m: Column, confidence: float, value: Column | None = None, value2: Column | None = None, unit=None, negated: Column | None = None, uncertain: Column | None = None) -> Column:
    def text(x) -> Column:
        return x if isinstance(x, Column) else F.lit(x).cast("string")

    def real(x: Column | None) -> Column:
        return (x if x is not None else F.lit(None)).cast("double")

    no = F.lit(False)
    return F.struct(
        F.lit(kind).alias("kind"), text(name).alias("name"), m["said"].alias("said"), m["start"].alias("char_start"), m["end"].alias("char_end"), real(value).alias("value"), real(value2).alias("value2"), text(unit).alias("unit"),
        (negated if negated is not None else no).alias("negated"), (uncertain if uncertain is not None else no).alias("uncertain"), F.lit(confidence).alias("confidence"),
    )


def vitals(text: Column) -> Column:
    """Blood pressure (two values), rates, temperature and oxygen saturation with their units."""

    def of(name: str, pattern: str, unit: str) -> Column:
        second = (lambda m: F.regexp_extract(m["said"], f"(?iU){pattern}", 2)) if name == "blood_pressure" else (lambda m: None)
        return F.transform(matches(text, f"(?iU){pattern}"), lambda m: _row("Vital", name, m, 0.97, F.regexp_extract(m["said"], f"(?iU){pattern}", 1), second(m), unit))

    return F.concat(*[of(*v) for v in VITALS])


def demographics(text: Column) -> Column:
    """Ages, worded ones first, then each numeric pattern where none before it covers the start; the first male and the first female word."""

    def worded(m: Column) -> Column:
        tens, ones = (number(F.regexp_extract(m["said"], f"(?iU){WORDED_AGE}", g)) for g in (1, 2))
        return _row("Demographic", "age", m, 0.95, tens + F.coalesce(ones, F.lit(0)))

    def more(pattern: str) -> Callable[[Column], Column]:
        def added(before: Column) -> Column:
            def free(e: Column) -> Column:
                return ~F.exists(before, lambda b: (b["char_start"] <= e["char_start"]) & (e["char_start"] < b["char_end"]))

            own = F.transform(matches(text, f"(?iU){pattern}"), lambda m: _row("Demographic", "age", m, 0.97, F.regexp_extract(m["said"], f"(?iU){pattern}", 1)))
            return F.concat(before, F.filter(own, free))

        return added

    def first(sex: str, pattern: str) -> Column:
        return F.transform(F.slice(matches(text, f"(?U){pattern}"), 1, 1), lambda m: _row("Demographic", sex, m, 0.90))

    found = F.transform(matches(text, f"(?iU){WORDED_AGE}"), worded)
    for pattern in AGES:
        found = once(found, more(pattern))
    return F.concat(found, *[first(*s) for s in SEXES])


def durations(text: Column) -> Column:
    """value: how many; value2: about how many days; unit: day, week, month or year."""

    def row(m: Column) -> Column:
        n, unit = number(F.regexp_extract(m["said"], f"(?iU){DURATION}", 1)), F.lower(F.regexp_extract(m["said"], f"(?iU){DURATION}", 2))
        days = F.create_map(*[F.lit(x) for pair in DAYS.items() for x in pair])
        return _row("Duration", "duration", m, 0.85, n, n * days[unit], unit)

    return F.transform(matches(text, f"(?iU){DURATION}"), row)


def exposures(text: Column, breaks: Column, negations: tuple[str, ...] = NEGATIONS, hedges: tuple[str, ...] = HEDGES) -> Column:
    def of(name: str, pattern: str) -> Column:
        return F.transform(matches(text, f"(?iU){pattern}"), lambda m: _row("Exposure", name, m, 0.75, negated=cued(text, breaks, m["start"], negations, 5), uncertain=cued(text, breaks, m["start"], hedges, 6)))

    return F.concat(*[of(*e) for e in EXPOSURES])


def measures(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id and FIELDS: every vital, age, sex, duration and exposure of each normalised text; null texts have none."""
    rows = normalised(docs.select(id_col, text), text).withColumn("_breaks", F.transform(matches(F.col(text), SENTENCE_BREAK), lambda m: m["end"]))
    t = F.col(text)
    return rows.select(id_col, F.inline(F.concat(demographics(t), vitals(t), durations(t), exposures(t, F.col("_breaks")))))


def lexicon(terms: DataFrame, synonyms: DataFrame | None = None, first_word: bool = False) -> DataFrame:
    """(phrase, kind, code, display) from terms (ordinal, kind, code, display) and synonyms (ordinal, kind, surface, canonical).

    A term is known by its lower-cased display; "X (Y)" also by X and by Y, unless
    another term is displayed so; with `first_word` also by its first word.  A
    synonym stands for the first term whose display begins with its canonical
    form, and overrides what the phrase stood for.
    """
    low = F.lower("display")
    parts = [terms.select("kind", low.alias("phrase"), F.struct(F.lit(1).alias("o"), (-F.col("ordinal")).alias("i"), "code", "display").alias("e"))]
    for group in (1, 2):
        alias = F.trim(F.regexp_extract(low, r"^(.+?)\s*\(([^)]+)\)\s*$", group))
        parts.append(terms.select("kind", alias.alias("phrase"), F.struct(F.lit(2).alias("o"), F.col("ordinal").alias("i"), "code", "display").alias("e")).where("phrase <> ''"))
    if first_word:
        parts.append(terms.select("kind", F.split(low, " ")[0].alias("phrase"), F.struct(F.lit(1).alias("o"), (-F.col("ordinal")).alias("i"), "code", "display").alias("e")))
    if synonyms is not None:
        s = synonyms.select(F.col("kind").alias("k"), F.lower("surface").alias("phrase"), F.lower("canonical").alias("canonical"), F.col("ordinal").alias("so"))
        met = terms.join(s, (F.col("kind") == F.col("k")) & low.startswith(F.col("canonical")))
        first = met.groupBy("kind", "phrase", "so").agg(F.min_by(F.struct("code", "display"), "ordinal").alias("t"))
        parts.append(first.select("kind", "phrase", F.struct(F.lit(0).alias("o"), (-F.col("so")).alias("i"), F.col("t.code").alias("code"), F.col("t.display").alias("display")).alias("e")))
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy("kind", "phrase").agg(F.min("e").alias("e")).select("phrase", "kind", "e.code", "e.display")
