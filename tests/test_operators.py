"""Operators on small planted fixtures."""

import datetime as dt

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hearth.functions import dates, numbers, strings
from hearth.functions.similarity import first_name_similarity, jaro, jaro_winkler
from hearth.operators import detect, features, federate, generate, graph, linkage, members, messages, metrics, policy, spans, text, trace


def d(s):
    return dt.date.fromisoformat(s)


def test_clusters_need_both_kinds_and_order_ties(spark):
    cases = spark.createDataFrame([("a", "X", d("2024-01-05"), 1), ("b", "X", d("2024-01-05"), 2), ("c", "X", d("2024-01-09"), 3), ("a", "Y", d("2024-01-01"), 4), ("e", "X", None, 5), ("f", "X", d("2024-01-02"), 6)], "ref string, code string, onset date, case_id long")
    who = spark.createDataFrame([("a", "animal", "1"), ("b", "person", "1"), ("c", "person", "1"), ("e", "person", "2"), ("f", "animal", "2")], "ref string, kind string, group_id string")
    rows = {r.group_id: r for r in graph.cross_kind_clusters(cases, who, ("person", "animal")).collect()}
    assert set(rows) == {"1", "2"} and rows["1"].code == "X"
    assert (rows["1"].index_ref, rows["1"].interval_days, rows["1"].n_first, rows["1"].n_second) == ("b", 0, 2, 1)
    assert rows["2"].index_ref == "e" and rows["2"].interval_days is None
    assert [(r.ref, r.ordinal) for r in graph.secondaries(cases, who, graph.cross_kind_clusters(cases, who, ("person", "animal"))).where("group_id = '1'").orderBy("ordinal").collect()] == [("a", 1), ("c", 2)]
    assert {(r.group_id, r.code, r.ref) for r in graph.at_risk(cases, who).collect()} == {("1", "Y", "b"), ("1", "Y", "c")}


def test_detectors_fire_on_a_spike_and_skip_flat_and_short_series(spark):
    rows = generate.series(spark, 3, 20, spike=(1, 4, 5.2)).withColumn("region", F.col("region").cast("string"))
    flat = spark.createDataFrame([("flat", i, 2.0) for i in range(12)] + [("short", i, float(i)) for i in range(5)], "region string, period int, value double")
    found = {r.region: r for r in detect.vector_anomaly(rows.unionByName(flat), "region", "period", "value").collect()}
    assert found["1"].fired and found["1"].severity == "action" and found["1"].confidence <= 0.99
    assert not found["0"].fired and found["flat"].z is None and found["short"].z is None
    last = {r.region: r for r in detect.sentinel_cases(rows.unionByName(flat), ["region"], "period", "value").collect()}
    assert last["flat"].z is None and last["short"].z is None


def test_trailing_windows_do_not_see_the_day_or_the_future(spark):
    day = dt.date(2024, 6, 1)
    rows = [(i, "g", day - dt.timedelta(days=n)) for i, n in enumerate([0, 0, 1, 30, 31, 90, 91, -3])]
    e = spark.createDataFrame(rows, "id int, g string, day date")
    got = {r.id: (r.n_30d, r.n_90d) for r in features.trailing(e, "g", "day", [30, 90]).collect()}
    assert got[0] == got[1] == (2, 4)
    assert {r.id: (r.n_30d, r.n_90d) for r in features.daily_trailing(e, "g", "day", [30, 90]).collect()} == got


def test_next_event_takes_the_first_on_or_after(spark):
    asks = spark.createDataFrame([("a", d("2024-01-02")), ("b", d("2024-01-02"))], "ref string, at date")
    events = spark.createDataFrame([("a", d("2024-01-02"), 7), ("a", d("2024-01-01"), 6), ("a", d("2024-01-05"), 8)], "ref string, date date, event_id long")
    got = {r.ref: (r.next_id, r.days_until) for r in trace.next_event(asks, events, "ref", "at", "date", "event_id").collect()}
    assert got == {"a": (7, 0), "b": (None, None)}


def test_contacts_and_vector_tier(spark):
    idx = spark.createDataFrame([("i", "1", "a", d("2024-01-02"), "air")], "index_id string, group_id string, ref string, index_date date, route string")
    who = spark.createDataFrame([("a", "p", "1"), ("b", "p", "1"), ("c", "p", "2"), ("e", "p", "3")], "ref string, kind string, group_id string")
    groups = spark.createDataFrame([("1", "r"), ("2", "r"), ("3", "q")], "group_id string, region_id string")
    got = trace.contacts(idx, who, groups, ["air"], include_index=False)
    assert {(r.tier, r.ref) for r in got.collect()} == {(1, "b"), (2, "c")}
    third = trace.vector_contacts(idx, who, groups, got, ["air"], "q", ("2024-01-01", "2024-12-31"))
    assert [(r.tier, r.ref) for r in third.collect()] == [(3, "e")]


@given(st.text(max_size=12), st.text(max_size=12))
def test_jaro_winkler_bounds(a, b):
    assert 0 <= jaro(a, b) <= 1 and 0 <= jaro_winkler(a, b) <= 1 + 1e-12
    assert jaro(a, a) == 1.0


def test_linkage_tiers(spark):
    rows = [("1", "a", "Robert", "Miller", "1980-02-03", "1 Main Street", "85001"), ("2", "b", "Bob", "Miller", "1980-02-03", "1 Main St", "85001"), ("3", "b", "Ann", "Smith", "1990-01-01", "9 Elm", "85001"), ("4", "a", "Robert", "Miller", "1980-02-03", "1 Main Street", "85001"), ("5", "b", "", "", "", "", "")]
    records = spark.createDataFrame(rows, "id string, site_id string, first_name string, last_name string, dob string, address string, zip string")
    links = linkage.tiered(linkage.scored(linkage.similarities(linkage.blocked_pairs(records), {"st": "street"}, {"bob": "robert", "robert": "robert"})))
    got = {(r.left.id, r.right.id): r for r in links.collect()}
    assert got[("1", "2")].tier == "auto" and got[("1", "2")].s_first_name == 0.95 and got[("1", "2")].s_address == 1.0
    assert got[("1", "3")].tier == "none" and ("1", "4") not in got and not any("5" in k for k in got)
    salted = linkage.blocked_pairs(records, salts=3)
    assert {(r.left.id, r.right.id) for r in salted.collect()} == set(got)
    assert linkage.intake_check(records, "Robert", "Miller", "1980-02-03", "main").first().score == 0.99


def test_text_spans_negation_and_hedging(spark):
    how = text.Extraction(lexicons={"condition": {"fever": "C1", "valley fever": "C2"}}, patterns=(("vital", r"\bT (?P<t>\d+(\.\d+)?)", 0.97),), negations=("no", "ruled out"), hedges=("possible",))
    found = text.extract_text("T 100.2 today. No valley fever. Has a possible fever now one two three four five six fever.", how)
    assert [(e["text"], e["negated"], e["uncertain"]) for e in found] == [("T 100.2", False, False), ("valley fever", True, False), ("fever", False, True), ("fever", False, False)]
    docs = spark.createDataFrame([(1, "No  valley\nfever."), (2, None), (3, "")], "doc_id long, text string")
    assert [(r.doc_id, r.text, r.char_start) for r in text.entities(docs, how).collect()] == [(1, "valley fever", 3)]
    inner = spark.createDataFrame([(1, 0, 10), (1, 2, 5), (1, 0, 10), (1, 8, 12)], "doc_id long, char_start int, char_end int")
    assert sorted((r.char_start, r.char_end) for r in text.uncontained(inner).collect()) == [(0, 10), (0, 10), (8, 12)]
    assert text.not_overlapping([(0, 3), (0, 5), (4, 6), (5, 7)]) == [1, 3]


def test_span_matching(spark):
    gold = spark.createDataFrame([(1, "k", 0, 5), (1, "k", 10, 15), (1, "k", 20, 25)], "doc_id long, kind string, char_start int, char_end int")
    pred = spark.createDataFrame([(1, "k", 3, 8), (1, "k", 14, 19), (1, "k", 3, 8), (1, "j", 20, 25)], "doc_id long, kind string, char_start int, char_end int")
    total = spans.scores(spans.matched(gold, pred), ["kind"]).where("kind IS NULL").first()
    assert (total.tp, total.fp, total.fn) == (1, 3, 2)
    assert spans.scores(spans.matched(gold, pred, overlap=True), ["kind"]).where("kind = 'k'").first().tp == 2


def test_metrics_with_ties_and_one_class(spark):
    rows = spark.createDataFrame([(0.5, 1, "a"), (0.5, 0, "a"), (0.9, 1, "a"), (1.0, 1, "b")], "p double, y int, s string")
    got = {r.s: r.auc for r in metrics.auc(rows, ["s"]).collect()}
    assert got["a"] == pytest.approx(0.75) and got["b"] is None
    assert {r.bin: r.n for r in metrics.calibration(rows).collect()} == {5: 2, 9: 2}
    assert metrics.nearest_rank(rows, [], "p").first().high == 0.9


def test_policy_and_messages(spark):
    who = spark.createDataFrame([("a", "person", "1"), ("b", "animal", "2")], "ref string, kind string, group_id string")
    consents = spark.createDataFrame([("1", "inactive", "permit")], "group_id string, status string, decision string")
    assert [r.ref for r in policy.consented(who, consents).collect()] == ["b"]
    given_to = spark.createDataFrame([("a", "P"), ("b", "Q")], "ref string, provider_id string")
    assert policy.panel(who, given_to, "P", "person").count() == 1 and policy.panel(who, given_to, "P", "person", sees_rows=False).count() == 0
    one = spark.range(1)
    assert one.select(strings.hl7_escape(F.lit("a|b^c&d~e\\"))).first()[0] == "a\\F\\b\\S\\c\\T\\d\\R\\e\\E\\"
    steps = spark.createDataFrame([("k", 1, "fired"), ("k", 2, "ordered")], "key string, seq int, state string")
    assert messages.current_state(steps, "key", "seq", "state", "new").first().state == "ordered"
    assert [r.is_legal for r in messages.legal_steps(steps, "key", "seq", "state", ["new", "fired", "acknowledged", "ordered"]).orderBy("seq").collect()] == [True, False]


def test_functions(spark):
    one = spark.range(1)
    row = one.select(
        numbers.digest_bucket(F.lit("x"), 3).alias("b"), numbers.code_sum_bucket(F.lit("ab"), 7).alias("c"), strings.split_pair(F.lit("120/80"))[1].alias("dia"), strings.split_pair(F.lit("120"))[0].alias("none"),
        dates.duration_days(F.lit(2), F.lit("weeks")).alias("days"), dates.date_similarity(F.lit("2000-01-02"), F.lit("2000-01-03")).alias("ds"), strings.wait_text(F.lit(75)).alias("wait"), numbers.banded(F.lit(120), [50, 100, 150], ["a", "b", "c", "d"]).alias("band"), numbers.clipped(F.lit(None).cast("double"), 0.0, 1.0).alias("n"),
    ).first()
    import hashlib

    assert row.b == int(hashlib.sha256(b"x").hexdigest(), 16) % 3 and row.c == (97 + 98) % 7
    assert (row.dia, row.none, row.days, row.ds, row.wait, row.band, row.n) == (80, None, 14, 0.85, "1h 15m", "c", None)
    assert one.select(first_name_similarity(F.lit("J"), F.lit("john"))).first()[0] == 0.85


def test_federation(spark):
    rows = spark.createDataFrame([(i, "A" if i % 2 else "B", float(i % 10), int(i % 10 > 5)) for i in range(200)], "id long, site_id string, x double, y int")
    weights, history = federate.federated_fit(rows, ["x"], "y", rounds=20, rate=1.0, learning_rate=0.5)
    assert history[-1]["norm"] != history[0]["norm"] and weights[1] > 0
    store = spark.createDataFrame([("g", "A", 1), ("g", "B", 2), ("h", "A", 3)], "g string, site_id string, m int")
    groups = federate.manifest(store, "m", "g")[1]
    assert federate.fan_out(store.where("g = 'g'").select("g").distinct(), groups, store, "g").count() == 2
    assert federate.fetch(store, "A", {"g": "zz"}, "t")[1].first().status == 404


def test_members(spark):
    groups = spark.sql("SELECT 'h' AS id, array(named_struct('id', '1', 'name', 'Ann')) AS humans, array(named_struct('id', '2', 'name', CAST(NULL AS STRING))) AS animals")
    got = members.flatten(groups, "id", {"humans": ("Patient", "Patient/", F.col("m.id"), F.col("m.name")), "animals": ("Animal", "Animal/", F.col("m.id"), F.col("m.name"))})
    assert {(r.ref, r.name) for r in got.collect()} == {("Patient/1", "Ann"), ("Animal/2", "Animal")}
    with pytest.raises(KeyError):
        members.point(got, "ref", "zz")
    with pytest.raises(ValueError):
        members.with_kind(got, "kind", "zz", {"Patient"})


def test_generators_do_not_depend_on_partitions(spark):
    base = generate.groups(spark, 50)
    a, b = (sorted(map(tuple, generate.group_members(base.repartition(n)).collect())) for n in (1, 7))
    assert a == b
    picks = generate.weighted_pick(spark.range(400), "id", spark.createDataFrame([("x", 3.0), ("y", 1.0)], "v string, w double"), "v", "w")
    share = picks.where("v = 'x'").count() / 400
    assert 0.65 < share < 0.85 and picks.where("v IS NULL").count() == 0


def test_first_match_takes_the_first_lookup(spark):
    rows = spark.createDataFrame([("1", "A", "fever, valley"), ("2", "B", "rabies in bat"), ("3", "C", "none")], "id string, code string, label string")
    by_code = spark.createDataFrame([("A", "first", 1), ("A", "second", 0)], "c string, name string, ordinal int")
    by_text = spark.createDataFrame([("rabies", "R", 0), ("fever", "F", 1)], "p string, name string, ordinal int")
    got = members.first_match(rows, "id", [(by_code, rows.code == by_code.c), (by_text, rows.label.contains(by_text.p))], "name")
    assert {r.id: r.name for r in got.collect()} == {"1": "second", "2": "R", "3": None}


def test_chart_and_listing(spark):
    who = spark.createDataFrame([("a", "g"), ("b", "h")], "ref string, group_id string")
    conditions = spark.createDataFrame([("a", "X", "2024", True), ("a", "Y", "2023", False)], "ref string, code string, onset string, active boolean")
    events = spark.createDataFrame([("a", i, f"2024-01-{i:02d}", ["m1", "m2"] if i % 2 else ["m1"]) for i in range(1, 16)], "ref string, event_id int, date string, medications array<string>")
    row = members.chart(who, conditions, events).where("ref = 'a'").first()
    assert [c.code for c in row.conditions] == ["X"] and row.medications == ["m1", "m2"] and len(row.recent) == 12 and row.recent[0].event_id == 15
    assert [r.ref for r in members.listing(who, who.where("ref = 'b'"), "group_id", "ref").collect()] == ["b", "a"]
    assert [r.ref for r in members.search(who, "H", ["group_id"]).collect()] == ["b"]


def test_gold_and_person(spark):
    got = text.annotate("No valley fever. Possible fever; feverish.", {"condition": {"fever": "1", "valley fever": "2"}}, ("no ",), ("possible",))
    assert [(e["code"], e["negated"], e["uncertain"]) for e in got] == [("2", True, False), ("1", True, True)]
    how = text.Extraction(patterns=(("age", r"(?P<value>\d+) year old", 0.9), ("gender", r"\b(?:man|woman)\b", 0.9)))
    found = text.entities(spark.createDataFrame([(1, "A 40 year old woman met a 20 year old man.")], "doc_id long, text string"), how)
    row = messages.person(found, F.lit("2024-03-01").cast("date")).first()
    assert (row.age, row.gender, str(row.birth_date)) == (40, "woman", "1984-03-01")


def test_series(spark):
    from hearth.operators import series

    rows = spark.createDataFrame([("a", i, float(i)) for i in range(30)] + [("b", 1, 1.0)], "k string, t int, v double")
    assert {r.k: r.total for r in series.last_sum(rows, ["k"], "t", "v", 3).collect()} == {"a": 84.0, "b": 1.0}
    assert series.region_series(rows, "k", "b", "t").count() == 0 and series.region_series(rows, "k", "a", "t").count() == 30
    assert {r.k: r.trend for r in series.trend(rows, "k", "t", "v").collect()}["a"] == "rising"
    assert series.air_quality(spark.createDataFrame([(40,), (None,), (400,)], "aqi int"), "aqi").first().category == "Hazardous"


def test_local_fits_and_averaging_against_numpy(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 2))
    y = (x[:, 0] - 0.5 * x[:, 1] + rng.logistic(size=400) > 0.8).astype(int)
    site = np.where(np.arange(400) % 3 == 0, "A", "B")
    rows = [(s, float(a), float(b), int(c)) for s, (a, b), c in zip(site, x, y)] + [("C", 1.0, 1.0, 1), ("C", 2.0, 0.0, 1)]
    df = spark.createDataFrame(rows, "site_id string, a double, b double, y int").repartition(3)
    local = federate.local_fits(df, ["a", "b"], "y")
    assert set(local) == {"A", "B"}  # a site of one class has no model
    for s, (n, w) in local.items():
        m = site == s
        z, t = np.column_stack([np.ones(m.sum()), x[m]]), y[m]
        share = np.where(t == 1, m.sum() / (2 * t.sum()), m.sum() / (2 * (1 - t).sum()))
        p = 1 / (1 + np.exp(-z @ w))
        gradient = z.T @ (share * (p - t)) + np.array([0, w[1], w[2]])
        assert n == m.sum() and np.abs(gradient).max() < 1e-6  # at the minimum of the balanced, ridged loss
    shared = federate.averaged(local)
    mean = sum(n * w for n, w in local.values()) / 400
    assert np.allclose(shared, mean * (1 - 0.5**10))
    scored = federate.site_scores(df.where("site_id <> 'C'"), ["a", "b"], "y", local, shared)
    assert scored.groupBy("model").count().count() == 2 and scored.count() == 800


def test_notes_against_brute_force(spark):
    import re

    from hearth.operators import notes

    texts = ["BP 120/80. Fifty-six-year-old man, no dog. Possible TICK bite? HR: 88, T 98.6F for two weeks", "fifty-six year old, 56 year old 7 y/o F", "", None, "Seen w/o mouse or rat since 3 days x ten years. R/o canal water. RR=16 SpO2 97%", "No hiking. Outdoor camp é BP 90 / 60 x", "negative for tick. free of soil dust exposure gardening"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.doc_id, r.kind, r.name, r.char_start, r.said, r.value, r.value2, r.negated, r.uncertain) for r in notes.measures(df).collect())
    want = []
    for i, t in enumerate(texts):
        t = " ".join((t or "").split())
        starts = [0, *(m.end() for m in re.finditer(r"(?<=[.!?])\s+(?=[A-Z])", t))]

        def cue(at, cues, n):
            window = re.findall(r"\b[\w/]+\b", t[max(s for s in starts if s <= at) : at].lower())[-n:]
            return any(c in " ".join(window) if " " in c else c in window for c in cues)

        for name, pattern, _ in notes.VITALS:
            want += [(i, "Vital", name, m.start(), m[0], float(m[1]), float(m[2]) if name == "blood_pressure" else None, False, False) for m in re.finditer(pattern, t, re.I)]
        ages = [(m.start(), m.end(), m[0], notes.NUMBER_WORDS[m[1].lower()] + notes.NUMBER_WORDS.get((m[2] or "").lower(), 0)) for m in re.finditer(notes.WORDED_AGE, t, re.I)]
        for pattern in notes.AGES:
            ages += [(m.start(), m.end(), m[0], int(m[1])) for m in re.finditer(pattern, t, re.I) if not any(a <= m.start() < b for a, b, *_ in ages)]
        want += [(i, "Demographic", "age", a, said, float(v), None, False, False) for a, _, said, v in ages]
        want += [(i, "Demographic", sex, m.start(), m[0], None, None, False, False) for sex, pattern in notes.SEXES if (m := re.search(pattern, t))]
        for m in re.finditer(notes.DURATION, t, re.I):
            n = int(m[1]) if m[1].isdigit() else notes.NUMBER_WORDS[m[1].lower()]
            want.append((i, "Duration", "duration", m.start(), m[0], float(n), float(n * notes.DAYS[m[2].lower()]), False, False))
        for name, pattern in notes.EXPOSURES:
            want += [(i, "Exposure", name, m.start(), m[0], None, None, cue(m.start(), notes.NEGATIONS, 5), cue(m.start(), notes.HEDGES, 6)) for m in re.finditer(pattern, t, re.I)]
    assert got == sorted(want) and any(w[7] for w in want) and any(w[8] for w in want)


def test_every_cue_is_found():
    from hearth.operators import notes

    for cue in (*notes.NEGATIONS, *notes.HEDGES):
        how = text.Extraction(lexicons={"k": {"rash": "R"}}, negations=notes.NEGATIONS, hedges=notes.HEDGES)
        found = text.extract_text(f"Patient seen, {cue} rash", how)[0]
        assert (found["negated"], found["uncertain"]) == (cue in notes.NEGATIONS, cue in notes.HEDGES)
