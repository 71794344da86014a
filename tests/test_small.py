"""Functions that no registered query uses, each on a few rows."""

import datetime as dt
import hashlib
import re

from pyspark.sql import functions as F

from hearth.functions import dates, numbers, strings
from hearth.operators import detect, federate, generate, graph, members, messages, models, notes, policy, text
from hearth.sources import readers, writers
from hearth.streaming import live


def test_filters_and_search(spark):
    rows = spark.createDataFrame([("1", "Pima", "dog"), ("2", "PIMA", "cat"), ("3", "Gila", None)], "id string, county string, species string")
    assert members.in_region(rows, "county", "pima").count() == 2 and members.in_region(rows, "county", None).count() == 3
    assert members.with_value(rows, "species", "dog").count() == 1 and members.with_value(rows, "species", None).count() == 3
    people = spark.createDataFrame([("a", "Ann Lee", "1990-01-02", "1 Main"), ("b", "Bo Ray", "1990-01-09", "2 Elm")], "ref string, name string, birth string, address string")
    assert [(r.ref, round(r.score, 2)) for r in graph.identity_search(people, "ann", "1990-01-02", "main").collect()] == [("a", 0.99), ("b", 0.2)]


def test_projections(spark):
    one = spark.sql("SELECT array(named_struct('url', 'http://x/zip', 'v', '1'), named_struct('url', 'http://y/zip', 'v', '2')) AS ext, ' ' AS given, CAST(NULL AS STRING) AS family")
    row = one.select(strings.extension_value(F.col("ext"), "/zip", "v").alias("z"), strings.display_name(F.col("given"), F.col("family"), F.lit("id")).alias("n"), members.codings([("s", F.lit("1")), ("t", F.lit(None).cast("string"))]).alias("c"), numbers.weighted_lookup(F.lit("b"), {"a": 1.0, "b": 2.0}).alias("w"), strings.ordered_case(F.lit("bat rabies"), [("fever", "F"), ("rabies", "R")], "X").alias("o"), strings.same_prefix(F.lit("Smith"), F.lit("smirk"), 3).alias("p"), strings.either_contains(F.lit("Main"), F.lit("1 main st")).alias("e")).first()
    assert (row.z, row.n, len(row.c), row.w, row.o, row.p, row.e) == ("2", "id", 1, 2.0, "R", True, True)
    d = F.lit("2024-03-15").cast("date")
    row = spark.range(1).select(dates.age_by_year(F.lit("2000-12-31").cast("date"), d).alias("y"), dates.month_anchor(d, F.lit(3)).alias("m"), dates.mid_month(F.lit(2024), F.lit(2)).alias("h"), dates.week_start(F.lit("2025-01-01").cast("date")).alias("w"), dates.birth_from_age(F.lit(24), F.lit("2024-02-29").cast("date")).alias("b"), dates.iso_date(F.lit("bad")).alias("i"), dates.age_years(d, d).alias("a")).first()
    assert (row.y, str(row.m), str(row.h), str(row.w), str(row.b), row.i, row.a) == (24, "2023-12-01", "2024-02-15", "2024-12-30", "2000-02-29", None, 0.0)


def test_access(spark):
    asked = spark.createDataFrame([("vet", "chart"), ("vet", "admin")], "role string, resource string")
    assert {r.resource: r.allowed for r in policy.allowed(asked, spark.createDataFrame([("vet", "chart")], "role string, resource string")).collect()} == {"chart": True, "admin": False}
    signals = spark.createDataFrame([("g", "animal", "A1"), ("h", "animal", "B1")], "group_id string, kind string, code string")
    consents = spark.createDataFrame([("g", "active", "deny")], "group_id string, status string, decision string")
    rows = policy.pointers(signals, consents, F.substring("code", 1, 1)).collect()
    assert [(r.group_id, r.other_kind, r.code_class) for r in rows] == [("h", "animal", "B")]
    assert policy.visible_alerts(signals, "vet", {"vet": ["animal"]}).count() == 0
    assert {r.provider_id: r.refs for r in policy.panels(spark.createDataFrame([("a", "P"), ("b", "P")], "ref string, provider_id string")).collect()} == {"P": ["a", "b"]}
    assert policy.staff(spark.createDataFrame([("nurse", "X"), ("nurse", "Y")], "role string, facility string"), "nurse", "X").count() == 1
    assert policy.masked(signals, ["code"]).where("code IS NULL").count() == 2


def test_sites(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("c",)], "ref string")
    given = spark.createDataFrame([("a", "P"), ("b", "Q")], "ref string, provider_id string")
    at = spark.createDataFrame([("P", "S1")], "provider_id string, site_id string")
    assert {r.ref: r.site_id for r in federate.routed_sites(rows, given, at, "ref", "S9").collect()} == {"a": "S1", "b": "S9", "c": "S9"}
    assert federate.routed_sites(rows, given, at, "ref").count() == 1
    sites = spark.createDataFrame([("S1", "clinic")], "site_id string, kind string")
    assert federate.with_provenance(federate.routed_sites(rows, given, at, "ref"), sites).first().provenance.kind == "clinic"


def test_text_helpers(spark):
    found = spark.createDataFrame([(1, 5, 8, "k", 0.5), (1, 50, 55, "k", 0.9)], "doc_id long, char_start int, char_end int, kind string, confidence double")
    phases = spark.createDataFrame([(1, 0, 10, "CC")], "doc_id long, start int, end int, phase string")
    assert {r.char_start: r.phase for r in text.phase_of(found, phases).collect()} == {5: "CC", 50: "UNKNOWN"}
    none = found.select("doc_id", "char_start", "char_end", "kind", F.lit("keep").alias("decision")).where("char_start = 50")
    assert [r.decision for r in text.handed_back(found, none).collect()] == ["pending"]
    docs = spark.createDataFrame([(1, "To do. It has 5. And so.")], "doc_id long, text string")
    rows = text.phased(text.sentences(docs), "doc_id", [("^to ", "PLAN")], [("[0-9]", "M")])
    assert {r.phase: r.sentences for r in text.by_phase(rows, "doc_id").collect()} == {"PLAN": ["To do."], "M": ["It has 5.", "And so."]}
    assert text.routed(spark.range(1), F.lit("dog"), {"dog": "vet"}, "human").first().adapter == "vet"
    assert "sourceDigest" in messages.provenance(docs).first().provenance
    to = messages.for_destination(F.lit("b"), F.lit("hl7"), F.lit("json"), ["a"], ["b"], F.lit("note"))
    assert spark.range(1).select(to).first()[0] == "json"


def test_graph_helpers(spark):
    es = spark.createDataFrame([("a", "z", "IN"), ("a", "y", "IN"), ("a", "q", "OUT")], "source string, target string, kind string")
    assert graph.first_neighbour(es, "IN").first().target == "y"
    assert graph.same_code_pairs(spark.createDataFrame([("1",)], "code string"), spark.createDataFrame([("1", "1"), ("1", "2")], "code string, other string")).count() == 1
    who = spark.createDataFrame([("g", "b", "p"), ("g", "a", "p")], "group_id string, ref string, kind string")
    assert members.by_kind(who).first().refs == ["a", "b"]
    people = generate.group_members(generate.groups(spark, 30))
    dealt = generate.assigned_cases(people, F.lit(0.9), ["x", "y", "z"])
    assert dealt.groupBy("ref").count().where("count > 2").count() == 0 and dealt.count() > 0
    assert detect.with_noised_count(spark.range(3).withColumn("n", F.lit(5)), "n", ["id"]).where("noised_count < 0").count() == 0


def test_model_saved_and_catalog(spark, tmp_path):
    rows = spark.createDataFrame([(i, float(i), float(i % 3), float(i > 10)) for i in range(24)], "id long, a double, b double, y double")
    model = models.fit(rows, ["a", "b"], "tree")
    assert "If" in models.rules(model) or "Predict" in models.rules(model)
    assert models.tree_importance(model, ["a", "b"])[0][0] == "a"
    writers.save_model(model, str(tmp_path / "m"))
    assert (tmp_path / "m" / "metadata").exists()
    again = models.with_probability(writers.load_model(str(tmp_path / "m")), rows).select("id", "p").collect()
    assert sorted(again) == sorted(models.with_probability(model, rows).select("id", "p").collect())
    assert {r.fold for r in models.hashed_folds(rows, "id").collect()} <= set(range(5))
    readers.register(spark, {"small_rows": rows})
    assert spark.table("small_rows").count() == 24
    writers.write_parquet(rows, str(tmp_path / "p"), ["b"])
    assert readers.read_parquet(spark, str(tmp_path / "p"), ["a"]).columns == ["a"]


def test_sessions_and_append(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([("k", t), ("k", t + dt.timedelta(minutes=5)), ("k", t + dt.timedelta(hours=3))], "k string, ts timestamp")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = live.read_files(spark, str(tmp_path / "in"), rows.schema, "*.parquet")
    out = live.run_once(live.sessions(stream, "ts", ["k"], "10 minutes"), str(tmp_path / "sessions"), "complete", str(tmp_path / "c1"))
    assert sorted(r.n for r in out.collect()) == [1, 2]
    live.append_batches(stream, str(tmp_path / "log"), str(tmp_path / "c2")).awaitTermination()
    assert writers.latest(spark.read.parquet(str(tmp_path / "log")), "ts", "k", 2).count() == 2


def test_co_members_of_all_without_pairs(spark, sf):
    from hearth.plans import exchange

    rows = exchange.QUERIES["co_members"](spark, sf)
    assert rows.count() == spark.read.parquet(f"{sf}/customer.parquet").count() + spark.read.parquet(f"{sf}/supplier.parquet").count()
    n = 50_000  # as pairs, 2.5e9 rows
    big = spark.range(n).select(F.concat(F.lit("C"), "id").alias("ref"), F.lit("customer").alias("kind"), F.lit("g").alias("group_id"))
    one = spark.createDataFrame([("S", "supplier", "g"), ("T", "supplier", "alone")], "ref string, kind string, group_id string")
    m = big.unionByName(one)
    got = policy.co_members(m, m.select("ref", F.lit("P").alias("provider_id"))).groupBy("n_visible", "n_hidden").count().collect()
    assert {tuple(r) for r in got} == {(n - 1, 1, n), (0, n, 1)}


def test_others_recent_of_all_events(spark, sf):
    from hearth.plans import features

    rows = features.QUERIES["other_member_recent"](spark, sf)
    assert rows.count() == spark.read.parquet(f"{sf}/orders.parquet").count()
    day = dt.date(2020, 4, 1)
    cases = [("g", "a", "x", 0), ("g", "a", "y", 90), ("g", "b", "x", 0), ("g", "b", "z", 91), ("g", "b", None, 5), ("h", "c", "x", 0)]
    cases = spark.createDataFrame([(g, m, c, day - dt.timedelta(n)) for g, m, c, n in cases], "group_id string, ref string, code string, date date")
    asks = spark.createDataFrame([(1, "g", "a", day), (2, "g", "b", day), (3, "g", "n", day), (4, "h", "c", day), (5, "g", "a", day - dt.timedelta(1)), (6, "g", None, day)], "event_id long, group_id string, ref string, date date")
    got = {r.event_id: (r.n_other_cases, r.n_other_codes) for r in features.features.others_recent(asks, cases, 90).collect()}
    assert got == {1: (2, 1), 2: (2, 2), 3: (4, 2), 4: (0, 0), 5: (2, 1), 6: (0, 0)}


def test_federated_fit_takes_local_steps(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    data = [("AB"[i % 2], float(x), int(x + rng.normal() > i % 2)) for i, x in enumerate(rng.normal(size=90))] + [("C", 1.0, 1)] * 5
    got, history = federate.federated_fit(spark.createDataFrame(data, "site_id string, x double, y int"), ["x"], "y", rounds=2, local_steps=3)
    shared = np.zeros(2)
    for _ in range(2):
        fits = []
        for s in "AB":
            x, y, w = np.array([[1, r[1]] for r in data if r[0] == s]), np.array([r[2] for r in data if r[0] == s]), shared.copy()
            for _ in range(3):
                w = w - x.T @ (1 / (1 + np.exp(-x @ w)) - y) / len(y)
            fits.append(w)
        shared = shared + 0.5 * (np.mean(fits, 0) - shared)
    assert np.allclose(got, shared) and history[-1]["sites"] == 2 and history[-1]["rows"] == 90


def test_many_matches_and_digests_against_plain_python(spark):
    texts = ["", "none", "a1b22", *("x" * (n % 3) + "".join(f"{k}{'yz' * (k % 4)}q" for k in range(n)) for n in range(1, 40))]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", notes.matches(F.col("t"), "[0-9]+").alias("m"), numbers.digest_bucket(F.col("t"), 97).alias("b"), numbers.digest_bucket(F.col("t"), 1 << 27).alias("c")).collect()
    for r in got:
        assert [tuple(m) for m in r.m] == [(m[0], m.start(), m.end()) for m in re.finditer("[0-9]+", r.t)]
        digest = int(hashlib.sha256(r.t.encode()).hexdigest(), 16)
        assert (r.b, r.c) == (digest % 97, digest % (1 << 27))


def test_small_tasks_read_little_at_any_size(spark, sf, tmp_path):
    from hearth.plans import encounters, small_tasks, surveillance

    big = spark.range(3_000_000).select("id", F.md5(F.col("id").cast("string")).alias("x"))
    big.coalesce(1).write.option("parquet.block.size", 4 << 20).parquet(str(tmp_path / "t.parquet"))
    read = small_tasks("t")(lambda s, d: s.read.parquet(f"{d}/t.parquet"))(spark, str(tmp_path))
    assert read.rdd.getNumPartitions() > spark.read.parquet(str(tmp_path / "t.parquet")).rdd.getNumPartitions()
    assert int(read.sparkSession.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum")) > int(spark.conf.get("spark.sql.shuffle.partitions"))
    for name, plan in (("cross_kind_clusters", surveillance), ("worst_per_group", surveillance), ("at_risk_asked", surveillance), ("alerts_numbered", encounters)):
        assert plan.QUERIES[name](spark, sf).sparkSession.conf.get("spark.sql.files.maxPartitionBytes") == "8m"
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") != "8m"


def test_group_sums_over_many_parts_fit_like_one_group(spark):
    from hearth.functions import tables
    from hearth.session import own_session

    own = own_session(spark)
    tables.register(own)
    rows = [("g", str(i % 3), float(i), 3.0 * i + 2 if i % 7 else None) for i in range(10_000)] + [("h", None, 1.0, 1.0)]
    own.createDataFrame(rows, "g string, part string, x double, y double").createOrReplaceTempView("parts")
    sums = own.sql("SELECT * FROM group_sums(TABLE(parts) PARTITION BY (g, part), 'y')")
    assert sums.count() == 4
    got = own.sql("SELECT * FROM group_solved(TABLE(SELECT * FROM group_sums(TABLE(parts) PARTITION BY (g, part), 'y')) PARTITION BY (g))")
    assert {r.n: [round(c, 4) for c in r.coefficients] for r in got.collect()} == {sum(i % 7 > 0 for i in range(10_000)): [3.0, 2.0], 1: [0.5, 0.5]}


def test_generated_rows_follow_given_tables(spark, sf):
    from hearth.plans import access, notes as note_plans

    count = {t: spark.read.parquet(f"{sf}/{t}.parquet").count() for t in ("customer", "supplier", "part")}
    assert access.QUERIES["generated_members"](spark, sf).select("group_id").distinct().count() == count["customer"]
    assert access.QUERIES["generated_series"](spark, sf).count() == 26 * count["supplier"]
    assert {r.document: r.n for r in access.QUERIES["missing_document"](spark, sf).collect()} == {"present": count["supplier"], "missing": 0}
    assert note_plans.QUERIES["lexicon_terms"](spark, sf).select("code").distinct().count() > 3


def test_notes_are_dealt_by_the_size_of_their_table(spark, sf, monkeypatch):
    from hearth.plans import exchange, extensions, notes as note_plans

    monkeypatch.setattr(note_plans, "STORED", 1 << 10)
    rows = note_plans._notes(spark, sf)
    assert rows.rdd.getNumPartitions() > 8 and rows.count() == spark.read.parquet(f"{sf}/orders.parquet").count()
    for query in (exchange.QUERIES["span_scores"], extensions.QUERIES["phrase_hits"]):
        assert query(spark, sf).sparkSession.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "1024"


def test_steps_of_a_federated_fit_read_equal_rows_once(spark, monkeypatch):
    seen = []
    plain = federate.site_gradients

    def noted(rows, *how):
        seen.append(rows.count())
        return plain(rows, *how)

    monkeypatch.setattr(federate, "site_gradients", noted)
    data = [("s", i % 4 / 2, i % 3 % 2) for i in range(600)] + [("t", i % 4 / 2, i % 2) for i in range(40)]
    federate.federated_fit(spark.createDataFrame(data, "site_id string, x double, y int"), ["x"], "y", rounds=1, local_steps=2)
    assert seen == [12, 12]


def test_models_read_stored_features(spark, sf):
    from hearth.plans import evaluation

    plan = evaluation._model_rows(spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "RegExpReplace" not in plan and "regexp_replace" not in plan
