import random

from brute import brute_alike, brute_groups, brute_simhash

from hearth.llm import queries, simhash


def test_simhash_query(spark, sf, texts):
    fps = {k: brute_simhash(t) for k, t in texts.items()}
    groups = brute_groups(fps)
    for r in queries.op8_simhash(spark, sf).collect():
        assert r.fingerprint == f"{fps[r.doc_id]:016x}" and r.component_id == groups[r.doc_id]


def test_simhash_links_in_chains_and_clouds(spark):
    random.seed(8)
    fps = {}
    for k in range(30):
        centre = random.getrandbits(64)
        for j in range(random.choice([1, 2, 12])):
            x = centre
            for b in random.sample(range(64), random.randint(0, 4)):
                x ^= 1 << b
            fps[1000 * k + j] = x
            if j % 3 == 0:
                centre = x  # chains wander off
    signed = [(i, x - (1 << 64) if x >> 63 else x) for i, x in fps.items()]
    frame = spark.createDataFrame(signed, "id long, fp long")
    want = brute_groups(fps)
    for large in (64, 2):  # both ways of comparing
        assert {r.id: r.component for r in frame.join(simhash.linked(frame, hot_bucket=large), "fp").collect()} == want


def test_simhash_odd_rows(spark, odd, empty):
    got = simhash.simhash_groups(odd)
    assert got.count() == odd.count() and got.where("fingerprint = '0000000000000000'").select("component_id").distinct().count() == 1
    stay = simhash.one_of_each(odd)
    assert stay.columns == odd.columns and stay.where("doc_id = 5").count() == 1 and stay.where("doc_id IS NULL").count() == 2
    assert simhash.simhash_groups(empty).count() == 0 and simhash.one_of_each(empty).count() == 0


def test_simhash_any_column_name_is_free(spark, empty):
    docs = spark.createDataFrame([(2, "a b c d e f", 1, 1, 1), (1, "a b c d e f", 2, 2, 2), (3, "quite another text of some words", 3, 3, 3)], "doc_id long, text string, stays int, turn int, component int")
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(tuple(r)[2:] for r in kept.collect()) == [(2, 2, 2), (3, 3, 3)]
    assert simhash.simhash_groups(empty).count() == 0 and simhash.one_of_each(empty).count() == 0


def test_one_of_alike_against_all_pairs(spark, documents, texts):
    kept = {r.doc_id for r in simhash.one_of_alike(documents).collect()}
    groups = brute_alike(texts)
    assert kept == set(groups.values()) and len(kept) < len(texts)


def test_one_of_alike_on_clouds_chains_and_odd_rows(spark, odd, empty):
    rng = random.Random(12)
    def prose(n):
        return ["".join(rng.choices("abcdefgh", k=6)) for _ in range(n)]
    docs = []
    for g in range(12):
        base = prose(rng.choice((40, 90, 300)))
        for c in range(30):  # copies with a few edits each: alike to the first, not always to one another
            copy = list(base)
            for k in rng.sample(range(len(base)), rng.randint(0, max(1, len(base) // 60))):
                copy[k] = prose(1)[0]
            docs.append((1000 * g + c, " ".join(copy)))
    docs += [(50_000 + k, " ".join(prose(60))) for k in range(200)]
    docs += [(60_000, " ".join(["w"] * 50)), (60_001, " ".join(["w"] * 49)), docs[0]]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    kept = [r.doc_id for r in simhash.one_of_alike(df).collect()]
    want = set(brute_alike(dict(docs)).values())
    assert len(kept) == len(set(kept)) and want <= set(kept) and len(set(kept) - want) <= 0.05 * (len(docs) - len(want))
    assert simhash.one_of_alike(empty).count() == 0 and simhash.one_of_alike(empty).columns == empty.columns
    got = simhash.one_of_alike(odd)
    ids = [r.doc_id for r in got.where("doc_id IS NOT NULL").collect()]
    assert len(ids) == len(set(ids)) and got.where("doc_id IS NULL").count() == odd.where("doc_id IS NULL").count()


def test_no_join_passes_its_side_through_the_driver(spark, documents, tmp_path, monkeypatch):
    """Small enough for a broadcast, but the sides grow with the input."""
    from hearth.llm import shared

    plans = []
    plainly = shared.written

    def heard(df, name):
        out = plainly(df, name)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    for module in (shared, simhash):
        monkeypatch.setattr(module, "written", heard)
    for found in (simhash.simhash_groups(documents), simhash.one_of_alike(documents)):
        found.collect()
        plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 10 and not any("Broadcast" in p for p in plans)


def test_one_of_alike_loses_no_link(spark):
    """Chains whose ends are not alike, few edits in short and long texts, phrases that all texts hold: the groups are those of all pairs."""
    rng = random.Random(5)

    def prose(n):
        return ["".join(rng.choices("abcdefgh", k=6)) for _ in range(n)]

    often, docs = prose(30), []
    for g in range(150):
        base = (often if g % 3 == 0 else []) + prose(rng.choice((20, 45, 60, 120, 240)))
        for c in range(rng.choice((2, 3, 6))):
            docs.append((100 * g + c, " ".join(base)))
            for k in rng.sample(range(len(base)), max(1, round(len(base) * rng.choice((0.02, 0.025))))):
                base[k] = prose(1)[0]
    docs += [(90_000, "few words"), (90_001, " "), (90_002, "\n"), (7, "another text of an id that is there")]
    docs = [(i + (i == 7) * 80_000, t) for i, t in docs]
    rng.shuffle(docs)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    kept = sorted(r.doc_id for r in simhash.one_of_alike(df).collect())
    assert kept == sorted(set(brute_alike(dict(docs)).values()))


def test_prefixes_of_alike_sets_meet_and_sketches_allow_them():
    import numpy as np

    rng = np.random.default_rng(3)
    frequent = rng.random(simhash.PLACES) < 0.3
    for n in (1, 2, 4, 5, 9, 50, 333):
        for _ in range(50):
            x = rng.integers(1, 1 << 63, n, dtype=np.uint64)
            y = np.concatenate([x[: max(1, n - rng.integers(0, n // 5 + 1))], rng.integers(1, 1 << 63, rng.integers(0, n // 5 + 1), dtype=np.uint64)])
            x, y = np.unique(x), np.unique(y)
            both = len(np.intersect1d(x, y))
            if both >= 0.8 * (len(x) + len(y) - both):
                assert np.isin(simhash.prefix(x, 0.8, frequent), simhash.prefix(y, 0.8, frequent)).any()
            bits = np.unpackbits((simhash.sketch(x) ^ simhash.sketch(y)).view(np.uint8)).sum()
            assert bits <= len(x) + len(y) - 2 * both
