"""Containment and priority look-ups against the definition."""

import random

from pyspark.sql import functions as F

from hearth.operators import lookup


def test_containing_against_brute_force(spark):
    random.seed(3)
    letters = "abé日 "
    texts = ["".join(random.choices(letters, k=random.randrange(0, 60))) for _ in range(150)] + [None, "", "abcdefgh", "xxabcdefghxx", "abcdefg"]
    phrases = ["".join(random.choices(letters, k=random.randrange(1, 7))) for _ in range(80)] + [t[3:25] for t in texts[:60] if t] + [None, "", "abcdefgh", "bcdefghx", "é", "never seen", "abcdefgh"]
    t = spark.createDataFrame(list(enumerate(texts)), "t long, phrase string").repartition(3)  # a clashing name
    p = spark.createDataFrame(list(enumerate(phrases)), "p long, said string").repartition(2)
    got = sorted((r.t, r.p) for r in lookup.containing(t, "phrase", p, "said").collect())
    assert got == sorted((i, j) for i, a in enumerate(texts) for j, b in enumerate(phrases) if a is not None and b and b in a)
    assert lookup.containing(t, "phrase", p.limit(0), "said").count() == 0 and lookup.containing(t.limit(0), "phrase", p, "said").count() == 0
    plan = lookup.containing(t, "phrase", p, "said")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_starting(spark):
    t = spark.createDataFrame([(1, "valley fever"), (2, "val"), (3, None), (4, ""), (5, "été chaud")], "t int, text string")
    p = spark.createDataFrame([(1, "valley"), (2, "v"), (3, ""), (4, None), (5, "été"), (6, "valley fever x")], "p int, said string")
    assert sorted((r.t, r.p) for r in lookup.starting(t, "text", p, "said").collect()) == [(1, 1), (1, 2), (2, 2), (5, 5)]


def test_prioritised(spark):
    rows = spark.createDataFrame([(k,) for k in "abcd"], "k string")

    def hits(*made):
        return spark.createDataFrame(list(made), "k string, ordinal int, name string")

    got = lookup.prioritised(rows, "k", [(0, hits(("a", 9, "embedded"))), (1, hits(("a", 1, "x"), ("b", 5, "code"), ("c", 2, "code"))), (1, hits(("b", 3, "text"), ("c", 4, "text")))], "name", F.lit("none"))
    assert {r.k: r.name for r in got.collect()} == {"a": "embedded", "b": "text", "c": "code", "d": "none"}
