import random

import numpy as np
import pyarrow as pa
from brute import thue_morse
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hearth.llm import kernels as K
from hearth.llm.shared import components, met
from hearth.session import own_session


@given(st.lists(st.one_of(st.none(), st.text(max_size=30)), max_size=8))
@settings(max_examples=60, deadline=None)
def test_spans(rows):
    data, offsets = K.text_buffers(pa.array(rows, pa.string()))
    s, e, r = K.word_spans(data, offsets)
    assert [(int(k), bytes(data[i:j])) for k, i, j in zip(r, s, e)] == [(k, w) for k, t in enumerate(rows) for w in (t or "").encode().split()]
    h = K.spans_hash(data, s, e)
    by = {}
    for i, j, x in zip(s, e, h):
        assert by.setdefault(bytes(data[i:j]), x) == x
    assert len(set(by.values())) == len(by)
    s, e, r = K.line_spans(data, offsets)
    assert [(int(k), bytes(data[i:j])) for k, i, j in zip(r, s, e)] == [(k, w) for k, t in enumerate(rows) for w in (t or "").encode().split(b"\n")]


def test_spans_alike_under_polynomials_differ():
    for n in (64, 512, 1024, 2048, 4096):
        one, other = ("".join(x) for x in thue_morse(n))
        data, offsets = K.text_buffers(pa.array([one, other, one]))
        h = K.spans_hash(data, offsets[:-1], offsets[1:])
        assert h[0] == h[2] != h[1]
    data = np.frombuffer(b"x" * 200, np.uint8)
    ends = np.arange(201)
    assert len(set(K.spans_hash(data, np.zeros(201, np.int64), ends).tolist())) == 201


def test_components(spark):
    random.seed(3)
    edges = [(random.randrange(400), random.randrange(400)) for _ in range(350)] + [(1000 + i, 1001 + i) for i in range(40)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def test_joins_with_an_aggregate_split_a_hot_key(spark):
    own = own_session(spark, **{"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.coalescePartitions.enabled": "false"})
    rows = own.range(0, 60_000, 1, 12).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 500).cast("long").alias("key"), F.col("id").alias("v"), F.lit("x" * 20).alias("met"))
    sums = rows.groupBy("key").agg(F.count("*").alias("n"))
    for how, split in ((met(rows, sums, "key"), True), (rows.join(sums, "key"), False)):
        assert how.agg(F.sum("n")).first()[0] == 20_080 * 20_080 + 499 * 80 * 80  # columns that clash are kept
        found = how.select("key", "v", "met", "n")
        assert found.count() == 60_000
        found.collect()
        assert ("skew=true" in found._jdf.queryExecution().executedPlan().toString()) == split
