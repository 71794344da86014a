import random

import numpy as np
from brute import brute_tiles, thue_morse
from hypothesis import given, settings
from hypothesis import strategies as st

from hearth.llm import decontaminate, queries
from hearth.llm import kernels as K


@given(st.lists(st.sampled_from("abc"), max_size=14), st.lists(st.sampled_from("abc"), max_size=18))
@settings(max_examples=150, deadline=None)
def test_greedy_tiles(item, doc):
    a, b = (K.mix(np.array([ord(c) for c in x], np.uint64)) for x in (item, doc))
    for m in (2, 3):
        assert decontaminate.tiles(a, b, m) == brute_tiles(item, doc, m)


def test_words_alike_under_polynomials_are_no_match(spark):
    one, other = ("".join(x) for x in thue_morse(2048))
    item = spark.createDataFrame([(1, f"u v w {one} x y z k")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"u v w {other} x y z k"), (2, f"u v w {one} x y z k")], "doc_id long, text string")
    for block in (1 << 20, 10):
        assert [r.doc_id for r in decontaminate.leaks(docs, item, block_bytes=block, map_bits=12).collect()] == [2]
    # windows of 2,048 tokens whose Karp-Rabin hashes agree by construction
    a, b = (np.array([ord(c) for c in x], np.uint64) for x in thue_morse(2048))
    assert decontaminate.tiles(a, np.concatenate([b, a]), 5) == [(0, 2048, 2048)]


def test_repeated_text_takes_no_quadratic_time():
    import time

    began = time.process_time()
    word, phrase = np.full(20_000, 7, np.uint64), K.mix(np.arange(6).astype(np.uint64))
    assert decontaminate.tiles(word[:2_000], word, 5) == [(0, 0, 2_000)]
    assert decontaminate.tiles(np.tile(phrase, 300), np.tile(phrase, 1_750), 5) == [(0, 0, 1_800)]
    broken = np.tile(phrase, 1_750)
    broken[::97] = 1
    assert sum(t[2] for t in decontaminate.tiles(np.tile(phrase, 300), broken, 5)) > 1_700
    random.seed(3)
    steps = [x for k in range(5, 60) for x in [*([2] * k), 1000 + k]]  # a tile of each length
    doc = [x for k in random.sample(range(5, 60), 55) for x in [*([2] * k), 5000 + k]]
    found = decontaminate.tiles(np.array(steps, np.uint64), np.array(doc, np.uint64), 5)
    assert [t[2] for t in found] == list(range(59, 4, -1))
    assert time.process_time() - began < 4


def test_leaks(spark, odd, empty):
    random.seed(4)
    w = ["".join(random.choices("abcdefgh", k=6)) for _ in range(300)]
    item, halves = " ".join(w[:30]), " ".join(w[15:30] + ["zz"] + w[:15])
    docs = spark.createDataFrame([(1, " ".join(w[100:150]) + " " + item.upper() + " end"), (2, halves), (3, " ".join(w[100:200])), (4, " ".join(w[:14])), (5, None), (6, "x tiny item y"), (1, item)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item), (2, "tiny, item"), (3, None), (4, ""), (5, item)], "item_id long, text string")
    want = {(1, 1), (1, 5), (2, 1), (2, 5), (6, 2)}
    for block in (1 << 20, 100):  # by a broadcast block, and by a join
        rows = decontaminate.leaks(docs, bench, block_bytes=block, map_bits=12).collect()
        assert {(r.doc_id, r.item_id) for r in rows} == want
        assert {r.doc_id for r in decontaminate.clean(docs, bench, block_bytes=block, map_bits=12).collect()} == {3, 4, 5}
    assert {r.n_tiles for r in rows if r.doc_id == 2} == {2}
    assert decontaminate.leaks(empty, bench).count() == 0 and decontaminate.leaks(odd, bench.limit(0)).count() == 0
    assert decontaminate.clean(odd, bench).count() == odd.count()
    assert decontaminate.leaks(odd, bench, block_bytes=1).count() == decontaminate.leaks(odd, bench).count()
    assert decontaminate.clean(odd, bench, block_bytes=1).count() == odd.count() and decontaminate.clean(empty, bench, block_bytes=1).count() == 0


def tokens(text):
    return "".join(c.lower() if c.isascii() and c.isalnum() else c if not c.isascii() else " " for c in text or "").split()


def test_query_against_brute_force(spark, sf, texts):
    bench = {r.item_id: tokens(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    want = set()
    for d, text in texts.items():
        w = tokens(text)
        grams = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        for b, item in bench.items():
            shared = {j for i in range(len(item) - 4) if tuple(item[i : i + 5]) in grams for j in range(i, i + 5)}
            if len(item) >= 5 and 2 * len(shared) >= len(item):
                found = brute_tiles(item, w, 5)
                if 2 * sum(n for _, _, n in found) >= len(item):
                    want.add((d, b, len(item), sum(n for _, _, n in found), len(found), max(n for _, _, n in found)))
    rows = queries.op4_decontamination(spark, sf)
    assert {(r.doc_id, r.item_id, r.n_item_tokens, r.covered_tokens, r.n_tiles, r.longest_tile) for r in rows.collect()} == want and want
    joined = decontaminate.leaks(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet"), block_bytes=1)
    assert {tuple(r) for r in joined.collect()} == {tuple(r) for r in rows.collect()}
