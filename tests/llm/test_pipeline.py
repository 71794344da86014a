import collections
import hashlib
import os

import duckdb
import pytest
from brute import brute_alike, brute_tiles

from hearth.llm import quality, queries


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    want = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in want.description]
    got = queries.QUERIES[name](spark, sf).select(*columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))


def test_pipeline_against_brute_force(spark, sf, documents, piece_library):
    import corpus_pipeline

    docs = [r.asDict() for r in documents.collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    kept = {i for (i,) in con.execute(f"SELECT doc_id FROM ({quality.oracle()}) WHERE kept").fetchall()}
    docs = [d for d in docs if d["doc_id"] in kept]
    pages, holders = collections.Counter(d["source"] for d in docs), collections.Counter()
    for d in docs:
        holders.update({(d["source"], x) for x in d["text"].split("\n") if x.strip()})
    for d in docs:
        d["text"] = "\n".join(x for x in d["text"].split("\n") if not (holders[d["source"], x] >= 3 and holders[d["source"], x] > 0.1 * pages[d["source"]]))
    groups = brute_alike({d["doc_id"]: d["text"] for d in docs})
    docs = [d for d in docs if groups[d["doc_id"]] == d["doc_id"]]

    def toks(t):
        return "".join(c if not c.isascii() or c.isalnum() else " " for c in "".join(c.lower() if c.isascii() else c for c in t)).split(" ")

    bench = [[w for w in toks(r.text) if w] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]

    def leaks(d):
        w = [x for x in toks(d["text"]) if x]
        grams = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        for b in bench:
            shared = [i for i in range(len(b) - 4) if tuple(b[i : i + 5]) in grams]
            if 2 * 5 * len(shared) >= len(b) and 2 * sum(n for _, _, n in brute_tiles(b, w, 5)) >= len(b):
                return True
        return False

    docs = [d for d in docs if not leaks(d)]
    want = {(d["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()) for d in docs for ids in [[*piece_library.encode(d["text"]), 2]]}
    assert {(r.doc_id, r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, sf).collect()} == want


def test_stages_on_odd_rows(spark, sf, odd, empty):
    import corpus_pipeline

    for docs in (odd, empty):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, sf)
            out.collect()
            assert k == 4 or out.columns == docs.columns
