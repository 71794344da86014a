import hashlib
import random

from hearth.llm import queries, sentencepiece_bpe


def test_sentencepiece_is_exact(piece_library):
    bpe = sentencepiece_bpe.Bpe(queries.piece_model())
    random.seed(2)
    for _ in range(4000):
        t = "".join(random.choices(random.choice(["abcdefghij", "the inthereing", "  \n\t aA", "éèüñ日本▁ \x00😀ab", "aaaa  "]), k=random.randint(0, 30)))
        ids = piece_library.encode(t)
        assert bpe.encode(t) == [*ids, 2]
        assert bpe.decode([*map(str, ids), "2"]) == piece_library.decode(ids)
    assert bpe.decode(["233", "154"]) == piece_library.decode([233, 154])


def test_sentencepiece_query(spark, sf, odd, empty, texts, piece_library):
    def want(t):
        ids = [*piece_library.encode(t or ""), 2]
        return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(piece_library.decode(ids).encode()).hexdigest()

    for r in queries.op3_sentencepiece(spark, sf).collect():
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == want(texts[r.doc_id])
    model = queries.piece_model()
    got = sentencepiece_bpe.digests(odd, model, ["text"]).collect()
    assert all((r.n_tokens, r.ids_sha256, r.decoded_sha256) == want(r.text) for r in got)
    round_trip = sentencepiece_bpe.decode(sentencepiece_bpe.encode(odd.where("text IS NOT NULL"), model, ["doc_id", "text"]).withColumnRenamed("text", "t"), model, ["t"])
    assert all(r.t == r.text for r in round_trip.collect())
    assert sentencepiece_bpe.digests(empty, model, ["doc_id"]).count() == 0


def test_runs_of_spaces_and_long_chunks(piece_library):
    bpe = sentencepiece_bpe.Bpe(queries.piece_model())
    random.seed(5)
    for n in [*range(1, 80), 1000, 20_001]:
        for rest in ("", "x", "the", "日", "\n", " \nthe  end "):
            t = " " * n + rest
            assert bpe.encode(t) == [*piece_library.encode(t), 2]
    for letters in ("abcdefghijklmnop", "ACGT", "a", "日本語のテ", "QUJDREVGRw+/19", "-=_"):
        t = "".join(random.choices(letters, k=30_000))
        assert bpe.encode(t) == [*piece_library.encode(t), 2]


def test_memory_of_chunks_is_bounded_in_bytes():
    import tracemalloc

    bpe = sentencepiece_bpe.Bpe(queries.piece_model())
    bpe.memo_bytes = 1 << 18
    random.seed(6)
    letters = "abcdefghijklmnopqrstuvwxyz"
    tracemalloc.start()
    sizes = []
    for k in range(6):
        for _ in range(25):
            bpe.parts(" ".join("".join(random.choices(letters, k=random.choice((6, 60, 500)))) for _ in range(60)))
        bpe.pairs.clear()
        sizes.append(tracemalloc.get_traced_memory()[0])
    tracemalloc.stop()
    assert max(sizes[2:]) < 2 << 20


def test_repeated_rows_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "one two", "a"), (1, "one two", "a"), (2, None, "b")], "doc_id long, text string, token_ids string")
    got = sentencepiece_bpe.digests(docs, queries.piece_model(), ["doc_id", "token_ids", "text"]).collect()
    assert sorted((r.doc_id, r.n_tokens, r.token_ids) for r in got) == [(1, 3, "a"), (1, 3, "a"), (2, 1, "b")]
