"""Every operator and stage on a text of two million characters beside short ones."""

import hashlib
import random

import pytest
from brute import brute_quality, brute_simhash
from pyspark.sql import functions as F

from hearth.llm import decontaminate, hmm_lm, html_extract, line_dedup, quality, queries, sentencepiece_bpe, simhash, substring_dedup, token_counts, warc


@pytest.fixture(scope="module")
def long_text():
    rng = random.Random(8)
    return "\n".join(" ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(12)) for _ in range(27_000))


@pytest.fixture(scope="module")
def docs(spark, long_text):
    part = " ".join(long_text.split()[200_000:200_080])
    rows = [(1, "short " + part, "en", "s", 0), (2, long_text, "en", "s", len(long_text)), (3, "a b c", "en", "s", 5)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_operators(spark, docs, long_text, piece_library):
    assert len(long_text) > 2_000_000
    found = substring_dedup.substring_dedup(docs).collect()
    assert [(r.doc_id, r.rep_doc_id, r.start_word) for r in found] == [(2, 1, 200_000)]
    assert {r.doc_id: r.n_lines for r in line_dedup.line_dedup(docs).collect()}[2] == 27_000
    ids = [*piece_library.encode(long_text), 2]
    got = {r.doc_id: r for r in sentencepiece_bpe.digests(docs, queries.piece_model(), ["doc_id"]).collect()}[2]
    assert (got.n_tokens, got.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
    bench = spark.createDataFrame([(7, " ".join(long_text.split()[300_000:300_050]))], "item_id long, text string")
    assert [(r.doc_id, r.item_id, r.covered_tokens) for r in decontaminate.leaks(docs, bench).collect()] == [(2, 7, 50)]
    q = {r.doc_id: r for r in quality.quality(docs, ["doc_id"]).collect()}[2]
    assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words, q.base_failed) == brute_quality(long_text)
    scored = {r.doc_id: r for r in hmm_lm.hmm_scores(docs, F.lit(False)).collect()}
    assert scored[2].n_tokens == len(long_text.split()) + 1 and scored[2].score < 0
    fp = {r.doc_id: r.fingerprint for r in simhash.simhash_groups(docs).collect()}[2]
    assert int(fp, 16) == brute_simhash(long_text)


def test_flat_tokens_and_pages(spark, docs, long_text):
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = f.read()
    want = len(token_counts.encoder(ranks, public_tokenizers.PATTERN).encode_ordinary(long_text))
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, ranks, public_tokenizers.PATTERN, block_tokens=4096).collect()}
    assert got[2] == want and got[3] == 3
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("http://a.example/").alias("url"), F.concat(F.lit("<nav>menu</nav><article><p>"), F.replace("text", F.lit("\n"), F.lit("</p><p>")), F.lit("</p></article>")).alias("html"))
    assert {r.page_id: r.text for r in html_extract.html_text(pages).collect()}[2] == long_text
    assert {r.page_id: r.payload_bytes for r in warc.read_back(warc.archive(pages)).collect()}[2] == len(long_text) + 6 * 26_999 + len("<nav>menu</nav><article><p></p></article>")


def test_stages(spark, sf, docs):
    import corpus_pipeline

    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        assert 2 in {r.doc_id for r in stage(spark, docs, sf).select("doc_id").collect()} or k == 0
