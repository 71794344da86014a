"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, hmm_lm, html_extract, line_dedup, neighbours, quality, sentencepiece_bpe, simhash, substring_dedup, token_counts, vector_codes, warc, whitening
from .shared import apart, reopened, table


def piece_model(path: str | None = None) -> bytes:
    """The SentencePiece model file, by default the installed 32k one."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents", "doc_id", "text"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "text", "n_lines", "n_dropped")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.digests(table(spark, sf_dir, "documents", "doc_id", "text"), piece_model(), ["doc_id"], memo_bytes=128 << 20)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = quality.Rules()
    rows = quality.quality(table(spark, sf_dir, "documents", "doc_id", "text"), ["doc_id"], rules=rules)
    return rows.select(*[c for c in rows.columns if c != "dup_ngram_chars"], *[F.element_at("dup_ngram_chars", i + 1).alias(f"dup_{n}gram_chars") for i, (n, _) in enumerate(rules.ngrams)])


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = f.read()
    return token_counts.token_counts(table(spark, sf_dir, "documents", "doc_id", "text"), ranks, public_tokenizers.PATTERN)


def op7_hmm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    return hmm_lm.hmm_scores(table(spark, sf_dir, "documents", "doc_id", "text"), held_out)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents", "doc_id", "text"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.html_text(table(spark, sf_dir, "pages"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    # what a table was shuffled by is deleted as soon as it is written, so that payloads lie in one shuffle at a time beside their table
    own = apart(spark, **{"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"})
    made = warc.archive(table(own, sf_dir, "pages"))
    return warc.read_back(warc.Archive(reopened(made.payloads, spark), reopened(made.headers, spark)))


def op11_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.neighbours(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), lambda i: i % 20 == 0)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whitening(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    return rows.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_substring_dedup, op2_line_dedup, op3_sentencepiece, op4_decontamination, op5_quality, op6_token_counts, op7_hmm_lm, op8_simhash, op9_html_text, op10_warc, op11_neighbours, op12_whitening, op13_vector_codes)
}
ORACLES: dict[str, str] = {"op2_line_dedup": line_dedup.ORACLE_SQL, "op5_quality": quality.oracle(), "op10_warc": warc.ORACLE_SQL, "op13_vector_codes": vector_codes.ORACLE_SQL}
