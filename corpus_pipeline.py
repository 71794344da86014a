"""A corpus pipeline over `documents`: quality rules, line de-duplication, near-duplicates, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame, which is written as
Parquet and read again as the next stage's docs.  All but the last keep the
columns of documents, in their order, whatever else a table may hold.

Cases.  Null columns: a null text has no words, so the first stage rejects it; a
null source is a host of its own; a null doc_id is no candidate for a group's name
and stays.  Empty texts are rejected by the first stage too.  Very long texts cost
memory in proportion to their length in every stage.  Ties: of a group of near
copies the least doc_id stays, of rows that repeat it the first by the hash of the
text.  Repeated rows therefore leave one row.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth.llm import decontaminate, line_dedup, quality, sentencepiece_bpe, simhash
from hearth.llm.queries import piece_model
from hearth.llm.shared import dropped, table, written
from hearth.sources.readers import spread


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return quality.filtered(docs)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their source's boilerplate lines; n_chars follows the text."""
    cleaned = line_dedup.line_dedup(docs)
    return cleaned.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8 or more), that with the least doc_id."""
    return simhash.one_of_alike(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, and the digests of the ids and of the text decoded from them."""
    return sentencepiece_bpe.digests(docs, piece_model(), ["doc_id", "lang", "source"])


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", drop_boilerplate),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("SentencePiece encoding and decoding", encoded),
]

#: Fingerprints, tiling and encoding have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is a table in the shared folder."""
    docs = spread(table(spark, sf_dir, "documents"), "doc_id")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, written(stage(spark, docs, sf_dir), f"stage{k + 1}")
        if k:
            dropped(before)
    return docs
