"""Tables that the tests of this folder share."""

import sys
from pathlib import Path

import pytest

from hearth.llm import queries

sys.path.insert(0, str(Path(__file__).parent))

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "\n\n", "one", "A b\tc\x0bd\r\ne", "x " * 3000, "dup dup dup", "Ünïcödé 日本 😀\x00", "  lead and trail  ", "\nstart", "a \nb", "###$$$ %%%"]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, "en", "s" if i % 2 else None, len(t or "")) for i, t in enumerate(ODD)]
    rows += [rows[5], (None, "no id at all", None, "s", 1), (None, None, None, None, None)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(documents):
    return {r.doc_id: r.text for r in documents.collect()}


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def piece_library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=queries.piece_model())
