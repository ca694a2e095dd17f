"""Fixtures of the training-data operators' tests: small odd tables, and the smallest test tables."""

import duckdb
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf_dir():
    return SF


@pytest.fixture(scope="session")
def documents():
    """(doc_id, text, lang) rows of the smallest table, by id."""
    return duckdb.sql(f"select doc_id, text, lang from '{SF}/documents.parquet' order by doc_id").fetchall()


LONG = "a very long text of words " * 6000
ODD = [
    (1, None), (2, ""), (3, "   \n\t"), (4, "one"), (5, "one"), (6, LONG), (7, LONG + "tail"), (8, "ÄÖÜ ß é 漢字 😀 " * 10),
    (9, "one two three four five six seven"), (9, "one two three four five six seven"), (None, "one two three four five six seven"),
    (10, "Permission" * 30), (11, "\x00\x01 control"), (12, "!!! ??? 123"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, a null id, and extra columns whose names clash with results."""
    rows = [(i, t, "x", "und", 0.5, 7, "clash") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, score double, block long, classes string")


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, quality int")
