"""Small tables: the given documents, and rows that are awkward."""

from __future__ import annotations

from pathlib import Path

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def given():
    if not Path(SF).exists():
        pytest.skip("the given tables are not here")
    return SF


@pytest.fixture(scope="session")
def texts(given):
    import pyarrow.parquet as pq

    table = pq.read_table(f"{given}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    return dict(zip(table["doc_id"], table["text"], strict=True))


SHARED = "this line stands in many documents of the table"
SECRET = 'api_key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"'
AWKWARD = [
    (1, None, None), (2, "", "en"), (3, " \t\r\n ", "xx"), (4, SHARED, "en"), (5, SHARED, "en"), (5, SHARED, "en"),
    (6, f"{SHARED.upper()}  \nshort\nshort\n" + "x" * 70_000, "de"), (7, "one two three", "en"), (8, "one two three", None),
    (9, "\U0001f600 é́ Σσς İ <|endoftext|> <|startoftext|>  a\x1cb \x85 　 z \n\n\n end", "fr"),
    (10, f"before {SECRET} after", "en"), (None, "a row without an id\n" + SHARED, "en"), (None, None, None),
    (11, " ".join(f"word{i}" for i in range(30_000)), "en"), (12, " ".join(f"word{i}" for i in range(30_000)) + " more", "en"),
    (13, "y" * 3000 + " " + "again and again " * 400, "es"),
]
# Further columns whose names the operators use themselves.
CLASHING = ["kept", "line", "pos", "block", "rep", "length", "sequence_id", "spans", "class_id", "features", "n_words", "__other"]


@pytest.fixture(scope="session")
def awkward(spark):
    schema = "doc_id long, text string, lang string, " + ", ".join(f"{c} string" for c in CLASHING)
    rows = [(*row, *["clash"] * len(CLASHING)) for row in AWKWARD]
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def empty(awkward):
    return awkward.where("false")
