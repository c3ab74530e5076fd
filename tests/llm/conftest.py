from __future__ import annotations

import pytest
from conftest_llm import changed, words
from pyspark.sql import types as T

#: Extra columns whose names the operators use themselves.
CLASHING = ("row", "node", "key", "size", "__row", "__id", "__spans", "__taken", "start", "text_md5")

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        *[T.StructField(c, T.StringType()) for c in CLASHING],
    ]
)


@pytest.fixture(scope="session")
def hostile() -> list[tuple]:
    """Documents (doc_id, text, lang, source): nulls, empty and long texts, ties, repeated rows."""
    base, long_text = words(120, 1), words(20_000, 2)
    return [
        (1, base, "en", "b"),
        (2, base, "en", "a"),
        (2, base, "en", "a"),
        (3, changed(base, 60), None, None),
        (4, None, "en", "a"),
        (5, "", None, "b"),
        (6, " \n\t ", "fr", "c"),
        (None, base, "fr", "c"),
        (None, None, None, None),
        (7, long_text, "en", "a"),
        (8, long_text + " tail", "en", "a"),
        (9, "one two", "de", "b"),
        (10, "ONE two", "de", "é"),
        (11, "x" * 50_000, "de", "é"),
        (12, words(150, 5) + " mail a.b@c.example.org or 10.0.0.1 or 4111 1111 1111 1111 or +1 (555) 123-4567 end", "en", "a"),
        (13, words(150, 6) + ' password = "hunter2hunter2x" AKIA' + "ABCDEFGHIJ1234567 " + "0123456789abcdef0", "en", "z"),
        (14, "a😀b é password:abcdefghijkl+ 😀", "en", "z"),
    ]


@pytest.fixture(scope="session")
def tables(spark, tmp_path_factory):
    """Writes a folder of tables: documents (and labels, pages) from plain rows."""

    def make(documents=(), labels=(), pages=()) -> str:
        folder = str(tmp_path_factory.mktemp("tables"))
        rows = [(i, t, lang, s, len(t) if t is not None else None, *["x"] * len(CLASHING)) for i, t, lang, s in documents]
        spark.createDataFrame(rows, DOCUMENTS).repartition(3).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, payload string").repartition(2).write.parquet(f"{folder}/pages.parquet")
        return folder

    return make
