import pytest
from pyspark.sql import Row

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """Makes a documents table of (doc_id, text) pairs, with extra columns whose names could clash."""
    def make(rows, columns=None):
        made = [Row(doc_id=i, text=t, lang="en", source="s", n_chars=len(t or ""), text_=1, _key=2, shard=3) for i, t in rows]
        return spark.createDataFrame(made, DOCS + ", text_ int, _key int, shard int")
    return make


ODD = [(0, None), (1, ""), (2, " "), (3, "a  b"), (4, "a   b "), (5, " lead"), (6, "x\n  y\t z"), (7, "it's the dog's 'll 12  3"),
       (8, "日本語 テスト é ü"), (9, "\U0001f600 a‍ b c  d"), (None, "no id"), (3, "a  b"), (10, "word " * 30000),
       (11, "x" * 5000), (12, "a\x1c b \x1cc 　 z"), (13, "<|endoftext|> it")]


@pytest.fixture
def odd():
    return list(ODD)
