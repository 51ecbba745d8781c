import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    # names that operators might use inside
    + [T.StructField(c, T.StringType()) for c in ("id", "key", "block", "bucket", "sig", "score", "label", "family", "comp", "mix_topic", "at")]
)


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(rows):
        """rows: (doc_id, text[, lang[, source]])"""
        full = []
        for r in rows:
            r = (*r, *[None] * (4 - len(r)))
            full.append((*r, len(r[1]) if r[1] is not None else None, *["x"] * (len(SCHEMA) - 5)))
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture(scope="session")
def awkward():
    """Null ids and texts, blanks, repeated rows, ties and a very long text."""
    long = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
    return [
        (1, None, "en", "s"), (2, "", "en", None), (3, " \n\t ", None, "s"), (4, "one two", "en", "s"), (5, "one two", "en", "s"), (5, "one two", "en", "s"),
        (None, "one two three four five", None, None), (None, None, None, None), (7, long, "en", "hot"), (8, long, "en", "hot"), (9, "ÀÉ ünï 你好 \U0001f600 mixed", "fr", "hot"),
    ]


SF = "/root/testdata/sf0.001"
