import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that operators use for their own columns
        T.StructField("score", T.StringType()),
        T.StructField("n_words", T.StringType()),
        T.StructField("kept", T.StringType()),
        T.StructField("ids", T.StringType()),
    ]
)


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a table of documents, with clashing extra columns, of (doc_id, text) pairs."""

    def make(rows):
        return spark.createDataFrame([(i, t, None, "src0", None if t is None else len(t), "x", "x", "x", "x") for i, t in rows], SCHEMA)

    return make


PROSE = "the quick brown fox jumps over the lazy dog while seven small birds sing in an old tree near our quiet river bank today"
ODD = [
    (1, PROSE),
    (2, None),
    (3, ""),
    (4, " \n\t\x0b\x0c\r "),
    (5, "one"),
    (6, PROSE),
    (6, PROSE),
    (None, PROSE),
    (7, "Ünïcödé ΟΔΟΣ 中文 \x1c x\xa0y <|endoftext|> 'S 12.5 " + PROSE.upper()),
    (8, " ".join(f"w{k % 977}" for k in range(30_000))),
    (-9, PROSE + " and a tail of other words that nobody else has written so far in this table of texts"),
    (10, "\n".join(["Menu | Home | Login | Help | About"] * 30)),
]


@pytest.fixture(scope="session")
def odd(documents):
    return documents(ODD)
