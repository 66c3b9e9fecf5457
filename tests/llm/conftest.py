import pytest

SMALL = "/root/testdata/sf0.001"

LONG = " ".join(f"w{i % 977}{'.' if i % 11 == 0 else ''}" for i in range(60_000))
PLAIN = " ".join(f"word{i}" for i in range(80))
ROWS = [
    (1, None, "en", "a", None),
    (2, "", "en", "a", 0),
    (3, " \t\n\x0b\x0c\r ", "de", None, 7),
    (4, PLAIN, None, "b", len(PLAIN)),
    (4, PLAIN, None, "b", len(PLAIN)),
    (5, PLAIN, "fr", "b", len(PLAIN)),
    (None, PLAIN + " more", "fr", "c", 5),
    (None, None, None, None, None),
    (6, LONG, "en", "c", len(LONG)),
    (7, "Über größe   naïve 中文 😀 a@b.co +49 30 1234567", "de", "c", 3),
    (8, "one two three", "en", "a", 13),
    (9, "same " * 200, "en", "a", 1000),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns named like the operators' own."""
    docs = spark.createDataFrame(ROWS, SCHEMA)
    extra = ["n_words", "size", "block", "score", "key", "row", "k1", "k2", "word", "n", "taken", "target", "kept", "held_out", "root", "set"]
    extra += ["_row", "_size", "_draws", "_d", "_k1", "_k2", "_hash", "_number", "_text", "_s", "fingerprint", "shard", "copy", "place", "a.b"]
    return docs.selectExpr("*", *[f"'x' AS `{name}`" for name in extra])


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}
