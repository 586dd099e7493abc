import duckdb
import pytest

#: Nulls, empties, ties, repeated rows, long texts, and columns whose names the operators use themselves.
TEXTS = [
    None,
    "",
    " \t\n",
    "Hest thou ereaat.",
    "Hest thou ereaat.",
    "one two three one two three one two three one two three",
    "don't stop <|endoftext|> now İstanbul Straße naïve été 42 &&&\nsame line\nsame line\n\n",
    "a b c \x1cd \x85e ẍ zz\x0bq\x0cw",
    " ".join(f"w{i % 97}" for i in range(400)),
    " ".join(f"w{i % 97}" for i in range(400)) + " tail differs here",
    "\n".join(f"line {i} has seven words in it now" for i in range(60)),
    "\n".join(f"line {i} has seven words in it now" for i in range(30, 90)),
    "x" * 5000,
    "lead " + " ".join(f"long{i}" for i in range(20000)),
]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Small documents with every oddity, plus clashing extra columns."""
    rows = [(i, t, None if i % 5 == 4 else f"src{i % 3}", 0.5, "x", i) for i, t in enumerate(TEXTS)]
    rows += [(3, TEXTS[3], "src0", 0.5, "x", 3), (None, "an id that is null", "src1", None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, score double, _text string, component_id long")


@pytest.fixture(scope="session")
def empty_docs(odd_docs):
    return odd_docs.where("false")


@pytest.fixture()
def duck():
    return duckdb.connect()


@pytest.fixture(scope="session")
def small_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
