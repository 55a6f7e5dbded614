import pytest

ODD = ["", None, " \t\n", "one", "a b", "a  b", "x" * 5000, "\x0b\x0cA a\rB b", "word " * 400,
       "été ñandú 漢字 \U0001f600 naïve", "l1 a\nl1 a\nl2 b\nl1 a", "# $ % & | < > *"]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and
    extra columns named like the operators' own."""
    long = " ".join(f"w{i}" for i in range(3000))
    texts = [*ODD, long, long, long + " tail", long.upper()]
    rows = [(i, t, ["s1", "s2", None][i % 3], True, 5, "h") for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, "one", "s1", None, None, None), (None, None, None, None, None, None),
             (100, "one", None, None, None, None), (3, "another text of id three", "s2", None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, kept boolean, size int, h string")


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.filter("false")
