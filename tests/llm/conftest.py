import os

import pytest


@pytest.fixture(scope="session")
def word_bpe():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


@pytest.fixture(scope="session")
def byte_bpe():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


#: Nulls, empty and blank texts, ties, repeated rows and ids, characters beyond the first plane and a long text.
TEXTS = [None, "", " \n\t ", "one", "a b c", "a b c", "the same text, twice over, as it is", "the same text, twice over, as it is", "naïve café 😀 mail me@x.example.org or +1 (222) 333-4444", "word " * 400, "x" * 5000, "lines\nlines\n\nlines\nend", "10.0.0.1 and 4111 1111 1111 1111"]


@pytest.fixture(scope="session")
def docs(spark):
    rows = [(i, t, "en", None if i % 5 == 0 else f"s{i % 3}", None if t is None else len(t), i) for i, t in enumerate(TEXTS)]
    rows += [(3, "one", "en", "s0", 3, 1), (None, "no id", None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, size long")


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")


@pytest.fixture(scope="session")
def sample(spark):
    """The smallest documents table, if it is there."""
    path = "/root/testdata/sf0.001/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test data")
    return spark.read.parquet(path)
