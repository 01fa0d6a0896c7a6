import zlib

import pytest

#: Words and how near copies differ, for small tables of documents.
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table from (id, text) pairs, with columns whose names clash with the operators' own."""

    def make(rows):
        full = [(i, t, "en", "s", len(t or ""), "x", 1, 2.0) for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, node string, n long, size double")

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty, blank, repeated, tied and very long texts."""
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    return [(1, None), (2, ""), (3, " \n\t "), (4, "one two three four five six seven"), (5, "one two three four five six seven"), (5, "one two three four five six seven"), (6, "short"), (7, long), (None, "one two three four five six seven"), (None, "a text of its own without an id"), (8, "naïve café Ünïcode " * 3), (9, "<|endoftext|> x")]


@pytest.fixture(scope="session")
def fold():
    return lambda i, n: zlib.crc32(str(i).encode()) % n
