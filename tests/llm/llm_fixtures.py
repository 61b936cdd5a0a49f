import pytest

SF = "/root/testdata/sf0.001"
DOC_SCHEMA = "doc_id long, text string, source string, row string, own string, text_key long"


def words(prefix: str, n: int) -> str:
    return " ".join(f"{prefix}{k}" for k in range(n))


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents of (doc_id, text) pairs, with more columns whose names the operators use themselves."""

    def made(rows):
        full = [(d, t, f"s{k % 7}", "x", "y", 3) for k, (d, t) in enumerate(rows)]
        return spark.createDataFrame(full, DOC_SCHEMA).repartition(3)

    return made


@pytest.fixture(scope="session")
def edge_rows():
    long_text = words("long", 30_000)
    return [
        (None, "a document without an id has some words in it"),
        (1, None),
        (2, ""),
        (3, " \t\n"),
        (4, "Four little words here"),
        (5, words("w", 60)),
        (6, words("w", 60)),
        (6, words("w", 60)),
        (7, words("W", 60) + " extra"),
        (8, long_text),
        (9, "ünïcödé İstanbul Σίσυφος 你好 🎉 don't <|endoftext|> end"),
        (10, "x" * 30_000),
    ]
