import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, id int, data string, found string"


def edge_rows():
    """Nulls in every column, empty and long texts, repeated rows and ids, ties, columns named like inner ones."""
    rng = random.Random(11)
    words = lambda n: " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(n))
    base = words(120)
    texts = [None, "", " \n\t", "a", "é😀", base, base, base + " more", base.replace(" ", "  "), base.upper(), words(9000), "x" * 30_000, words(3), words(3)]
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else "s", None if t is None else len(t), "r", i, None, "f") for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (5, "another text of the same id", None, None, None, None, None, None, None)]
    return [*rows, (None, base, None, None, None, None, None, None, None), (None, "no id", "de", "s", 5, "", 1, "", ""), (None,) * 9]


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
