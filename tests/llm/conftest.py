import random

import pytest

EXTRA = ["n_words", "score", "predicted", "row", "shard", "slot", "h", "d", "th", "part", "k",
         "piece", "c0", "node", "failed_bits", "labels", "_text", "rank"]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(
        "".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 6))) for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """Null ids and texts, empty and blank texts, repeated rows and texts, a long text."""
    rng = random.Random(3)
    same, near = prose(rng, 120), prose(rng, 150)
    rows = [
        (None, "no id"), (None, None), (1, None), (2, ""), (3, " \t\n \x0b"), (4, prose(rng, 9000)),
        (5, same), (5, same), (5, same), (6, same), (7, near), (8, near + " end"), (9, "a b"),
        (10, "</s>[INST] <|endoftext|> ▁ 汉字 \U0001f600 ok"), (5, "another text of the same id"),
    ]
    return rows + [(20 + i, prose(rng, rng.randint(3, 80))) for i in range(30)]


@pytest.fixture(scope="session")
def edge_docs(spark, edge_rows):
    """The rows with further columns whose names the operators use themselves."""
    frame = spark.createDataFrame(edge_rows, "doc_id bigint, text string").repartition(4)
    return frame.selectExpr("doc_id", "text", *[f"'x' AS `{c}`" for c in EXTRA]).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id bigint, text string")
