import random

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()), StructField("n_chars", LongType()), StructField("_id", StringType()), StructField("fp", StringType())])


def odd_rows():
    """Nulls in every column, empty, blank and very long texts, repeated rows, ties of ids, shared passages and near copies."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7)))
    passage = " ".join(word() for _ in range(70))
    texts = [None, "", " \n\t ", "one", "two words", " ".join(word() for _ in range(9000)), "spam " * 300, "spam " * 290 + "eggs"]
    base = [word() for _ in range(300)]
    for k in range(12):
        near = list(base)
        for _ in range(k):
            near[rng.randrange(300)] = word()
        texts.append(("\n" if k % 2 else " ").join(near))
    texts += [f"{' '.join(word() for _ in range(30))}\n{passage}\n{' '.join(word() for _ in range(20))}" for _ in range(5)]
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 4 == 0 else f"s{i % 3}", None if t is None else len(t), "x", None) for i, t in enumerate(texts)]
    rows += [rows[10], rows[10], (10, "another text of the same id", "en", "s1", 27, None, "y"), (None, passage, None, None, None, None, None), (None, texts[9], None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, None) for i in range(0, 25)] + [(None, 1, 0), (3, None, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
