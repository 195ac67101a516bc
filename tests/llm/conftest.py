import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key long, n string, target string, size int, `a b` string"


def words(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edge_texts():
    """Nulls, empty and very long texts, ties, copies, near copies and shared passages."""
    rng = random.Random(5)
    base = words(rng, 120)
    other = words(rng, 90)
    passage = words(rng, 60)
    near = base.split()
    near[60] = "changed"
    part = lambda k: words(rng, k)
    texts = [
        None, "", "   \n\t ", "one", "one two three four", "Éa ñ ß 日本 😀", base, base, base.upper(), " ".join(near), other, other + " tail", base + "\n" + base,
        part(70) + " " + passage + " " + part(70), part(50) + "\n" + passage, "be " * 300, "!!! *** " * 40, "\n".join(["same line of words here"] * 30), words(rng, 30_000), "a\nb\nc", "c\nb\na",
    ]
    return texts + [part(rng.randrange(5, 200)) for _ in range(25)]


@pytest.fixture(scope="session")
def edge(spark):
    """The edge texts under distinct ids, with columns whose names clash with inner ones."""
    rows = [(i * 7, t, "en", None if i % 9 == 0 else f"s{i % 3}", len(t or ""), i, "x", "y", 1, "z") for i, t in enumerate(edge_texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def odd(spark, edge):
    """The edge table with a null id and repeated rows besides."""
    more = spark.createDataFrame([(None, "no id here but some text", None, None, 0, 1, "x", "y", 1, "z")], SCHEMA)
    return edge.union(more).union(edge.where("doc_id in (42, 56, 63)"))


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(i * 7, int(i % 4 != 0), int(i % 5 == 0)) for i in range(40)] + [(7, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
