import random

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def make(spark):
    def build(rows, schema):
        return spark.createDataFrame(rows, schema)

    return build


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty texts, ties, repeated rows, white space of all kinds."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(40)]
    long = " ".join(rng.choice(words) for _ in range(4000))
    base = "\n".join(" ".join(rng.choice(words) for _ in range(rng.randint(3, 30))) for _ in range(12))
    return [
        (1, base, "s1"), (2, base, "s1"), (2, base, "s1"), (3, None, "s2"), (4, "", None), (None, base + " end", "s2"), (5, long, "s2"), (6, " \t\n \x0b", "s1"),
        (7, base.replace("w7", "w8", 1), "s1"), (8, "one", "s3"), (9, "one two", "s3"), (10, "a\n\n b  c\té x \n", "s1"), (11, base[:200] + "\n\n" + base[200:], "s1"), (None, None, None),
    ]
