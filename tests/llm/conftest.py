import random

import pytest

LONG = " ".join(f"word{k}" for k in range(6000))


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows, clashing column names."""
    rng = random.Random(3)
    base = " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eins", "zwei", "día", "été", "x9"]) + str(rng.randint(0, 40)) for _ in range(80))
    near = base.replace(base.split()[40], "changed", 1)
    half = " ".join(base.split()[:40] + [f"other{k}" for k in range(40)])
    texts = [
        (1, base), (2, near), (3, base), (4, half), (5, None), (6, ""), (7, "  \n\t "), (8, "one two"), (9, "One TWO"), (10, LONG), (11, LONG + " tail"), (None, base), (13, base.upper()), (8, "one two"),
        (14, "Same line here again\nSame line here again\nother line"), (15, "same LINE here again!\n\nunique words stand here"), (16, " thin space\x1dend"), (17, "a"), (18, "!!! ***\n---"), (None, None),
    ]
    rows = [(i, t, "en" if (i or 0) % 2 else None, None if i == 3 else "src", 0, "clash", 1, 2) for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, row long, words string, n long, id long")


@pytest.fixture(scope="session")
def no_docs(spark, odd_docs):
    return spark.createDataFrame([], odd_docs.schema)
