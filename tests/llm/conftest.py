import random

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, cls long, key string, score double, spans string, id string"


def frame(spark, rows):
    """Documents (doc_id, text[, lang, source]) with columns whose names the operators use inside."""
    full = [
        (r[0], r[1], *(r[2:] or ("en", "web")), None if r[1] is None else len(r[1]), 7, "k", 0.5, "s", "x")
        for r in rows
    ]
    return spark.createDataFrame(full, DOCUMENTS)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, white space of all kinds, ties and repeated rows."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    body = [rng.choice(words) for _ in range(90)]
    near = [*body]
    near[40] = "other"
    long = [rng.choice(words) for _ in range(20_000)]
    shared = [rng.choice(words) for _ in range(40)]
    text = " ".join(body)
    return [
        (1, text), (2, text), (2, text), (3, " ".join(near)), (4, None), (5, ""), (6, " \t\n\x0b\x0c\r "), (7, "one two"),
        (8, "One  TWO"), (9, " ".join(long)), (10, " ".join(long[:9_000] + ["x"] + long[9_000:])),
        (11, " ".join([*"abcdefghij", *shared])), (12, " ".join([*shared, *"klmnopqrst"])), (None, text), (None, None),
        (13, "café 日本語 ▁ \U0001f600  nbsp"), (14, "a" * 5_000), (15, "same line\nsame line\nsame line"),
        (16, "same line\nsame line\nsame line", None, None),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return frame(spark, odd_rows)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
