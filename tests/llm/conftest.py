import pytest

LONG = " ".join(f"word{i % 977} again" for i in range(20_000))

ROWS = [  # id, text, source; other columns have names that operators use themselves
    (1, "The quick brown fox jumps over the lazy dog near the old river bank today", "a"),
    (2, "The quick brown fox jumps over the lazy dog near the old river bank today", "b"),
    (2, "The quick brown fox jumps over the lazy dog near the old river bank today", "b"),
    (3, "", "a"), (4, None, None), (5, " \t\n", "a"), (6, LONG, "b"), (7, "one two three", None),
    (None, "The quick brown fox jumps over the lazy dog near the old river bank today", "a"),
    (None, "nobody knows this text but it has quite enough words to be kept all the same", "c"),
    (None, None, None), (8, "Été   naïve \U0001f600\u0000 x", "c"), (9, "A!! B!! C!! D!! E!! F!! G!! H!! I!! J!! K!!", "c"),
]
SCHEMA = """doc_id long, text string, source string, score double, labels string, kept boolean, n_words long, size long, target double,
    doc string, key string, component long, n long, text__ string, words__ string, judged__ string, size__ long, times__ long, goes boolean,
    toxicity__ double, out__ long"""


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with null ids and texts, empty and long texts, repeated rows, and clashing column names."""
    width = len(SCHEMA.split(",")) - 3
    return spark.createDataFrame([(*r, *[None] * width) for r in ROWS], SCHEMA)


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("1 = 0")
