import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty, tiny and very long texts, ties and repeated rows."""
    rng = random.Random(3)
    long = words(rng, 30_000)
    base = words(rng, 300)
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \t\n ", None, "a", 3), (4, "one", "en", None, 3), (5, "One  two\nthree", "fr", "b", 14),
        (6, long, "en", "a", len(long)), (7, base, "en", "a", len(base)), (8, base, "en", "b", len(base)), (8, base, "en", "b", len(base)),
        (9, base + " tail", "en", "b", 0), (None, base, "en", "b", None), (None, None, None, None, None), (10, "é Ünï Œuvre cœur ΑΣ Σας 日本語 😀 ½ don't WE'LL x's", "de", "c", None),
        (11, "# $ % & | < >\nrepeat me now please\nrepeat me now please", "en", "é", 1), (12, "a b c d e a b c d e f g h i j", "en", "c", 1), (13, "x" * 20_000, "en", "c", 1),
    ]
    rows += [(100 + i, words(rng, rng.randint(1, 80)), rng.choice(["en", "fr", None]), rng.choice(["a", "a", "b", "c", None]), 5) for i in range(120)]
    return rows


@pytest.fixture
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture
def clashing(odd):
    """More columns, with names that operators use themselves."""
    from pyspark.sql import functions as F

    names = "fp node rank place slot grp size shard total block row src mix p key h lost keeper length piece start offset d2 lines __kept2 role part".split()
    return odd.withColumns({n: F.lit("clash") for n in names})


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
