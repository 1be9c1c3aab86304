import random

import pytest

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, score double, dropped string, rep long, shard int"


def sentence(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, ties, repeated rows; columns whose names clash with inner ones."""
    rng = random.Random(7)
    long = sentence(rng, 60_000)
    base = sentence(rng, 80)
    texts = [None, "", " \n\t\n ", "one", "four words are here", base, base, base + " more words than before here", base.upper() + "!", long, "Ünïcode — ﬁn\x00   x\r\ny", "a\n\na\nA \nb", "x" * 50_000, "|".join(["z"] * 300)]
    texts += [sentence(rng, rng.randrange(5, 60)) for _ in range(25)]
    rows = [(i, t, ("en", "de", None)[i % 3], ("s1", "s2", None, "")[i % 4], len(t) if t else None, 0.5, "x", 1, 2) for i, t in enumerate(texts)]
    rows += [rows[5], rows[9], rows[1]]
    rows.append((None, "a row without an id that has some words", "en", "s1", 5, None, None, None, None))
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCUMENTS).repartition(3).cache()


@pytest.fixture(scope="session")
def no_rows(spark):
    return spark.createDataFrame([], DOCUMENTS)
