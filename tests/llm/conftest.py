import pytest

WORDS = "the of and der die und la que en un house tree Haus Baum maison arbre casa árbol".split()


def sentence(n, k=0):
    return " ".join(WORDS[(i * i + 3 * i + k) % len(WORDS)] + ("" if i % 7 else str((i * k) % 11)) for i in range(n))


@pytest.fixture(scope="session")
def tricky(spark):
    """Nulls in every column, empty and blank texts, a very long text, ties, repeated rows and clashing names."""
    long_text = sentence(30_000, 5)
    rows = [
        (1, sentence(60), "en", "b", 1), (2, sentence(60), "en", "b", 2), (2, sentence(60), "en", "b", 2), (3, sentence(25, 1), "de", "a", None),
        (4, None, "fr", None, 4), (5, "", None, "c", 5), (6, " \t\n\x0b ", "es", "c", 6), (None, sentence(40, 2), "en", "b", 7),
        (None, sentence(40, 2), None, None, 7), (8, long_text, "fr", "a", 8), (9, "x", "", "", 9), (9, "y\u00a0z  \u2028 é", "es", "", 9),
        (100, sentence(60) + " tail", "en", "b", 10), (200, "Äöü ß 123 !!! <|endoftext|> don't", "de", "é", 11),
    ]
    names = "doc_id long, text string, lang string, source string, n_chars long"
    extra = "size int, key string, fp long, idx int, block int, word string, `a.b` int, seq int, items string, row string, _fp int, start long"
    return spark.createDataFrame([(*r, 1, "k", 7, 3, 5, "w", 9, 2, "i", "r", 1, 4) for r in rows], f"{names}, {extra}")


@pytest.fixture(scope="session")
def nothing(spark, tricky):
    return spark.createDataFrame([], tricky.schema)
