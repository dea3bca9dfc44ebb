import pytest

#: Nulls, empty and very long texts, ties, repeated rows, and columns with clashing names.
LONG = " ".join(f"w{i % 997}x{i % 13}" for i in range(30_000))
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog. " * 6),
    (2, "The quick brown fox jumps over the lazy dog. " * 6),
    (2, "Another text with the same id; it is not the same document at all."),
    (2, "Another text with the same id; it is not the same document at all."),
    (3, None),
    (4, ""),
    (5, " \n\t "),
    (None, "No id, but words: alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau."),
    (None, None),
    (6, LONG),
    (7, LONG + " " + LONG),
    (8, "é Ünïcode ß naïve — “quotes” 漢字 😀 text.\r\nNext\x0bline\x85 \u2028 end  "),
]


@pytest.fixture(scope="session")
def awkward(spark):
    rows = [(i, t, None if n % 3 else "en", None if n % 4 == 0 else "s", n, "x", "y") for n, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, matches string, score string")


@pytest.fixture(scope="session")
def nothing(spark, awkward):
    return awkward.limit(0)
