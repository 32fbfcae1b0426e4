import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, TEXT_ string, line string, cell string, _0 string, k1 string, cut string, k string, kept string, h string"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
LONG = " ".join(f"word{i % 977}{chr(97 + i % 26)}" for i in range(30_000))
TEXTS = [
    (1, "A plain line of text.\nAnother line of it."),
    (2, None),
    (3, ""),
    (4, " \n\n\t"),
    (5, LONG),
    (6, "x" * 50_000),
    (7, "same words here again and again in this text of ours"),
    (8, "same words here again and again in this text of ours"),
    (8, "same words here again and again in this text of ours"),
    (None, "a text whose id is missing, write to me.1@mail.example.com"),
    (None, None),
    (9, "日本語 😀 ▁ é ́ \x00 end"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns whose names clash."""
    rows = [(i, t, [None, "en", "de"][n % 3], [None, "s1", "s2"][n % 3], None, "x", "y", "z", None, "k", "c", "k", "kept", "h") for n, (i, t) in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, SCHEMA)
    # A second column that differs by case only.
    return df.toDF(*[n if n != "TEXT_" else "TEXT" for n in NAMES])


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
