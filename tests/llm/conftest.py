import pytest

EXTRA = "score double, h long, e long, v long, n long, row long, ranges string, failures long, kept boolean, _text string, _k long, _id long, _doc string"


@pytest.fixture(scope="session")
def documents(spark):
    """Build a documents table from (doc_id, text); every other column has a name that operators use themselves."""

    def build(rows, extra=True):
        schema = "doc_id long, text string, lang string, source string, n_chars long" + (", " + EXTRA if extra else "")
        width = EXTRA.count(",") + 1 if extra else 0
        return spark.createDataFrame(
            [(i, t, "en" if i is None or i % 2 else None, None, None if t is None else len(t), *[None] * width) for i, t in rows], schema
        )

    return build


LONG = " ".join(f"word{i % 4001} and{i % 17}" for i in range(60_000)) + " " + "x" * 50_000

MESSY = [
    (1, None),
    (2, ""),
    (3, " \n\t\x0b\r\n "),
    (None, "a row without a key"),
    (4, "one two"),
    (5, "repeated row of exactly these few words here"),
    (5, "repeated row of exactly these few words here"),
    (6, "repeated row of exactly these few words here"),
    (7, LONG),
    (8, "É" * 300 + " ünïcode 日本語 \U0001f600"),
    (9, "no idiot <|endoftext|> here"),
    (10, "ab" * 400),
]


@pytest.fixture(scope="session")
def messy():
    return MESSY
