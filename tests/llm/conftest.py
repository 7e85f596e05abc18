import random

import pytest

SYLLABLES = "ba ke li mo nu ra se ti vo zu pla gre sto dru kin mel".split()


def prose(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(n)]


@pytest.fixture(scope="session")
def odd_texts() -> list[str | None]:
    """Empty, blank, short, non-ASCII, repeated and very long texts."""
    rng = random.Random(5)
    long = " ".join(prose(rng, 60_000))
    return [
        None, "", " \n\t", "one", "one two", "Straße café 北京 naïve – “x” y z", "a\x0bb\x0cc\x1dd\r\ne", "the cat sat " * 40,
        "line one here\nline two\nline one here\n\nline one here", "MIT License and the GNU General Public License, version 3", "x" * 5000, long, long + " end",
        "don't can't 1,234.5 foo_bar\n\n\nA  B   C", "<s>[INST] odd </s> <|endoftext|> 🎉🎉", "one two",
    ]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_texts):
    """Those texts with null, repeated and clashing columns around them."""
    rows = [(i, t, None, "x", i) for i, t in enumerate(odd_texts)] + [(None, "no id at all", None, None, None), (3, "one", None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, words string, n int")


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string")
