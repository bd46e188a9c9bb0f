import random

import pytest

from banditflow.llm import near_dup  # noqa: F401  the folder goes together with the subpackage

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, score double, kept boolean, "
    "`_k` long, `_h` long, ids string, n_words long, body string, word string, rest string"
)


def rows_of(texts):
    """(doc_id, text) with columns whose names clash with the operators' own."""
    return [(d, t, None, "src0", None if t is None else len(t), 0.5, None, 1, 2, "x", 7, "b", "w", "r") for d, t in texts]


def nasty_texts():
    rng = random.Random(5)
    syllables = ["th", "on", "er", "in", "an", "ti", "é", "ß", "ou"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 5)))
    prose = lambda n: " ".join(word() for _ in range(n))
    base = prose(120)
    near = base.split(" ")
    near[60] = "CHANGED"
    shared = prose(60)
    texts = [
        (1, base), (2, base), (3, " ".join(near)), (4, base.upper()), (5, ""), (6, None), (7, "   \n\t "), (8, "one two"),
        (9, "one two"), (10, "a" * 5000), (11, "a" * 700 + " " + prose(30)), (12, prose(10) + " " + shared + " " + prose(10)),
        (13, shared + "\n" + prose(40)), (14, "ab" * 400), (15, prose(3000)), (16, "<|endoftext|> é 🙂 <|end"),
        (16, "another version of sixteen " + prose(20)), (17, prose(50)), (17, None), (None, prose(30)), (-3, prose(30)),
        (20, "." * 300 + "\n" * 300), (21, prose(45)), (22, " x y\u0085z"),
    ]
    return texts + [texts[16]]  # a row that repeats


@pytest.fixture(scope="session")
def texts():
    return nasty_texts()


@pytest.fixture(scope="session")
def nasty(spark, texts):
    return spark.createDataFrame(rows_of(texts), SCHEMA).repartition(4)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
