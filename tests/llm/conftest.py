import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def invented(r: random.Random, n: int) -> str:
    return " ".join("".join(r.choice(["th", "an", "re", "on", "É", "ti", "in"]) for _ in range(r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with nulls, empty and wordless texts, copies, near copies, shared passages, repeated rows and one long text."""
    r = random.Random(7)
    base = [invented(r, r.randint(30, 90)) for _ in range(12)]
    passage = invented(r, 45)
    texts = [None, "", " \t\n", "One two", "one TWO", *base, base[0], base[0].upper().replace("É", "É"), base[1].replace("th", "TH")]
    for b in base[2:6]:
        words = b.split(" ")
        words[len(words) // 2] = "changed"
        texts.append(" ".join(words))
    texts += [f"{base[6]} {passage}", f"{passage} {base[7]}", f"x {passage} y\n{passage}", " ".join(["again"] * 70), invented(r, 6000)]
    out = [(i, t, "en", f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]
    return [*out, out[8], (None, "no id at all, but text", None, None, None)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
