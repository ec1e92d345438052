import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int, vocabulary: int = 3000) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" + rng.choice(["", "", "", ",", "é"]) for _ in range(n)]


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text): plain texts, exact and near copies, shared passages, junk, and odd cases."""
    rng = random.Random(3)
    texts: dict[int, str | None] = {k: " ".join(words(rng, rng.randrange(20, 400))) for k in range(60)}
    for k in range(60, 75):
        texts[k] = texts[rng.randrange(10)]
    base = words(rng, 300)
    for k in range(75, 110):  # near copies with different texts
        copy = list(base)
        for _ in range(rng.randrange(1, 8)):
            copy[rng.randrange(300)] = "x" + str(rng.randrange(99))
        texts[k] = " ".join(copy)
    shared = words(rng, 80)
    for k in range(110, 120):
        texts[k] = " ".join(words(rng, 90)) + "\n" + " ".join(shared) + "\n" + " ".join(words(rng, 60))
    for k in range(120, 140):
        texts[k] = " ".join(x + "###" for x in words(rng, 80)) if k % 2 else " ".join(["spam"] * 60 + ["eggs"] * 40)
    texts |= {200: None, 201: "", 202: " \n\t ", 203: "one", 204: "one", 205: "a b c d", 206: "\x00 \x85  ﬁ 🙂 <|endoftext|> ▁ x", 207: " ".join(words(rng, 40_000)), 208: "x" * 50_000}
    return texts


@pytest.fixture(scope="session")
def documents(spark, corpus):
    rows = [(k, t, "en", "s", len(t or "")) for k, t in corpus.items()]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def clashing(documents):
    """The same with columns named as the operators name theirs."""
    from pyspark.sql import functions as F

    names = ["score", "kept", "h", "doc", "label", "start", "end", "_cut", "ids", "width", "rep", "path", "bucket", "quality", "p", "u", "held_out", "block", "copies", "fan", "part"]
    return documents.withColumns({n: F.lit("clash") for n in names})


@pytest.fixture(scope="session")
def labels(spark, corpus):
    rows = [(k, int(not 120 <= k < 140), 0) for k, t in corpus.items() if t and k < 140]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
