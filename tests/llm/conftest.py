import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=4000):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def table(spark, rows):
    """documents from (doc_id, text)."""
    return spark.createDataFrame([(i, t, "en", f"src{(i or 0) % 3}", None if t is None else len(t)) for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def corpus():
    """Random documents with exact copies, near copies and shared passages."""
    rng = random.Random(5)
    docs = [words(rng, rng.choice((3, 20, 80, 200, 400))) for _ in range(60)]
    docs += [list(docs[k]) for k in (1, 1, 5, 9)]
    for k in range(12):  # near copies of some long ones, edited more and more
        near = list(docs[2 * k])
        for _ in range(max(1, len(near) * (k + 1) // 120)):
            near[rng.randrange(len(near))] = "edit"
        docs.append(near)
    passage, long_one = words(rng, 55), words(rng, 120)
    for k in range(6):
        docs.append(words(rng, 40) + passage + words(rng, 30 + k))
        docs.append(words(rng, 10) + long_one[k : 110 + k] + words(rng, 15))
    docs.append(passage[:49])
    return [(k, (" " if k % 2 else "\n").join(d)) for k, d in enumerate(docs)]


@pytest.fixture(scope="session")
def odd_rows():
    """Null ids and texts, empty and blank texts, repeated rows, ties, a long text."""
    long_text = " ".join(f"word{k % 997}" for k in range(60_000))
    same = " ".join(f"t{k}" for k in range(70))
    return [(1, None), (None, "a text whose id is null"), (None, None), (2, ""), (3, " \n\t "), (4, "one"), (5, same), (5, same), (6, same), (None, same), (7, long_text), (8, "the " * 300), (9, "é中 😀 " * 30), (10, same + " more")]
