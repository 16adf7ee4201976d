import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def words():
    rng = random.Random(4)
    return ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(2, 7))) for _ in range(400)]


@pytest.fixture(scope="session")
def odd_rows():
    """Texts at the edges: null, empty, blanks only, short, long, repeated words, other white space."""
    return [None, "", " \n\t ", "one", "one two", "Ähm  two three\x0bfour", "ha " * 300, "x" * 5000, "A b C d", "a B c D", "İstanbul ſecret token=\"abcdef1\" " * 3, "tail\n"]


@pytest.fixture(scope="session")
def corpus(words, odd_rows):
    """Rows (doc_id, text): random texts, exact and near copies, shared passages, and the odd ones."""
    rng = random.Random(9)
    texts = [" ".join(rng.choices(words, k=rng.randint(5, 160))) for _ in range(60)]
    texts += [texts[3], texts[3], texts[7] + " ", texts[8].upper()]
    for i in (10, 11, 12):  # near copies in a chain
        own = texts[i].split()
        for k in range(4):
            own = list(own)
            if own:
                own[rng.randrange(len(own))] = f"new{i}{k}"
            texts.append(" ".join(own))
    passage = " ".join(rng.choices(words, k=64))
    texts += [" ".join(rng.choices(words, k=20)) + " " + passage + " " + " ".join(rng.choices(words, k=15)) for _ in range(5)]
    texts += ["the the " + passage, passage + " end end", " ".join(passage.split()[:49]), " ".join(passage.split()[:50])]
    return list(enumerate(texts + odd_rows))


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame([(i, t, None if i % 7 == 0 else "en", None if i % 5 == 0 else "s", len(t or "")) for i, t in corpus], DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
