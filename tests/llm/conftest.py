import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, lang, source, n_chars, extra, size): near and exact copies, nulls, blanks, ties, repeated rows, a long text."""
    rng = random.Random(5)
    base = [prose(rng, rng.randrange(20, 120)) for _ in range(12)]
    texts = list(base)
    for t in base[:5]:
        for _ in range(4):
            w = t.split()
            for _ in range(rng.randrange(0, 6)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            texts.append(" ".join(w))
    texts += [base[0], base[0].upper(), None, "", " \n\t ", "one", "one two", "One  TWO", "\n".join([base[1]] * 3 + ["tail"]), prose(rng, 6000), "é ü ß \x1f x", base[2] + "\n" + base[3], "$$$ ### " * 20]
    rows = [(k, t, ["en", "fr", None][k % 3], ["a", "b", None, "c"][k % 4], len(t or ""), "e", k) for k, t in enumerate(texts)]
    return [*rows, rows[3], (None, base[0], "en", "a", 1, None, None), (None, None, None, None, None, None, None)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, h int"


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus; two of its columns have names that the operators use for their results."""
    return spark.createDataFrame(corpus, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
