import random

import pytest

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()
#: Columns whose names operators might use themselves.
CLASHES = ["row", "n_words", "score", "spans", "text_hash", "component", "bucket", "gone", "length", "id"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES)


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(n))


def table(spark, rows):
    """documents with clashing further columns, from (doc_id, text, source)."""
    full = [(i, t, "en", s, None if t is None else len(t), *["x"] * len(CLASHES)) for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, repeated rows, ties, one long text, a text without spaces."""
    rng = random.Random(3)
    a, b = sentence(rng, 60), sentence(rng, 80)
    long = "\n".join(sentence(rng, 400) for _ in range(20))
    return [
        (1, None, "a"), (2, "", "b"), (3, "  \n\t ", None), (4, a, "a"), (4, a, "a"), (5, a, "b"), (6, a + " more", "c"), (7, b, "a"),
        (8, long, "b"), (9, "é" * 5000, "c"), (10, "one", "a"), (11, "one two", "a"), (12, "a\nb\n\nc", "b"), (13, None, None), (14, b.replace(" ", "\n"), "c"),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return table(spark, odd_rows).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return table(spark, [])


@pytest.fixture(scope="session")
def varied_rows():
    """A few hundred documents: copies, near copies, shared passages."""
    rng = random.Random(11)
    rows, n = [], 0
    for _ in range(40):
        base = sentence(rng, rng.randint(5, 120)).split()
        for _ in range(rng.choice([1, 1, 2, 6])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 5])):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            rows.append((n, " ".join(w), f"s{rng.randrange(6)}"))
            n += 1
    passage = sentence(rng, 60)
    for _ in range(8):
        rows.append((n, sentence(rng, 50) + " " + passage + " " + sentence(rng, 50), f"s{n % 6}"))
        n += 1
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def varied(spark, varied_rows):
    return table(spark, varied_rows).repartition(5).cache()
