import random

import pytest

#: Columns that share their names with columns the operators use inside.
EXTRA = "digest salt row verdict id key block shard size words part role spans ids copies _id".split()


@pytest.fixture(scope="session")
def make(spark):
    """Documents of (doc_id, text, lang, source) with extra columns of clashing names."""

    def build(rows):
        schema = "doc_id long, text string, lang string, source string, n_chars long, "
        schema += ", ".join(f"{name} string" for name in EXTRA)
        full = [(*r, None if r[1] is None else len(r[1]), *["x"] * len(EXTRA)) for r in rows]
        return spark.createDataFrame(full, schema).repartition(4)

    return build


def prose(rng, n, vocabulary=None):
    vocabulary = vocabulary or [a + b for a in ("an", "re", "th", "ou") for b in ("ea", "in", "st", "le")]
    return " ".join(rng.choice(vocabulary + ["the", "of", "and"]) for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in every column, empty and very long texts, ties, copies and near copies."""
    rng = random.Random(5)
    base = prose(rng, 120)
    own = base.split()
    rows = [
        (1, None, None, None),
        (2, "", "en", "a"),
        (3, " \t\n ", "en", "a"),
        (4, base, "en", "a"),
        (5, base.upper(), "en", None),
        (6, base, None, "b"),
        (7, " ".join([*own[:60], "changed", *own[61:]]), "en", "b"),
        (8, "é" + base, "fr", ""),
        (9, prose(rng, 30_000), "en", "b"),
        (10, "x" * 200_000, "de", "c"),
        (11, "to be", "en", "c"),
        (12, "To Be", "en", "c"),
        (13, "a ▁ b  日本 \U0001f600  end", "ja", "c"),
        (14, "\n".join(["the same line"] * 9 + [base]), "en", "c"),
        (15, None, "en", "c"),
    ]
    for i in range(20, 60):
        rows.append((i, prose(rng, rng.randint(1, 90)), rng.choice(["en", "de"]), rng.choice("abc")))
    for i in range(60, 75):  # near copies of one text, each with a change of its own
        at = rng.randrange(118)
        rows.append((i, " ".join([*own[:at], f"w{i}", *own[at + 1 :]]), "en", "a"))
    return rows


@pytest.fixture(scope="session")
def edge(make, edge_rows):
    return make(edge_rows)


@pytest.fixture(scope="session")
def nothing(make):
    return make([])
