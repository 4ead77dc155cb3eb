import random

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    """A small table with every awkward case, and clashing extra columns."""
    rnd = random.Random(5)
    words = ["alpha", "Beta", "gamma", "delta", "Épsilon", "zeta,", "eta.", "theta", "iota", "kappa"]

    def prose(n):
        return " ".join(rnd.choice(words) + str(rnd.randrange(40)) for _ in range(n))

    base = prose(120)
    near = base.split()
    texts = [prose(rnd.randrange(3, 60)) for _ in range(12)] + [None, "", " ", "\t\n", "x", "one two", "one two"]
    texts += [base, base.replace(" ", "  "), base.upper(), " ".join(near[:-4] + ["new"] * 4)]
    texts += [" ".join(near[i : i + 100]) for i in (0, 5, 10, 15, 20)]
    texts += ["é" * 5000, "a b " * 3000, prose(2000), "漢字" * 700, "1234 5678", "??? !!!"]
    rows = [(i * 3, t, "en" if i % 2 else None, f"s{i % 3}" if i % 5 else None, i, "k") for i, t in enumerate(texts)]
    rows.append(rows[2])  # a repeated row
    kind = "doc_id long, text string, lang string, source string, n long, key string"
    return spark.createDataFrame(rows, kind).repartition(3)


@pytest.fixture(scope="session")
def rows(documents):
    return [(r.doc_id, r.text) for r in documents.collect()]


def same(df, want):
    """Rows of ``df`` and ``want`` are equal as bags."""
    got = sorted((tuple(r) for r in df.collect()), key=repr)
    assert got == sorted(want, key=repr)
