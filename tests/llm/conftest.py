import random

import pytest


def texts(seed: int, n: int = 60) -> list[str | None]:
    """Invented texts with copies, near copies, shared passages, empty and null ones."""
    r = random.Random(seed)
    vocab = ["the", "and", "of", "ré", "Straße", "x", "Thonly", "a1", "don't", "日本", "😀", "#", "$$", "1234", "end."]
    words = lambda n: [r.choice(vocab) + (r.choice("abcdefgh") * r.randrange(3)) for _ in range(n)]
    shared, out = words(45), [None, "", " ", "one", "\n\n", "a " * 500, "ab" * 300]
    while len(out) < n:
        kind = r.randrange(5)
        if kind == 0 and len(out) > 8:
            out.append(r.choice(out[7:]))
        elif kind == 1 and len(out) > 8:
            w = r.choice(out[7:]).split(" ")
            w[r.randrange(len(w))] = "changed"
            out.append(" ".join(w))
        elif kind == 2:
            out.append(" ".join(words(r.randrange(30)) + shared + words(r.randrange(30))))
        else:
            w = words(r.randrange(1, 120))
            out.append("".join(x + r.choice([" ", " ", " ", "\n", "  ", "\t"]) for x in w))
    return out


@pytest.fixture(scope="session")
def docs(spark):
    """Rows with a clashing extra column, and a copy of one row."""
    rows = [(i * 3 % 61, t, "en", f"src{i % 3}", len(t or ""), "clash") for i, t in enumerate(texts(1))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words string").repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="session")
def plain(docs):
    return {r.doc_id: r.text for r in docs.collect()}
