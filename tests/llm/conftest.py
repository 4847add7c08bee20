import random

import pytest

VOCABULARY = [f"w{k}" for k in range(60)] + ["The", "end.", "größe", "naïve", "日本"]


@pytest.fixture(scope="session")
def texts():
    """Prose-like texts with copies, near copies, shared passages, empties, nulls, a long one and short ones."""
    r = random.Random(11)
    words = lambda n: [r.choice(VOCABULARY) for _ in range(n)]
    passage = " ".join(words(45))
    out = [None, "", "   \n\t ", "one", "one two three", "One Two Three", " ".join(["same"] * 90)]
    base = [" ".join(words(r.randrange(60, 160))) for _ in range(25)]
    out += base
    for t in base[:8]:
        w = t.split()
        out += [t, t.upper(), t.replace(" ", "  \n", 3)]
        for _ in range(3):
            k = r.randrange(len(w))
            out.append(" ".join(w[:k] + ["changed"] + w[k + 1 :]))
        out.append(" ".join(w[: len(w) * 5 // 6]))
    out += [" ".join(words(30)) + " " + passage + "\n" + " ".join(words(30)) for _ in range(6)]
    out.append(" ".join(words(20_000)))
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """doc_id, text and columns with names that operators use themselves."""
    rows = [(k, t, k % 3, "x", [k], None) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words int, row string, tokens array<int>, _w string").repartition(4)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
