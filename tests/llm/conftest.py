import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, pool=400):
    return " ".join(f"w{rng.randrange(pool)}{'é' if rng.random() < 0.1 else ''}" for _ in range(n))


def sample(seed=1, n=60):
    """Texts with copies, near copies, shared passages and lines, odd white space, nulls and empty ones."""
    rng = random.Random(seed)
    passage = words(rng, 60)
    lines = [words(rng, 8) for _ in range(6)]
    out = []
    for i in range(n):
        kind = i % 10
        if kind == 0 and out:
            text = rng.choice([t for _, t in out if t] or ["x"])
        elif kind == 1 and out:
            base = (rng.choice([t for _, t in out if t] or ["x y"])).split(" ")
            base[rng.randrange(len(base))] = "edited"
            text = " ".join(base)
        elif kind == 2:
            text = words(rng, 20) + "\n" + passage + "\n" + words(rng, 20)
        elif kind == 3:
            text = "\n".join(rng.sample(lines, 2) + lines[:4] + [words(rng, 9)])
        elif kind == 4:
            text = [None, "", "   \n\t ", "a", "a b", "\n\n\n", "  lead\ttab\r\n", "<|endoftext|> x", "12 34"][(i // 10) % 9]
        elif kind == 5:
            text = "ab " * rng.randrange(1, 400)
        elif kind == 6:
            text = words(rng, 30) + "   " + words(rng, 3) + "　"
        else:
            text = words(rng, rng.randrange(1, 300))
        out.append((i * 3 + 1, text))
    rng.shuffle(out)
    return out


@pytest.fixture(scope="session")
def pairs():
    return sample()


@pytest.fixture(scope="session")
def docs(spark, pairs):
    rows = [(i, t, [None, "en", "fr"][i % 3], [None, "b", "a", "c"][i % 4], len(t) if t else 0) for i, t in pairs]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
