import random

import pytest

SYLLABLES = "an be ca do en fi go ha in jo ka le mo no or pa re si to un".split()


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(n)]


def corpus(seed: int = 1) -> list[tuple]:
    """(doc_id, text): copies, near copies, shared passages, nulls, empty, repeated rows, short, long and repetitive texts."""
    rng = random.Random(seed)
    base = [" ".join(words(rng, rng.randint(60, 300))) for _ in range(12)]
    passage = " ".join(words(rng, 110))
    out = [(i, t) for i, t in enumerate(base)]
    out += [(20 + i, base[0]) for i in range(3)]
    for i in range(12):  # near copies: one to three words changed
        w = base[i % 3].split()
        for _ in range(rng.randint(1, 3)):
            w[rng.randrange(len(w))] = "changed" + rng.choice(SYLLABLES)
        out.append((30 + i, " ".join(w)))
    for i in range(8):
        out.append((50 + i, f"{' '.join(words(rng, 40))} {passage} {' '.join(words(rng, 30))}"))
    out += [(70, None), (71, ""), (72, " \n\t "), (73, "one"), (74, "One two Three"), (75, "one two three"), (76, "the " * 900), (77, "aé" * 700), (78, "ß" * 900), (None, base[1]), (None, None)]
    out += [(5, base[5]), (5, base[5]), (79, base[7] + " " + base[7])]
    return out


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """Two partitions, with columns whose names clash with results."""
    got = [(i, t, "x", 1, 2.0, "y") for i, t in rows]
    return spark.createDataFrame(got, "doc_id long, text string, spans string, n_words int, score double, kept string").repartition(2).cache()


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
