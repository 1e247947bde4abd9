"""Small tables with the awkward rows every operator has to stand."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def documents(spark, seed=1, rows=60, extra=()):
    """Random texts with copies, near-copies, nulls, empty and long texts and repeated rows."""
    rng = random.Random(seed)
    out = []
    for i in range(rows):
        out.append((i, words(rng, rng.randint(1, 120)), rng.choice(["en", "de", None]), rng.choice(["a", "a", "b", None]), None))
    base = words(rng, 200)
    for i in range(8):
        near = base.split()
        near[rng.randrange(200)] = f"x{i}"
        out.append((1000 + i, " ".join(near), "en", "a", 5))
    out += [(2000 + i, base.upper(), "en", "a", 5) for i in range(5)]
    out += [(3000, None, None, None, None), (3001, "", "en", "b", 0), (3002, " \t\n ", "en", "b", 4), (3003, "one", "en", "b", 3)]
    out += [(3004, "One", "en", "b", 3), (3005, "two words", "en", "b", 9), (3006, "TWO  words", "en", "b", 10)]
    out += [(None, base, "en", "a", 1), (None, None, "en", "a", 1), (None, "lonely words without an id", "en", "a", 1)]
    out += [(4000, words(rng, 30_000, 5000), "en", "a", 1), (4001, "y" * 300_000, "en", "a", 1)]
    out += [out[3], out[3]]
    return spark.createDataFrame(out + list(extra), DOCS)


def nothing(spark):
    return spark.createDataFrame([], DOCS)
