"""Small documents with the awkward cases: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

SCHEMA = "doc_id long, text string, id long, row string, pos int, fp long"


def made_texts(n=60, seed=5):
    r = random.Random(seed)
    words = ["the", "of", "river", "stone", "garden", "añejo", "überall", "ciel", "Don't", "42", "data,", "light."]
    return [" ".join(r.choice(words) + r.choice(["", "", "\n", "s"]) for _ in range(r.randint(1, 120))) for _ in range(n)]


def rows():
    texts = made_texts()
    shared = "This line repeats across documents."
    out = [(i, t + ("\n" + shared if i % 3 == 0 else "")) for i, t in enumerate(texts)]
    out += [(100, None), (101, ""), (102, "   \n\t "), (103, out[5][1]), (103, out[5][1]), (104, "\n\n" + shared.upper() + "  \n"),
            (105, "word " * 3000), (106, "x" * 9000), (None, out[7][1]), (None, None), (107, out[9][1].replace("river", "rivers", 1))]
    return [(i, t, 1, "a", None, 7) for i, t in out]


def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def as_bag(rows):
    return sorted(map(repr, rows))
