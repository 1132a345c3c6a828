"""Small corpora with awkward rows."""

import random

AWKWARD = [None, "", " ", "\n\n", "one", "a b c", "A B C", "the same line\nthe same line\n\nother", "éÉ ß 中文 да", "w " * 3000, "x" * 30000]


def corpus(n=60, seed=3, words=400):
    """Texts of random words with copies, near copies and shared passages."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)]
    passage = [rng.choice(vocabulary) for _ in range(70)]
    texts = []
    for i in range(n):
        own = [rng.choice(vocabulary) for _ in range(rng.randint(1, 120))]
        kind = i % 6
        if kind == 1 and texts:
            own = rng.choice(texts).split(" ")
        elif kind == 2 and texts:
            own = rng.choice(texts).split(" ")
            if len(own) > 3:
                own[rng.randrange(len(own))] = "changed"
        elif kind == 3:
            a = rng.randrange(40)
            own[len(own) // 2 : len(own) // 2] = passage[a : a + rng.randint(15, 60)]
        texts.append(" ".join(own))
    return texts


def frame(spark, texts, extra=True):
    """doc_id, text and columns whose names clash with those of results."""
    rows = [(i, t, "x", "src", 1, True) for i, t in enumerate(texts)]
    kind = "doc_id long, text string, lang string, source string, n_words long, kept boolean"
    df = spark.createDataFrame(rows, kind).repartition(3)
    return df if extra else df.select("doc_id", "text")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")
