"""Small inputs that hold the awkward cases of every operator."""

import random

from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("n_chars", T.LongType())])
SYLLABLES = ["ta", "re", "mi", "on", "sel", "vor", "én", "ka", "lu", "ost", "日", "pra"]


def word(rng):
    return "".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4)))


def prose(rng, n):
    return " ".join(word(rng) for _ in range(n))


def awkward(seed=1, n=40, long_words=4000):
    """(doc_id, text) with nulls, empty and long texts, copies, near copies,
    shared passages, repeated ids and repeated rows."""
    rng = random.Random(seed)
    shared = prose(rng, 60)
    rows = [(i, prose(rng, rng.randint(1, 120))) for i in range(n)]
    base = rows[3][1] + " " + prose(rng, 50)
    rows += [(n, base), (n + 1, base), (n + 2, base + " end"), (n + 3, "x " + base)]
    rows += [(n + 4, prose(rng, 20) + " " + shared + " " + prose(rng, 9)), (n + 5, shared), (n + 6, "a " + shared + " " + shared)]
    rows += [(n + 7, prose(rng, long_words)), (n + 8, "z" * 3000), (n + 9, "ab" * 900), (n + 10, ""), (n + 11, None),
             (n + 12, " \n\t "), (None, prose(rng, 30)), (None, base), (None, None), (n + 13, base), (n + 13, base),
             (n + 14, prose(rng, 40)), (n + 14, prose(rng, 40)), (-5, shared + "\n" + shared)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, None if k % 3 else "en", None if t is None else len(t))
                                  for k, (i, t) in enumerate(rows)], DOCS).repartition(parts)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def clash(df, *names):
    """The frame with more columns, under names that operators use inside."""
    from pyspark.sql import functions as F
    return df.withColumns({n: F.lit(f"own {n}") for n in names})
