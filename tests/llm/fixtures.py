"""Small tables with the odd cases: nulls, empty and long texts, repeated rows and ids, copies, clashing columns."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # Names that the operators use for columns of their own.
    T.StructField("digest", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("tie", T.LongType()), T.StructField("rules", T.StringType()),
])


def rows(n: int = 60, seed: int = 3) -> list[tuple]:
    draw = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "délta", "eps", "zeta", "eta", "Theta", "iota", "kappa", "lambda", "mu", "straße", "日本", "x"]

    def prose(k: int) -> str:
        return " ".join(draw.choice(words) for _ in range(k))

    shared = prose(25)
    out = []
    for i in range(n):
        text = prose(draw.randint(1, 60))
        if i % 4 == 1:
            text = text + "\n" + shared + ". " + prose(5)
        out.append((i * 7 % 101, text, "en", f"s{i % 4}" if i % 9 else None, len(text), "x", "y", 1, "z"))
    copy = out[5][1]
    for i in range(20):
        out.append((200 + i, copy, "en", "hot", len(copy), None, None, None, None))
    for i in range(6):
        near = copy.split(" ")
        near[i % len(near)] = "changed"
        out.append((300 + i, " ".join(near), "en", "hot", 1, None, None, None, None))
    out += [
        (400, None, None, None, None, None, None, None, None), (401, "", "en", "s1", 0, None, None, None, None),
        (402, " \t\n ", "en", "s1", 4, None, None, None, None), (None, "a text without id " + shared, "en", "s2", 1, None, None, None, None),
        (None, copy, "en", "s2", 1, None, None, None, None), (403, prose(6000), "en", "s3", 1, None, None, None, None),
        (5, "another text with a known id", "en", "s0", 1, None, None, None, None), (404, "a" * 3000, "en", "s0", 1, None, None, None, None),
        (405, "a" * 2000 + "b", "en", "s0", 1, None, None, None, None),
    ]
    out += [out[0], out[0], out[10]]
    return out


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)
