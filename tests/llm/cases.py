"""Small tables for the corpus operators: planted cases, and every odd value that a column may hold."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
VOCABULARY = ["alpha", "beta", "the", "of", "and", "rotor", "Stein", "été", "naïve", "42", "x.y", "end.", "…", "🙂", "a"]


def prose(rng: random.Random, words: int) -> str:
    out = []
    for i in range(words):
        out.append(rng.choice(VOCABULARY) + (str(rng.randrange(30)) if rng.random() < 0.4 else ""))
        out.append("\n" if rng.random() < 0.08 else " ")
    return "".join(out).strip(" ")


def rows(seed: int = 1, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    texts = [prose(rng, rng.randrange(1, 120)) for _ in range(n)]
    long = prose(rng, 9000)
    texts += [texts[0]] * 6 + [texts[3] + " tail"] * 2 + [long, long[:-9] + "different", "", " ", "\n\n", None, None, "one", "two words", "tab\tand\vvt", "a " * 900, "z" * 700, "  double  spaces  ", "nl \n start"]
    out = []
    for i, t in enumerate(texts):
        out.append((i * 3 + 1, t, rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "s3", "s3", "s3", "ä", "", None]), None if t is None else len(t)))
    return out


def odd_rows() -> list[tuple]:
    """Null ids, repeated rows and repeated ids besides the rest."""
    base = rows(5, 20)
    return base + [base[0], base[0], (None, "no id here at all", None, None, 3), (None, None, None, None, None), (base[1][0], "same id, other text", "en", "s1", 1)]


def table(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def clashing(df):
    """The same table with columns whose names operators might use themselves."""
    from pyspark.sql import functions as F

    for c in ("fp", "key", "part", "size", "target", "rate", "copies", "taken", "start", "length", "line", "pos", "h1", "_quality", "id", "kept", "n", "c", "_lang", "whole", "label", "a", "b", "root", "_block", "position"):
        df = df.withColumn(c, F.lit("x"))
    return df
