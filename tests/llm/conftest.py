import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()), ("key", T.StringType()), ("seed", T.IntegerType()), ("context", T.StringType()))])


def make_texts(seed=4):
    """Short and long texts, copies, near copies, shared passages, runs of one character, empty and null ones."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéü") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    out = [text(rng.randint(1, 120)) for _ in range(25)]
    passage, line = text(60), text(20)
    for i in range(8):
        out.append(f"{text(rng.randint(5, 40))}\n{passage}  {text(rng.randint(0, 40))}" if i % 2 else f"{line} {text(30)}\t{line}")
    base = text(90).split(" ")
    for i in range(12):
        near = list(base)
        for _ in range(i % 4):
            near[rng.randrange(len(near))] = rng.choice(words)
        out.append(" ".join(near))
    out += [out[0], out[0], out[3].upper(), "a" * 450, "b " * 130, "", None, "   \n", "x", "one two three", "one two  three", f"ü{'é' * 260}"]
    return out


@pytest.fixture(scope="session")
def texts_():
    return make_texts()


@pytest.fixture(scope="session")
def corpus(spark, texts_):
    rows = [(i * 3, t, None, f"s{i % 3}" if i % 7 else None, None, "clash", i, None) for i, t in enumerate(texts_)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids and repeated rows."""
    t = " ".join(f"w{i}" for i in range(60))
    rows = [(None, t), (1, t), (1, t), (2, None), (None, "short"), (3, ""), (4, t + " more")]
    return spark.createDataFrame([(*r, None, None, None, None, None, None) for r in rows], SCHEMA)
