import random

import pytest
from pyspark.sql import types as T

#: Names that operators give columns of their own.
CLASHES = ["part", "fp", "keys", "score", "length", "row", "key", "class", "rn", "root", "__t", "__w", "__l", "__q", "__v", "__p", "__failed", "__kept", "__score", "__text", "__key", "__mix_x", "__mix_tokens", "__mix_id"]
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    *[T.StructField(c, T.StringType()) for c in CLASHES],
])


def texts() -> list[tuple[int | None, str | None]]:
    r = random.Random(5)
    words = ["alpha", "beta", "gamma", "delta", "été", "Straße", "niño", "x", "the", "of", "and", "zeta,", "end."]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    base = say(120)
    rows = [(i, "\n".join(say(r.randint(1, 30)) for _ in range(r.randint(1, 6)))) for i in range(30)]
    rows += [(40, base), (41, base), (41, base), (42, base + " more"), (43, base.replace("alpha", "beta", 1)), (50, None), (51, ""), (52, " \n\t "), (53, "one"), (54, "one two")]
    rows += [(None, base), (None, None), (60, "é" * 5000), (61, say(20_000)), (62, "\n".join(f"line {i} {say(3)}" for i in range(700))), (63, "word " * 400), (64, "A-Z  b\x1cc")]
    return rows


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, blanks, very long texts, repeated rows and columns whose names clash with those the operators make."""
    langs, sources = ["en", "de", None], ["src0", "src0", "src1", None, "odd"]
    rows = [(d, t, langs[i % 3], sources[i % 5], len(t or ""), *CLASHES) for i, (d, t) in enumerate(texts())]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
