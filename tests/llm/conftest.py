import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use themselves.
CLASHING = "size int, cls string, block string, __cls2 int, target string, key int, n int, held_out string"


def rows_of(texts, first=0):
    return [(first + i, t, "en", f"src{i % 3}" if i % 7 else None, None if t is None else len(t)) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def make_docs(spark):
    def make(texts, first=0, parts=3):
        return spark.createDataFrame(rows_of(texts, first), SCHEMA).repartition(parts)
    return make


@pytest.fixture(scope="session")
def clashing(spark):
    """The same rows with further columns of clashing names."""
    def add(df):
        from pyspark.sql import functions as F
        for column in CLASHING.split(", "):
            name, kind = column.split()
            df = df.withColumn(name, F.lit("7").cast(kind))
        return df
    return add


def prose(r: random.Random, n: int) -> str:
    return " ".join(r.choice(["Alpha", "beta", "gamma", "de", "épsilon", "zeta-eta", "theta", "iota", "kappa", "la"]) + r.choice("abcdefghij") for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Texts with near and exact copies, shared passages, short, empty, null, odd white space and one long text."""
    r = random.Random(4)
    base = [prose(r, r.randrange(5, 160)) for _ in range(30)]
    passage = prose(r, 45)
    texts = list(base)
    for i in range(12):  # near copies of one text, each with its own small changes
        words = base[0].split() if len(base[0].split()) > 60 else (base[0] + " " + base[1]).split()
        for _ in range(r.randrange(0, 4)):
            words[r.randrange(len(words))] = f"changed{i}"
        texts.append(" ".join(words))
    texts += [base[3], base[3].upper(), base[3].replace(" ", "\n\t ", 4), "", None, "   \n", "one", "One", "two words", None, "four words are here",
              prose(r, 10) + " " + passage + " " + prose(r, 12), passage + "\x0b" + prose(r, 30), prose(r, 8) + " " + passage,
              "same same same " * 30, "same same same " * 50, " ".join(f"w{i}" for i in range(30_000)), "a b c d e f g", "x" * 5000]
    return texts
