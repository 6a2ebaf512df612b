import random

import pytest
from pyspark.sql import SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def spark():
    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


def odd_texts(seed: int = 7) -> list[str | None]:
    """Nulls, empty and long texts, copies, near copies, shared passages and lines, white space of all kinds."""
    r = random.Random(seed)
    vocabulary = ["the", "of", "Straße", "été", "x", "naïve", "DATA", "spark", "a1", "=", "日本", "😀b", "don't"] + [f"w{i}" for i in range(400)]
    some = lambda n: [r.choice(vocabulary) for _ in range(n)]
    passage, line = " ".join(some(60)), "Shared Line " + " ".join(some(5))
    out: list[str | None] = [None, "", " ", "\n\n", "one", "one two three", "\t a\x0bb\x0cc\r\n d  e f ", "<|endoftext|>a<|endoftext|>"]
    for i in range(40):
        body = some(r.randint(3, 220))
        if i % 4 == 0:
            body[r.randint(0, len(body)) : 0] = passage.split()
        text = "".join(w + r.choice([" ", " ", " ", "  ", "\n"]) for w in body)
        if i % 3 == 0:
            text += "\n" + r.choice([line, line.upper(), f"  {line}\t"]) + "\nend"
        out.append(text)
        if i % 5 == 0:
            out += [text] * (1 + i % 3)
        if i % 6 == 0 and len(body) > 60:
            body[30] = "changed"
            out.append(" ".join(body))
    out += [" ".join(["again"] * 150), "z" * 1500, " ".join(some(3000)), "ab " * 700, passage, passage.replace("the", "The")]
    return out


@pytest.fixture(scope="session")
def rows():
    return [(i * 3 % 1009 if i % 17 else None, t, ("en", "de", None)[i % 3], (f"s{i % 4}", None)[i % 9 == 8], 0) for i, t in enumerate(odd_texts(), 1)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(spark, docs):
    """The same rows with columns named like the operators' own."""
    return docs.selectExpr("*", *(f"'x' AS {c}" for c in ("dkey", "tkey", "positions", "part", "keys", "n", "n_words", "score", "line", "key", "h", "id", "component_id", "sig")))
