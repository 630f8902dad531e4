import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdeghilmnorstu") for _ in range(rng.randint(1, 9))) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Small corpus with nulls, empty, short, very long and repeated texts, near copies, shared passages."""
    rng = random.Random(5)
    out = []
    passage = sentence(rng, 70)
    base = sentence(rng, 200)
    line = sentence(rng, 12)
    for i in range(60):
        body = "\n".join(sentence(rng, rng.randint(4, 30)) + "." for _ in range(rng.randint(1, 8)))
        if i % 5 == 0:
            body = body + " " + passage + " " + sentence(rng, 20)
        if i % 4 == 0:
            body = body + "\n" + line
        if i % 7 == 0:
            w = base.split(" ")
            w[rng.randrange(len(w))] = "edited"
            body = " ".join(w)
        out.append((i * 3, body, "en", f"src{i % 6}" if i % 11 else None, len(body)))
    long = sentence(rng, 30_000)
    out += [
        (900, None, None, None, None), (901, "", "en", "src1", 0), (902, " \n\t ", "en", "src1", 4), (903, "one", "en", "src2", 3), (904, "One two\nthree", "en", "src2", 13),
        (905, long, "en", "src3", len(long)), (906, out[3][1], "de", "src4", 1), (907, out[3][1], "de", "src4", 1), (907, out[3][1], "de", "src4", 1),
        (908, "é" * 300 + " ßtraße ﬁ naïve   x y <|endoftext|> don't", "fr", "src5", 300), (909, out[1][1].upper(), "en", "é", 1),
    ]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def nulls(spark):
    return spark.createDataFrame([(None, None, None, None, None), (None, "some words of a text here", None, None, None)], SCHEMA)


@pytest.fixture(scope="session")
def clash(docs):
    """The corpus with extra columns whose names an operator might use itself."""
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit(1) for c in ("id", "score", "n", "row", "hash", "component", "size", "uid", "spans", "thash", "range", "at", "h", "left", "a", "_key", "_id", "_thash", "_gone", "_text", "_row", "_score", "_gone_id", "_gone_hash", "_gone_row")})
