import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
# Names the operators use inside, to prove that columns of the caller do not clash.
CLASHING = ("id", "text_key", "size", "digest", "fp", "row", "host", "lines", "h", "slice", "run", "s", "block", "n")


def prose(rng, words, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(words))


def odd_rows():
    rng = random.Random(5)
    body = prose(rng, 120)
    rows = [
        (1, None, "en", "a", None),
        (2, "", "en", None, 0),
        (3, " \n\t ", None, "a", 4),
        (4, body, "en", "a", len(body)),
        (5, body, "en", None, len(body)),
        (5, body, "en", None, len(body)),
        (6, body.upper(), "en", "b", len(body)),
        (None, body, "en", "b", len(body)),
        (None, "one two", "en", "b", 7),
        (7, body + " tail", "en", "b", 1),
        (8, "É" + body + "\nÀ LA", "fr", "c", 1),
        (9, "\n".join([body] * 3), "fr", "c", 1),
        (10, "x" * 300_000, "en", "c", 300_000),
        (11, prose(rng, 30_000), "en", "c", 1),
        (12, "mail a.b@c.example.org, ip 10.0.0.1 card 4111 1111 1111 1111 tel +1 (415) 555-2671.", "en", "d", 1),
        (13, "😀 a@b.c%d@e.f 1.2.3.256 01.002.3.4 4111-1111-1111-1112", "en", "d", 1),
    ]
    rows += [(20 + i, prose(rng, 60 + i % 50), "en", f"s{i % 3}", 1) for i in range(60)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows and clashing columns."""
    rows = [(*r, *(f"z{i}" for i in range(len(CLASHING)))) for r in odd_rows()]
    return spark.createDataFrame(rows, COLUMNS + "".join(f", {c} string" for c in CLASHING)).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def plain(docs):
    return [tuple(r) for r in docs.select("doc_id", "text", "source").collect()]


def of(frame):
    """(doc_id, text, source) rows of a frame."""
    return [tuple(r) for r in frame.select("doc_id", "text", "source").collect()]


def same(frame, expected, columns):
    got = sorted((tuple(r) for r in frame.select(*columns).collect()), key=repr)
    assert got == sorted(expected, key=repr)
