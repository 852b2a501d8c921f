import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def sentence(r: random.Random, n: int) -> str:
    syllables = "an ber co de el fa gu hi jo ka le mo nu or pi ra so tu vi we".split()
    return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text): null, empty, blank and long texts, copies, near copies, a shared passage, repeated rows and ids."""
    r = random.Random(5)
    shared = sentence(r, 30)
    base = [sentence(r, r.randint(1, 80)) for _ in range(25)]
    long = sentence(r, 6000)
    out = [(1, None), (2, ""), (3, " \t\n "), (4, "x"), (5, "two words"), (6, long), (7, long + " end")]
    out += list(enumerate(base, 10))
    out += [(50 + i, t) for i, t in enumerate(base[:6])]
    out += [(60 + i, t.replace(" ", "  ").upper()) for i, t in enumerate(base[6:9])]
    out += [(70 + i, f"{sentence(r, 12)} {shared} {sentence(r, 5)}") for i in range(5)]
    out += [(80, "Mail a.b@mail.example.com or 10.0.0.255, card 4532 0151 1283 0366, call +1 (499) 555-6503 <|endoftext|> don't"), (81, "été naïve 漢字 \U0001f600 𝒳 \u200d １２"), (10, base[0]), (10, "another text of the same id")]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en" if i % 2 else "de", f"src{i % 3}", len(t or "")) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd_docs(docs):
    """With more columns, some named like results or like the operators' own."""
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit(None).cast("string") for c in ("component_id", "fp", "row", "block", "n_words", "kept_text", "masked", "spans", "score", "lang_pred", "ids", "n_tokens", "piece", "media", "_u")})
