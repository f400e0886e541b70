"""Small tables for the operators of the optional subpackage."""

import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
#: The columns of documents, and some whose names operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, k long, key string, score double, tile int"


def passage(seed: int, n: int) -> str:
    """n words that look like prose, the same for equal seeds."""
    import random

    r = random.Random(seed)
    syllables = ["ka", "lo", "mi", "ter", "an", "dre", "sol", "vi", "quo", "pe", "nar", "usk"]
    return " ".join("".join(r.choices(syllables, k=r.randint(1, 4))) for _ in range(n))


def odd_texts() -> list[str | None]:
    """Texts that operators have to survive: null, empty, blank, short, very long, not ASCII, equal."""
    shared = passage(1, 60)
    return [
        None,
        "",
        "   \t\n",
        "a",
        "One two three.",
        passage(2, 40) + " " + shared + " " + passage(3, 20),
        passage(4, 10) + " " + shared + " " + passage(5, 50),
        passage(2, 40) + " " + shared + " " + passage(3, 20),
        shared,
        shared,
        "abc " * 200,
        "x" * 3000,
        "Straße ÉCOLE naïve café — “quotes” … 𝔘𝔫𝔦 日本語 текст Ελληνικά I'll they've don't 12345 3.14  double  space nbsp　wide",
        "<|endoftext|> in <|startoftext|> a text<|endoftext|>",
        "é combining À ΣΑΣ İstanbul \u0000nul \r\nline\x0b\x0c",
        passage(6, 30000),
        passage(6, 29990) + " " + passage(7, 10),
        "﻿bom ​zero  line",
    ]


@pytest.fixture(scope="session")
def odd(spark):
    """Rows with nulls in every column, repeated rows, ties of ids, and columns whose names clash with inner ones."""
    texts = odd_texts()
    rows = [(i, t, None if i % 3 else "en", None if i % 2 else "s", None if t is None else len(t), i, None, "x", 0.5, 3) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], rows[0], (None, "no id", None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None), (3, "same id, other text", "en", "s", 19, 1, 1, "y", 0.1, 1)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark):
    return spark.read.parquet(f"{SF}/labels.parquet")


def frame(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t) for i, t in enumerate(texts)], T._parse_datatype_string("doc_id long, text string"))
