import re

import pytest

_DOWN = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lower_ascii(text):
    return (text or "").translate(_DOWN)


def find_words(text, pattern):
    return re.findall(pattern, lower_ascii(text))


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, very long, repeated and strange texts; ids repeat and one is null."""
    rows = [(1, None), (2, ""), (3, " \t\n "), (4, "One two three, four."), (4, "One two three, four."), (5, "word " * 30_000),
            (6, "x" * 200_000), (7, "Été ß 中文 \U0001f600 café"), (None, "No id here, none at all."), (8, "!!! ??? 123 456"),
            (9, "<|endoftext|> and <|startoftext|>"), (10, "\x00\x01 control \x7f")]
    return [(i, t, "en", "s", -1, "clash", 0, 0) for i, t in rows]


ODD_SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, text_key string, score int, "
              "component_id int")


@pytest.fixture(scope="session")
def odd_docs(spark, odd_texts):
    """``odd_texts`` with further columns whose names operators use themselves."""
    return spark.createDataFrame(odd_texts, ODD_SCHEMA).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], ODD_SCHEMA)
