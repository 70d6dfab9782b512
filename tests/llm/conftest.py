import public_tokenizers
import pytest

#: Nulls, empty and white texts, ties, repeated rows, a long text, near copies.
BASE = "the quick brown fox jumps over the lazy dog and runs far away from here to find some more food for all of its many small young friends "
TEXTS = [None, "", "  \n\t ", "one", "two words", "a b c", BASE, BASE, BASE + "tail", BASE.upper(), BASE * 3, "x" * 9000, "é ü ñ 日本 " * 50, "#1 $2 <a> | b & c % d * e", "line\nline\nline\nother\n\n\n", "<|endoftext|> and <|startoftext|>", BASE.replace("fox", "cat"), "Licensed under the Apache License, Version 2.0.\nAll rights reserved."]


@pytest.fixture(scope="session")
def docs(spark):
    """doc_id, text and columns whose names clash with results; two rows repeat an id, one has none."""
    rows = [(i, t, f"s{i % 3}", "clash", 7) for i, t in enumerate(TEXTS)] + [
        (6, BASE, "s0", "clash", 7), (None, BASE + "none", "s0", "clash", 7)
    ]
    return spark.createDataFrame(
        rows, "doc_id long, text string, source string, kept string, n_words int"
    ).repartition(3)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame(
        [(6, 1, 0), (10, 1, 0), (13, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int"
    )


@pytest.fixture(scope="session")
def byte_vocabulary():
    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="session")
def word_vocabulary():
    return public_tokenizers.path("word_bpe_49k.json")
