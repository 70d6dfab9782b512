import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import porter, text, vectors


def one(spark, column, *values):
    names = [f"c{i}" for i in range(len(values))]
    return spark.createDataFrame(
        [values], ", ".join(f"{n} string" for n in names)
    ).select(column(*map(F.col, names)).alias("x")).first()["x"]


def test_trigrams(spark):
    assert one(spark, text.trigrams, "abc") == ["  a", " ab", "abc", "bc "]
    assert one(spark, text.trigrams, "ab") == ["ab"]
    assert one(spark, text.trigrams, "aaaa") == ["  a", " aa", "aaa", "aa "]


def test_distance_and_similarity(spark):
    assert one(spark, text.edit_distance, "Kitten", "sitting") == 3
    assert one(spark, text.similarity, "", "") == 1.0
    assert one(spark, text.similarity, "abcd", "abce") == 0.75
    assert one(spark, text.fuzzy_match, "The Server", "server") is True


@pytest.mark.parametrize(
    ("given_text", "want"),
    [
        ("use HTTPServer2 and my_name", {"HTTPServer2", "my_name"}),
        ("a-b-c MAX_TOKENS @ai-sdk/openai", {"a-b-c", "MAX_TOKENS"}),
        ("nothing here", set()),
    ],
)
def test_identifiers(spark, given_text, want):
    assert want <= set(one(spark, text.identifiers, given_text))


def test_normalised_names(spark):
    assert one(spark, text.normalize_identifier, " My-Name_x.y/@z ") == "mynamexyz"
    assert one(spark, text.identifiers_similar, "my_name", "MyName") is True
    assert one(spark, text.normalize_entity, "\t  Auth  ") == "auth"
    assert one(spark, text.sanitize_relationship, " depends on! ") == "depends_on_"


def test_query_entities(spark):
    assert one(spark, text.query_entities, "How does useChat? work with useChat?") == ["usechat", "work"]
    assert one(spark, lambda q: text.query_entities(q, strip=False), "what is useChat?") == ["usechat?"]


def test_like_keeps_wildcards_and_backslashes(spark):
    assert one(spark, lambda c: text.like_anywhere(c, "a_c"), "xABCx") is True
    assert one(spark, lambda c: text.like_anywhere(c, "a\\b"), "xa\\bx") is True


def test_window_distance_against_a_loop(spark):
    def loop(t, p):
        import functools

        @functools.cache
        def d(a, b):
            return len(a) + len(b) if not a or not b else min(
                d(a[1:], b) + 1, d(a, b[1:]) + 1, d(a[1:], b[1:]) + (a[0] != b[0])
            )

        return min((d(t.lower()[i : i + len(p)], p.lower()) for i in range(len(t) - len(p) + 1)), default=None)

    for t, p in (("the quick brown fox", "quik"), ("abc", "abcd"), ("ÄbcXyz", "cxy")):
        assert one(spark, lambda c, p=p: text.window_edit_distance(c, p), t) == loop(t, p)


# Words and stems of the published algorithm's examples.
STEMS = {
    "caresses": "caress",
    "ponies": "poni",
    "cats": "cat",
    "agreed": "agre",
    "plastered": "plaster",
    "motoring": "motor",
    "hopping": "hop",
    "filing": "file",
    "happy": "happi",
    "relational": "relat",
    "vietnamization": "vietnam",
    "triplicate": "triplic",
    "hopefulness": "hope",
    "adjustment": "adjust",
    "adoption": "adopt",
    "probate": "probat",
    "controll": "control",
    "sky": "sky",
}


@pytest.mark.parametrize(("word", "stem"), STEMS.items())
def test_porter(word, stem):
    assert porter.stem(word) == stem


@settings(max_examples=200, deadline=None)
@given(st.text("abcdefghijklmnopqrstuvwxyz", max_size=12))
def test_stems_are_short_and_lower(word):
    assert len(porter.stem(word)) <= len(word) + 1
    assert re.fullmatch("[a-z]*", porter.stem(word))


def test_cosine(spark):
    rows = spark.createDataFrame(
        [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 0.0]), ([1.0], [1.0, 0.0])], "a array<float>, b array<float>"
    )
    assert [r[0] for r in rows.select(vectors.cosine("a", "b")).collect()] == [1.0, None, None]
