"""Cases that every operator and pipeline stage has to take: very long texts, clashing names, nulls, empty tables."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import bpe, fingerprints, licenses, ngram_join, packing, quality_classifier, quality_rules, sharding, token_counts, warc

NAMES = [
    "_id",
    "_text",
    "_s",
    "_key",
    "_n",
    "Kept",
    "row",
    "_row",
    "_place",
    "words",
    "doc",
    "node",
    "N_Words",
    "Shard",
    "ids",
    "Sequence_ID",
]
LONG = {
    1: " " * 2_000_000,
    2: "x" * 1_000_000,
    3: "word\n" * 300_000,
    4: "\n \t" * 400_000 + "end",
    5: None,
    6: "",
    7: "é日" * 200_000,
}


@pytest.fixture(scope="module")
def long_docs(spark):
    rows = [(i, t) for i, t in LONG.items()] + [(None, "a b c"), (None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in NAMES})
    return frame.repartition(2)


def own(frame, results):
    taken = {r.lower() for r in results}
    return [c for c in frame.columns if c.lower() not in taken]


def operators(labels, byte_vocabulary, word_vocabulary):
    return {
        "packing": (lambda d: packing.pack(d, byte_vocabulary), None),
        "fingerprints": (fingerprints.fingerprint, None),
        "licenses": (licenses.scan, licenses.RESULTS),
        "classifier": (lambda d: quality_classifier.quality_classifier(d, labels), quality_classifier.RESULTS),
        "join": (ngram_join.ngram_join, None),
        "counts": (lambda d: token_counts.histogram(d, byte_vocabulary), None),
        "rules": (
            lambda d: quality_rules.quality_rules(d, labels), [*quality_rules.COUNTS, "base_failed", "kept", "llr"]
        ),
        "sharding": (sharding.shard, sharding.RESULTS),
        "bpe": (lambda d: bpe.encode(d, word_vocabulary), [*bpe.RESULTS, "ids"]),
    }


@pytest.mark.parametrize("name", list(operators(None, None, None)))
def test_long_texts_and_clashing_names(name, spark, long_docs, labels, byte_vocabulary, word_vocabulary):
    run, results = operators(labels, byte_vocabulary, word_vocabulary)[name]
    out = run(long_docs)
    rows = out.collect()
    if results is not None:
        assert out.columns == [*own(long_docs, results), *[c for c in out.columns if c in results]]
    if name in ("packing", "counts"):
        tokens = sum(r["length"] if name == "packing" else r["n_tokens"] for r in rows)
        assert tokens > len(LONG)
    else:
        assert Counter(r["doc_id"] for r in rows) == Counter([*LONG, None, None])
    assert isinstance(run(long_docs.where("false")).count(), int)


def test_long_texts_have_exact_counts(long_docs, labels):
    for r in quality_rules.quality_rules(long_docs, labels).collect():
        assert r["n_words"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))


@pytest.mark.parametrize("stage", range(3))
def test_stages_keep_names_and_rows_without_ids(stage, spark, tmp_path, long_docs):
    spark.createDataFrame(
        [(3, 1, 0)], "doc_id long, quality int, toxic int"
    ).write.parquet(str(tmp_path / "labels.parquet"))
    run = corpus_pipeline.STAGES[stage][1]
    once = long_docs.unionByName(
        spark.createDataFrame(
            [(None, "a b c d e f g " * 20), (9, "a b c d e f g " * 20)], "doc_id long, text string"
        ).withColumns({c: F.lit("clash") for c in NAMES})
    )
    out = run(spark, once, str(tmp_path))
    assert out.columns == long_docs.columns
    assert len(out.collect()) <= once.count()
    assert run(spark, once.where("false"), str(tmp_path)).count() == 0


def test_pages_without_anything(spark):
    rows = [
        (1, None, None),
        (None, None, "x"),
        (2, "http://a/b", "y" * 3_000_000),
        (3, "http://a/b", "y" * 3_000_000),
        (3, "http://a/b", ""),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns(
        {"Payload_Bytes": F.lit(1), "_sum": F.lit(2), "_owner": F.lit(3)}
    )
    got = warc.archived(pages).collect()
    assert Counter(r["page_id"] for r in got) == Counter([1, None, 2, 3, 3])
    assert {
        (r["page_id"], r["record_type"], r["refers_to"]) for r in got if r["payload_bytes"] == 3_000_000
    } == {(2, "response", None), (3, "revisit", 2)}
    assert warc.archived(pages.where("false")).count() == 0
