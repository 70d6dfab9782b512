"""The pipeline against a version that runs in plain Python over collected rows."""

import math
import re
from collections import Counter
from itertools import combinations

from pyspark.sql import functions as F
from test_quality import WORD, cells_by_loops, counts, gumbel

import corpus_pipeline
from lodestone.llm import _shared, ngram_join, ngram_model, quality_classifier, quality_rules

SF = "/root/testdata/sf0.001"


def scores(texts, good):
    """The mean log-likelihood ratio of each text by models of these texts, from plain loops; 0 without words."""
    own = {k: cells_by_loops(t) for k, t in texts.items()}
    raw, target = Counter(c for x in own.values() for c in x), Counter(
        c for k, x in own.items() if k in good for c in x
    )
    n, m, prior = sum(raw.values()), sum(target.values()), ngram_model.PRIOR
    model = {c: math.log((target[c] + prior) / (raw[c] * m / n + prior)) for c in raw}
    return {k: sum(model[c] for c in x) / len(x) if x else 0.0 for k, x in own.items()}


def classified(texts, good):
    q = quality_classifier
    llr = {k: x for k, x in scores(texts, good).items() if WORD.search(texts[k])}
    share = sum(math.floor(math.exp(min(0.0, q.TEMPER * (x - q.LEAST_RATIO))) * 1e6) for x in llr.values()) / 1e6
    return set(sorted(llr, key=lambda k: -(llr[k] * q.TEMPER + gumbel(k)))[: round(share)])


def ruled(texts, good):
    llr = scores(texts, good)
    found = {k: counts(t) for k, t in texts.items()}
    return {k for k, (words, *_, repeated) in found.items() if words >= 50 and 100 * repeated <= 50 * words and llr[k] >= quality_rules.LEAST_RATIO}


def distinct(texts, good):
    def grams(t):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = {k: grams(t) for k, t in texts.items()}
    root = {k: k for k in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(texts), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {k for k in texts if find(k) == k}


def test_stages_against_loops(spark):
    """Every filter, on what the one before has kept, against plain Python over collected rows; then the sequences."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "quality_rules", "ngram_jaccard_join", "best_fit_packing"
    ]
    assert corpus_pipeline.ORACLE_SQL is None
    good = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    have = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for (_, stage), plain in zip(corpus_pipeline.STAGES[:-1], (classified, ruled, distinct), strict=True):
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        left = {r["doc_id"] for r in out.collect()}
        assert left == plain(have, good) and 0 < len(left) < len(have)
        docs = docs.join(out.select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
        have = {k: have[k] for k in left}
    packed = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == set(have)
    assert packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 1024").isEmpty()


def test_near_copies_are_dropped_by_row(spark):
    """Equal ids with other texts lose nothing, and rows without ids are compared as well."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [
        (1, a),
        (2, a + " end"),
        (2, b),
        (3, c),
        (3, d),
        (3, d),
        (None, a),
        (None, a),
        (None, "z " + d),
        (None, "x y"),
        (None, "x y"),
        (None, None),
        (None, None),
        (5, "x y"),
        (6, "x y"),
        (None, c[::-1]),
        (None, c[::-1]),
        (None, c[::-1] + " end"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s")).repartition(3)
    out = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert out.columns == docs.columns
    got = Counter((r["doc_id"], r["text"]) for r in out.collect())
    # of the last group, whose rows have no id, any one stays
    last = [k for k in got if k[0] is None and k[1] and k[1].startswith(c[::-1])]
    assert len(last) == 1 and got.pop(last[0]) == 1
    assert got == Counter([(1, a), (2, b), (3, c), (3, d), (5, "x y"), (None, None), (None, None)])


def test_texts_that_stay_are_not_moved(spark, monkeypatch):
    """Near copies are taken off without a shuffle of the other texts, however many rows go; a full table loses nothing."""
    texts = [" ".join(f"w{i}x{j}" for j in range(60)) for i in range(300)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, texts[i] + " end") for i in range(0, 300, 10)]
    docs = spark.createDataFrame([*rows, (7, texts[7]), (None, texts[0])], "doc_id long, text string").repartition(4)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for words in (ngram_join.WORDS, 1):
            monkeypatch.setattr(ngram_join, "WORDS", words)
            split, seen = ngram_join._split, []
            monkeypatch.setattr(ngram_join, "_split", lambda *x: seen.append(split(*x)) or seen[-1])  # noqa: B023
            out = corpus_pipeline.drop_near_copies(spark, docs, SF)
            monkeypatch.setattr(ngram_join, "_split", split)
            got = Counter((r["doc_id"], r["text"]) for r in out.collect())
            assert got == Counter(enumerate(texts))
            sure, named = (x.count() for x in seen[0])
            assert sure + named == docs.count() and named >= 33
            # the 31 near copies and the two equal rows, and few that share a bit with one of them
            if words > 1:
                assert named <= 40
                plan = seen[0][0].select("doc.*")._jdf.queryExecution().sparkPlan().toString()
                assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "text" in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_garbage_of_staged_tables_is_collected(spark, monkeypatch):
    swept = []
    monkeypatch.setattr(_shared, "sweep", swept.append)
    for _ in range(2 * _shared.SWEEP_EVERY):
        _shared.staged(spark.range(3), "few").count()
    assert len(swept) == 2
