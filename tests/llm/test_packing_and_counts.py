import random
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodestone.llm import _bpe, _shared, packing, token_counts


def placed(spark, counts, size):
    """Places of all documents, checked: each rank of a length once, sequences without holes or overflow."""
    rows = packing.best_fit(
        spark.createDataFrame(list(counts.items()) or [(1, 0)], "length long, n long").where("n > 0"), size
    ).collect()
    used, ranks = defaultdict(list), defaultdict(list)
    for r in rows:
        ranks[r["length"]] += range(r["done"], r["done"] + r["n"])
        for i in range(r["n"]):
            used[r["first"] + i].append((r["offset"], r["length"]))
    assert {k: sorted(v) for k, v in ranks.items()} == {k: list(range(n)) for k, n in counts.items()}
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    return len(used), len(rows)


def one_by_one(counts, size):
    """Best fit decreasing, document by document: the number of sequences."""
    gaps: list[int] = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            at = bisect_left(gaps, length)
            gap = gaps.pop(at) if at < len(gaps) else size
            if gap > length:
                insort(gaps, gap - length)
            elif gap == length:
                insort(gaps, 0)
    return len(gaps)


@pytest.mark.parametrize("seed", range(6))
def test_best_fit_against_one_by_one(spark, seed):
    rnd = random.Random(seed)
    kinds = [
        {rnd.randint(1, 64): rnd.randint(1, 300) for _ in range(40)},
        {k: 50 for k in range(1, 33)},
        {1: 5000},
        {3: 700, 64: 5},
        {k: rnd.randint(1, 9) for k in range(20, 65)} | {2: 100},
        {33: 40, 31: 10, 30: 60, 2: 7, 64: 1},
    ]
    counts = kinds[seed]
    n, _ = placed(spark, counts, 64)
    want = one_by_one(counts, 64)
    least = max(-(-sum(k * v for k, v in counts.items()) // 64), sum(v for k, v in counts.items() if k > 32))
    assert n <= 1.01 * want + 1 and n <= 11 / 9 * least + 4, (n, want, least)


def test_best_fit_of_a_corpus(spark):
    """Lengths like those of texts: at most a hundredth more sequences than document by document, few rounds and runs."""
    rng = np.random.default_rng(4)
    lengths = np.minimum(1024, np.maximum(1, rng.lognormal(5, 1, 20_000).astype(int)))
    counts = {int(k): int(v) for k, v in zip(*np.unique(lengths, return_counts=True), strict=True)}
    n, runs = placed(spark, counts, 1024)
    assert n <= 1.01 * one_by_one(counts, 1024) and runs < len(lengths)


def test_pack(docs, byte_vocabulary):
    rows = packing.pack(docs, byte_vocabulary).collect()
    model = _bpe.tokenizer(_bpe.read(byte_vocabulary))
    source = [(r["doc_id"], r["text"] or "") for r in docs.select("doc_id", "text").collect()]
    want = Counter()
    for doc_id, text in source:
        ids = np.array([*model.encode(text, add_special_tokens=False).ids, 2], "<u4")
        first = len(ids) if len(ids) <= 1024 else len(ids) % 1024 or 1024
        starts = [0, *range(first, len(ids), 1024)]
        for k, a in enumerate(starts):
            part = ids[a : (starts[k + 1] if k + 1 < len(starts) else len(ids))]
            want[(doc_id, k, a, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter(tuple(r)[:5] for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024


def test_empty_table(docs, byte_vocabulary):
    none = docs.where("false")
    assert packing.pack(none, byte_vocabulary).count() == 0
    assert token_counts.histogram(none, byte_vocabulary).count() == 0


def test_counts(docs, byte_vocabulary, spark):
    model = _bpe.tokenizer(_bpe.read(byte_vocabulary))
    n = sorted(len(model.encode(r["text"] or "", add_special_tokens=False).ids) for r in docs.select("text").collect())
    hist = token_counts.histogram(docs, byte_vocabulary)
    rows = {r["length"]: r for r in hist.collect()}
    assert {k: r["n_docs"] for k, r in rows.items()} == Counter(n)
    for k, r in rows.items():
        assert r["n_tokens"] == k * r["n_docs"]
        assert r["docs_at_least"] == sum(x >= k for x in n) and r["tokens_at_least"] == sum(x for x in n if x >= k)
        assert r["truncated_tokens"] == sum(min(x, k) for x in n) and abs(
            r["quantile"] - sum(x <= k for x in n) / len(n)
        ) < 1e-12
    limits = spark.createDataFrame([(0,), (5,), (10**6,)], "limit_tokens long")
    for r in token_counts.truncated_totals(hist, limits).collect():
        assert r["truncated_tokens"] == sum(
            min(x, r["limit_tokens"]) for x in n
        ) and r["docs_longer"] == sum(x > r["limit_tokens"] for x in n)


def test_every_limit_is_answered(spark):
    lengths = [0, 3, 3, 7, 1023, 1024, 5000, 5000, 20_011]
    n = sorted(lengths)
    seen = [(k, n.count(k), sum(x >= k for x in n), sum(x for x in n if x >= k)) for k in sorted(set(n))]
    hist = spark.createDataFrame(
        seen, "length long, n_docs long, docs_at_least long, tokens_at_least long"
    ).repartition(3)
    limits = spark.range(0, 20_500).withColumnRenamed("id", "limit_tokens")
    got = {
        r["limit_tokens"]: (
            r["docs_longer"], r["truncated_tokens"]
        ) for r in token_counts.truncated_totals(hist, limits.union(limits)).collect()
    }
    assert got == {k: (sum(x > k for x in n), sum(min(x, k) for x in n)) for k in range(20_500)}
    assert [
        tuple(r) for r in token_counts.truncated_totals(hist.where("false"), limits.where("limit_tokens = 5")).collect()
    ] == [(5, 0, 0)]


def test_plans_of_a_round_stay_small(spark, monkeypatch):
    windows = []
    stage = _shared.Scratch.stage

    def seen(self, df, name, short=False):
        windows.append(str(df._jdf.queryExecution().optimizedPlan()).count("Window ["))
        return stage(self, df, name, short)

    monkeypatch.setattr(_shared.Scratch, "stage", seen)
    counts = spark.createDataFrame([(3, 5), (4, 2), (7, 3), (10, 1)], "length int, n long")
    with _shared.small_plans(spark):
        found = packing.best_fit(counts, 10).collect()
    assert sum(r["n"] for r in found) == 11
    assert 0 < max(windows) <= 8
