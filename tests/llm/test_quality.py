import math
import re
import struct
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from lodestone.llm import _probe, _shared, _words, ngram_model, quality_classifier, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    words = WORD.findall(text)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_rule_counts_against_loops(docs, labels):
    rows = quality_rules.quality_rules(docs, labels).collect()
    texts = Counter((r["doc_id"], r["text"]) for r in docs.collect())
    assert Counter((r["doc_id"], r["text"]) for r in rows) == texts
    for r in rows:
        want = counts(r["text"] or "")
        assert tuple(r[c] for c in quality_rules.COUNTS) == want, r["text"]
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        assert r["base_failed"] == failed and r["kept"] == (not failed and r["llr"] >= quality_rules.LEAST_RATIO)
    assert [f.name for f in quality_rules.quality_rules(docs, labels).schema][:3] == ["doc_id", "text", "source"]


def test_ratios_against_a_dictionary(docs, labels):
    """The same models and scores from plain dictionaries over words."""
    model = ngram_model.fit(docs, labels)
    good = {6, 10}
    raw, target = Counter(), Counter()

    def cells(text):
        block = _words.parse(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))
        return ngram_model.features(block)[1].tolist()

    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    for i, t in rows:
        raw.update(cells(t))
        if i in good:
            target.update(cells(t))
    n, m = sum(raw.values()), sum(target.values())
    for c in list(raw)[:500]:
        want = np.log((target[c] + ngram_model.PRIOR) / (raw[c] * m / n + ngram_model.PRIOR))
        assert abs(model[c] - want) < 1e-9
    scored = {(r["doc_id"], r["text"]): r["llr"] for r in quality_rules.quality_rules(docs, labels).collect()}
    for i, t in rows:
        found = cells(t)
        assert abs(scored[(i, t)] - (sum(model[c] for c in found) / len(found) if found else 0)) < 1e-9 if t else True


def test_no_labels_and_no_rows(docs, labels):
    assert all(r["llr"] == 0 for r in quality_rules.quality_rules(docs, labels.where("false")).collect())
    assert quality_rules.quality_rules(docs.where("false"), labels).count() == 0
    assert quality_classifier.quality_classifier(docs.where("false"), labels).count() == 0


M64 = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15 | 1


def mixed(x):
    x &= M64
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & M64
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & M64
    return x ^ (x >> 31)


def cells_by_loops(text):
    """Cells of words and pairs of words, from plain integers."""
    hashes = []
    for w in WORD.findall(text):
        value = sum(mixed((b + 1) * 0xD1342543DE82EF95) * pow(BASE, i, 1 << 64) for i, b in enumerate(w.encode()))
        hashes.append(mixed(value + len(w.encode())))
    pairs = [mixed(mixed(a + 1) * BASE + b + 2) for a, b in zip(hashes, hashes[1:], strict=False)]
    return [h >> (64 - ngram_model.BITS) for h in hashes + pairs]


def gumbel(doc_id):
    h = 42 if doc_id is None else xxhash.xxh64(struct.pack("<q", doc_id), seed=42).intdigest()
    h = xxhash.xxh64(struct.pack("<i", quality_classifier.SEED), seed=h).intdigest()
    return -math.log(-math.log(((h >> 12) + 0.5) / (1 << 52)))


def test_resampling_against_loops(docs, labels):
    """Models, weights, noise and the choice of k, from plain loops over collected rows."""
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    raw, target = Counter(), Counter()
    for i, t in rows:
        raw.update(cells_by_loops(t))
        if i in (6, 10):
            target.update(cells_by_loops(t))
    n, m, prior = sum(raw.values()), sum(target.values()), ngram_model.PRIOR
    model = {c: math.log((target[c] + prior) / (raw[c] * m / n + prior)) for c in raw}
    want = []
    for i, t in rows:
        own = cells_by_loops(t)
        llr = sum(model[c] for c in own) / len(own) if own else 0.0
        want.append((i, t, llr, llr * quality_classifier.TEMPER + gumbel(i), bool(own)))
    shares = [
        math.floor(
            math.exp(min(0.0, quality_classifier.TEMPER * (x[2] - quality_classifier.LEAST_RATIO))) * 1e6
        ) for x in want if x[4]
    ]
    k = round(sum(shares) / 1e6)
    last = sorted((x[3] for x in want if x[4]), reverse=True)[k - 1]
    got = quality_classifier.quality_classifier(docs, labels).collect()
    assert 0 < k <= len(shares) and len(got) == len(want)
    by = {(i, t): (llr, key, filled and key >= last - 1e-9) for i, t, llr, key, filled in want}
    for r in got:
        llr, key, kept = by[(r["doc_id"], r["text"] or "")]
        assert abs(r["llr"] - llr) < 1e-9 and abs(r["gumbel_key"] - key) < 1e-6 and r["kept"] == kept
    again = {
        (
            r["doc_id"], r["text"], r["kept"]
        ) for r in quality_classifier.quality_classifier(docs.repartition(2), labels).collect()
    }
    assert again == {(r["doc_id"], r["text"], r["kept"]) for r in got}


def test_noise_matters_near_the_threshold(spark):
    """The sample isn't a threshold: of documents alike in weight some stay, but the best do stay."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality_classifier.quality_classifier(docs, labels, carry=["doc_id"]).collect()
    other = [r for r in rows if r["kept"] != (r["llr"] >= quality_classifier.LEAST_RATIO) and r["llr"]]
    assert len(other) > len(rows) / 1000 and all(r["kept"] for r in rows if r["llr"] > 0.02)


def test_held_out_accuracy(spark):
    """Trained on one half of labelled documents, the filters tell the other half apart."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    train = labels.where(F.xxhash64("doc_id") % 2 == 0)
    held = labels.join(train.select("doc_id"), "doc_id", "left_anti")
    kept = quality_classifier.quality_classifier(
        docs, train, carry=["doc_id"]
    ).join(held, "doc_id").groupBy("quality").agg(
        F.avg(F.col("kept").cast("int")).alias("kept")
    )
    share = dict(map(tuple, kept.collect()))
    assert share[1] > 0.98 and share[0] < 0.15


def test_passing_keeps_the_columns(docs, labels):
    for f in (quality_rules.passing, quality_classifier.passing):
        assert f(docs, labels).columns == docs.columns


def test_word_kernel_on_odd_bytes():
    texts = ["", "a", " a b\tc\n", "é\x0b日本\x0c x", "a\n\na", "\x1c\x1d"]
    for _, _, data, offsets in _shared.blocks(pa.array(texts)):
        block = _words.parse(data, offsets)
        got = [
            [
                bytes(data[s:e]).decode() for d, s, e in zip(block.doc, block.start, block.end, strict=True) if d == i
            ] for i in range(len(texts))
        ]
        assert got == [WORD.findall(t) for t in texts]


def test_probe_finds_exact_boundaries(spark):
    rng = np.random.default_rng(1)
    keys = sorted([*rng.integers(0, 1 << 62, 300).tolist(), *[5] * 40, 0, (1 << 62) - 1])
    rows = spark.createDataFrame([(k, 2) for k in keys], "key long, weight long")
    for target in (0, 2, 60, 301, 2 * len(keys)):
        (b, below), = _probe.boundaries(rows, [target], 0, lower=True)
        assert below == 2 * sum(k < b for k in keys) and below <= max(0, target)
        more = [2 * sum(k <= x for k in keys) for x in keys if 2 * sum(k <= x for k in keys) <= target]
        assert below == max([0, *more])
