import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import _components, _words, ngram_join


def grams(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {
        tuple(words[i : i + n]) for i in range(len(words) - n + 1)
    } if len(words) >= n else {tuple(words)} if words else set()


def brute(rows, n, num, den):
    """Component of each row by comparing all pairs; rows without an id link like others."""
    sets = [grams(t, n) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
            root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return sorted(
        ((k, len(s), least.get(find(i)) if s else k) for i, ((k, _), s) in enumerate(zip(rows, sets, strict=True))),
        key=str,
    )


@pytest.mark.parametrize(("n", "num"), [(4, 85), (5, 80), (2, 60)])
def test_against_all_pairs(spark, docs, n, num):
    rnd = random.Random(n)
    words = [f"w{i}" for i in range(300)]
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for base in range(12):
        text = [rnd.choice(words) for _ in range(rnd.randint(4, 160))]
        for copy in range(5):
            other = list(text)
            for _ in range(rnd.randint(0, max(1, len(text) // 40))):
                other[rnd.randrange(len(other))] = rnd.choice(words)
            rows.append((100 + 10 * base + copy, " ".join(other)))
    # a family around one text, whose members are often too far apart to be linked with each other
    text = [rnd.choice(words) for _ in range(120)]
    for copy in range(40):
        other = list(text)
        for at in rnd.sample(range(120), 2):
            other[at] = rnd.choice(words)
        rows.append((1000 + copy, " ".join(other)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((tuple(r) for r in ngram_join.ngram_join(frame, n=n, num=num, den=100).collect()), key=str)
    assert got == brute(rows, n, num, 100)


@pytest.mark.parametrize("rate", [16, 1])
def test_lots_and_poor_sketches_lose_nothing(spark, monkeypatch, rate):
    """Small lots have to meet each other; poor sketches make pairs fail, so blocks are searched with whole sets."""
    monkeypatch.setattr(ngram_join, "LOT", 8)
    monkeypatch.setattr(ngram_join, "SKETCH_RATE", rate)
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(50)]
    text = [rnd.choice(words) for _ in range(100)]
    rows = []
    for copy in range(60):
        other = list(text)
        for at in rnd.sample(range(100), rnd.randint(1, 4)):
            other[at] = rnd.choice(words)
        rows.append((copy if copy % 7 else None, " ".join(other)))
    got = sorted(
        (
            tuple(r) for r in ngram_join.ngram_join(
                spark.createDataFrame(rows, "doc_id long, text string"), n=3, num=80, den=100
            ).collect()
        ),
        key=str,
    )
    assert got == brute(rows, 3, 80, 100)


@pytest.mark.parametrize("few", [256, 0])
def test_groups_of_one_hub_make_one_block(spark, monkeypatch, few):
    """A set is moved once for each hub, not for each signature; no pair of an open group is lost."""
    monkeypatch.setattr(ngram_join, "FEW", few)
    rnd = random.Random(3)
    text = [f"w{rnd.randrange(50)}" for _ in range(120)]
    rows = []
    for copy in range(40):
        other = list(text)
        for at in rnd.sample(range(120), 2):
            other[at] = f"x{copy}"
        rows.append((copy, " ".join(other)))
    join = ngram_join._Join(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85, 100, "text", "doc_id")
    groups = join.groups()
    marks = join.marks(join.measure(), groups)
    alone = spark.createDataFrame([], "node long, root long")
    blocks = join.blocks(groups, alone, marks).select("key", "node").toPandas()
    wide = groups.where("n > 2").toPandas()
    if few:
        assert len(blocks) == len(wide.groupby(["hub", "node"])) < len(wide) / 4
    assert not blocks.duplicated().any() and len(blocks) <= len(wide)

    def pairs(frame, key):
        return {p for _, own in frame.groupby(key) for p in combinations(sorted(own["node"]), 2)}

    assert pairs(wide, "grp") <= pairs(blocks, "key")


def test_near_rows_of_a_block():
    """Only rows that may be linked with one of another component are searched with whole sets."""
    import pyarrow as pa

    sets = [range(100), range(3, 103), range(500, 600), range(500, 601), range(900, 1000)]
    value = _words.mix(np.array([x for s in sets for x in s], np.uint64))
    size = np.array([len(s) for s in sets])
    marks = ngram_join.sketches(ngram_join.sketch_bits(size, 85, 100), np.repeat(np.arange(5), size), value)
    rows = {"key": [1] * 5, "node": range(5), "root": [0, 1, 2, 2, 4], "n_shingles": size, "sketch": marks}
    block = pa.RecordBatch.from_arrays([pa.array(v) for v in rows.values()], list(rows))
    (got,) = ngram_join._near(85, 100)(iter([block]))
    assert sorted(got.column(1).to_pylist()) == [0, 1]


@pytest.mark.parametrize(("num", "size"), [(85, 8), (85, 30), (85, 200), (80, 12), (80, 60), (80, 900), (60, 40)])
def test_similar_sets_share_a_signature(num, size):
    rng = np.random.default_rng(size)
    bands = ngram_join.Bands(num, 100)
    for _ in range(300):
        b = int(rng.integers(size, 2 * size))
        a = int(rng.integers(-(-b * num // 100), b + 1))
        both = -(-num * (a + b) // (100 + num))
        if both > a:
            continue
        pool = np.unique(rng.integers(0, 1 << 63, a + b, dtype=np.int64).astype(np.uint64))
        x, y = np.sort(pool[:a]), np.sort(np.concatenate((pool[:both], pool[a : a + b - both])))
        doc = np.repeat([0, 1], [len(x), len(y)])
        d, s = ngram_join.signatures(bands, np.array([len(x), len(y)]), doc, np.concatenate((x, y)))
        same = len(x) == len(y) == both
        assert same or set(s[d == 0].tolist()) & set(s[d == 1].tolist())
        width = ngram_join.sketch_bits(np.array([len(x), len(y)]), num, 100)
        marks = ngram_join.sketches(width, doc, np.concatenate((x, y)))
        assert [8 * len(m) for m in marks] == width.tolist()
        wide = [int.from_bytes(m, "little") for m in marks]
        while width[0] != width[1]:
            k = int(np.argmax(width))
            width[k] //= 2
            wide[k] = (wide[k] >> int(width[k])) ^ (wide[k] & ((1 << int(width[k])) - 1))
        assert (wide[0] ^ wide[1]).bit_count() <= len(x) + len(y) - 2 * both


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(50)]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for u, v in edges:
            root[u] = root[v] = min(root[u], root[v])
    got = dict(map(tuple, _components.components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {x: r for x, r in root.items() if any(u != v and x in (u, v) for u, v in edges)}


def test_joined_components(spark):
    first, more = [(1, 2), (3, 4), (5, 6)], [(2, 3), (6, 9), (20, 21)]
    roots = _components.components(spark.createDataFrame(first, "a long, b long"), "a", "b")
    got = _components.joined(roots, spark.createDataFrame(more, "a long, b long"), "a", "b")
    assert sorted(map(tuple, got.collect())) == [
        (1, 1), (2, 1), (3, 1), (4, 1), (5, 5), (6, 5), (9, 5), (20, 20), (21, 20)
    ]


def test_representatives(spark, docs):
    named = docs.withColumns({"row": F.lit(1), "words": F.lit("clash"), "_id": F.lit(2), "node": F.lit(3)})
    kept = ngram_join.representatives(named, n=5, num=80, den=100)
    assert kept.columns == named.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert None not in ids and len(ids) == len(set(ids)) and 6 in ids and 7 not in ids and 0 in ids and 1 in ids
    assert ngram_join.ngram_join(docs.where("false")).count() == 0
    assert ngram_join.representatives(docs.where("false")).count() == 0


def test_rows_with_one_id_lose_nothing(spark):
    """Equal ids with unlike texts all stay; of copies one stays, whatever their ids."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(5, a), (5, b), (3, a), (3, c), (3, c), (None, c + " end"), (None, None), (None, None)]
    got = sorted(
        map(tuple, ngram_join.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()),
        key=str,
    )
    assert got == sorted([(5, b), (3, a), (3, c), (None, None), (None, None)], key=str)


def test_hash_mix_is_a_bijection_on_a_sample():
    x = np.arange(100_000, dtype=np.uint64)
    assert len(np.unique(_words.mix(x))) == len(x)
