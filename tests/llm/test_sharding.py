import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lodestone.llm import sharding


def check(rows, n=16):
    by = defaultdict(list)
    for r in rows:
        text = (r["text"] or "").encode()
        assert r["size"] == len(text) + 1 and r["text_crc32"] == zlib.crc32(text) and r["law"] == "bytes" and r[
            "grown_shard"
        ] is None
        by[r["shard"]].append(r)
    assert set(by) <= set(range(n))
    for own in by.values():
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
    return {s: sum(r["size"] for r in own) for s, own in by.items()}


def test_small_tables(docs):
    rows = sharding.shard(docs.withColumn("shard", F.lit("clash"))).collect()
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter((r["doc_id"], r["text"]) for r in docs.collect())
    check(rows)
    assert sharding.shard(docs.where("false")).count() == 0


def test_even_bytes_and_whole_groups(spark):
    rows = [
        (i, f"text {i} " + "word " * (i % 37)) for i in range(3000)
    ] + [(10_000 + i, "copy " * 20) for i in range(60)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sizes = check(got)
    mean = sum(sizes.values()) / 16
    assert all(abs(x - mean) <= 0.02 * mean for x in sizes.values())
    where = defaultdict(set)
    for r in got:
        where[r["text"]].add(r["shard"])
    assert all(len(x) == 1 for x in where.values())


def test_a_text_with_a_third_of_the_rows_is_dealt_out(spark):
    rows = [(i, f"text {i} " + "word " * 20) for i in range(2000)] + [(10_000 + i, "word " * 20) for i in range(1000)]
    sizes = check(sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    mean = sum(sizes.values()) / 16
    assert len(sizes) == 16 and all(abs(x - mean) <= 0.03 * mean for x in sizes.values())


def test_copies_without_ids_are_dealt_out_too(spark):
    """A third of all rows have one text and no id; columns have names that the operator might use itself."""
    rows = [(i, f"text {i} " + "word " * 20) for i in range(2000)] + [(None, "word " * 20)] * 1000
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns(
        {c: F.lit(1) for c in ("_id", "_n", "_key", "_nr", "row", "Shard", "_run")}
    )
    out = sharding.shard(docs)
    assert out.columns == [*[c for c in docs.columns if c != "Shard"], *sharding.RESULTS]
    sizes = check(out.drop("_id").collect())
    mean = sum(sizes.values()) / 16
    assert len(sizes) == 16 and all(abs(x - mean) <= 0.1 * mean for x in sizes.values())
