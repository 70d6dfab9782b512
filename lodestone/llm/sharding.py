"""Sharding: shards of near-equal bytes by histogram sort over a text-hash key, copies of a text together.

Documents lie along the key (a hash of the text), so equal texts are neighbours. Candidate boundaries are counted
exactly over all partitions and refined until each splitter is within the tolerance; then rows move once, to number
the slots. Texts whose copies weigh more than the tolerance are placed one by one, heaviest first, onto the emptiest
shard, and the splitters fill up what is left; a text whose copies outweigh a shard is dealt out row by row, in several
pieces.

A null text counts as empty (size 1). Null, repeated or tied ids are fine: rows are told apart by a number of their own,
which is written down once. Very long texts are read once, and only their size, checksum and hash go on. Input columns
named like a result, in any case of letters, are replaced. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _probe, _shared

#: Share of a shard by which a splitter may miss its target.
TOLERANCE = 0.01
RESULTS = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]


def _piece(pieces: Column) -> Column:
    return F.pmod(F.xxhash64(F.col("_nr"), F.lit(7)), pieces)


def _levels(load: list[int], rest: int) -> list[int]:
    """Weight to pour into all shards but the last, summed up, so that they fill to one level, as water would."""
    n, low = len(load), sorted(load)
    levels = [(rest + sum(low[:m])) / m for m in range(1, n + 1)]
    level = next((v for m, v in enumerate(levels, 1) if m == n or v <= low[m]), 0.0)
    room, targets = 0.0, []
    for x in load[:-1]:
        room += max(0.0, level - x)
        targets.append(round(room))
    return targets


def shard(
    docs: DataFrame, n_shards: int = 16, *, text_col: str = "text", tolerance: float = TOLERANCE, carry: list[str] | None = None
) -> DataFrame:
    """docs (or its columns in `carry`) with size, text_crc32, law ('bytes'), shard, slot and grown_shard (null here)."""
    spark = docs.sparkSession
    text = _shared.text_or_empty(text_col)
    rows = docs.select(
        _shared.carried(docs.columns if carry is None else carry, RESULTS).alias("row"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(text), 2).alias("_key"),
        F.monotonically_increasing_id().alias("_nr"),
    )
    # read once; a row's number stays what it is
    rows = _shared.staged(rows, "shard-rows")

    scratch = _shared.Scratch(spark)
    groups = scratch.stage(
        rows.groupBy("_key").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("copies")), "shard-groups"
    )
    total = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    full = max(1, total / n_shards)
    # at most n_shards / tolerance texts weigh more than this, whatever the corpus
    heavy = []
    for r in groups.where(F.col("bytes") > full * tolerance).collect():
        wanted = -(-4 * r["bytes"] // int(full + 1))
        heavy.append((r["_key"], r["bytes"], max(1, min(r["copies"], wanted)) if r["bytes"] > full else 1))
    items = [(b, k, 1, 0) for k, b, n in heavy if n == 1]
    if any(n > 1 for _, _, n in heavy):
        parted = spark.createDataFrame([(k, n) for k, _, n in heavy if n > 1], "_key long, _pieces int")
        dealt = rows.join(F.broadcast(parted), "_key").groupBy(
            "_key", "_pieces", _piece(F.col("_pieces")).alias("piece")
        )
        items += [
            (r["bytes"], r["_key"], r["_pieces"], r["piece"]) for r in dealt.agg(F.sum("size").alias("bytes")).collect()
        ]
    load, placed = [0] * n_shards, []
    for b, k, n, piece in sorted(items, reverse=True):
        to = min(range(n_shards), key=lambda s: (load[s], s))
        load[to] += b
        placed.append((k, n, piece, to))
    alone = F.broadcast(spark.createDataFrame([(k,) for k, _, _ in heavy] or [(-1,)], "_key long"))
    light = groups.join(alone, "_key", "left_anti").select(F.col("_key").alias("key"), F.col("bytes").alias("weight"))
    splits = [b for b, _ in _probe.boundaries(light, _levels(load, total - sum(load)), int(full * tolerance / 2))]
    scratch.clear()

    to = F.lit(0)
    for b in splits:
        to = to + (F.col("_key") >= F.lit(b)).cast("int")
    # both tables are bounded by n_shards / tolerance and the pieces of a text
    fixed = spark.createDataFrame(placed or [(-1, 1, 0, 0)], "_key long, _n int, _piece int, _shard int")
    known = rows.join(F.broadcast(fixed.select("_key", "_n").distinct()), "_key", "left")
    known = known.withColumn("_piece", _piece(F.coalesce("_n", F.lit(1))).cast("int"))
    dealt = known.join(F.broadcast(fixed.select("_key", "_piece", "_shard")), ["_key", "_piece"], "left")
    dealt = dealt.withColumn("shard", F.coalesce("_shard", to))

    # slots: even runs within each shard by a hash of the row's number, so that no task numbers a whole shard
    runs = max(64, -(-4 * _shared.n_partitions(spark) // n_shards))
    dealt = dealt.withColumn("_run", F.pmod(F.xxhash64("_nr"), F.lit(runs)).cast("int"))
    counted = sorted(tuple(r) for r in dealt.groupBy("shard", "_run").count().collect())  # n_shards * runs rows at most
    starts, seen = [], dict.fromkeys(range(n_shards), 0)
    for s, run, n in counted:
        starts.append((s, run, seen[s]))
        seen[s] += n
    offsets = spark.createDataFrame(starts or [(-1, 0, 0)], "shard int, _run int, _start long")
    numbered = dealt.withColumn("_nth", F.row_number().over(Window.partitionBy("shard", "_run").orderBy("_key", "_nr")))
    numbered = numbered.join(F.broadcast(offsets), ["shard", "_run"])
    return numbered.select(
        "row.*", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (
            F.col("_start") + F.col("_nth") - 1
        ).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
