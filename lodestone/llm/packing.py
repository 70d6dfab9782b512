"""Best-fit packing of tokenised documents into sequences, in bulk-synchronous rounds.

Documents of one length, and gaps of one size in neighbouring sequences, can stand for each other; so both sides are
tables of runs. In each round both are sorted together, a successor sweep offers every document the smallest gap that
holds it, conflicts are settled by rank, and the gaps are updated; where the longest document fits no gap, sequences are
opened. Rounds repeat until every document has its place. They see runs only, whose number follows the size of a
sequence; ranking the documents and carrying out the matches run over all partitions.

Null and empty texts are one end token. Documents longer than a sequence are cut so that only the first piece is short.
Rows with equal or null ids are packed each for itself, ties in length go by id and then by a number of the piece. Very
long texts are encoded as a whole. Other input columns aren't read. An empty table gives an empty result. The pipeline's
last stage, pack(), is this operator as it is.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _bpe, _shared

SEQUENCE = 1024
END_ID = 2


#: The columns of a round: documents still to be placed, gaps, and matches.
_STATE = "kind string, length long, done long, left long, gap long, first long, n long, offset long"
_DOC, _GAP, _MATCH = "doc", "gap", "match"
#: Documents of at most this share of a sequence may go into gaps several at once.
SMALL = 32


def _gap_rows(gaps: DataFrame) -> DataFrame:
    """gap, first and n as rows of a round."""
    none = F.lit(None).cast("long")
    return gaps.select(
        F.lit(_GAP).alias("kind"),
        none.alias("length"),
        none.alias("done"),
        none.alias("left"),
        "gap",
        "first",
        "n",
        none.alias("offset"),
    )


def _without(docs: DataFrame, matches: DataFrame) -> DataFrame:
    """Documents less those of the matches, which always take the next ranks of a length."""
    used = matches.groupBy("length").agg(F.sum("n").alias("used"))
    rest = docs.join(used, "length", "left").withColumn("used", F.coalesce("used", F.lit(0)))
    return rest.select(
        "kind",
        "length",
        (F.col("done") + F.col("used")).alias("done"),
        (F.col("left") - F.col("used")).alias("left"),
        "gap",
        "first",
        "n",
        "offset",
    ).where("left > 0")


def _swept(docs: DataFrame, gaps: DataFrame, size: int, bundle: int, small: int, widest: int, stage) -> DataFrame:
    """One successor sweep: the state after each document has been offered the smallest gap that holds it.

    Runs of documents and gaps are sorted together, the longest first and gaps before documents of their size. Going down,
    gaps are laid on a pile and documents take from its top, which is their successor among the gaps not taken by a longer
    document: the conflict is settled by rank. The pile is never built: prefix sums give the levels of it that a run lays
    or takes, and in each stretch of levels a taking run meets the run that laid it last. A gap takes one document, or
    `bundle` documents of one length, if that is at most `small`.

    What several steps read is staged by stage(rows, name): else the plan would have it once for each way that leads to
    it, and plans of that size fill the driver.
    """
    none = F.lit(None).cast("long")
    many = F.when(F.col("length") <= small, bundle).otherwise(1)
    times = F.greatest(F.lit(1), F.least(many, F.floor(F.lit(widest) / F.col("length")), F.col("left"))).cast("long")
    taking = docs.withColumn("q", times).select(
        F.lit(1).alias("takes"), (
            F.col("length") * F.col("q")
        ).alias("size"), F.floor(F.col("left") / F.col("q")).alias("n"), F.col("done").alias("at"), "length", "q"
    )
    laying = gaps.select(
        F.lit(0).alias("takes"),
        F.col("gap").alias("size"),
        "n",
        F.col("first").alias("at"),
        none.alias("length"),
        none.alias("q"),
    )
    # at most `size` lengths and some runs of gaps for each: the size of a sequence bounds these rows, not the corpus
    order = Window.orderBy(F.desc("size"), "takes", "at", "length")
    runs = laying.union(taking).withColumn(
        "sum", F.sum(F.when(F.col("takes") == 0, F.col("n")).otherwise(-F.col("n"))).over(order)
    )
    runs = runs.withColumn("after", F.col("sum") - F.least(F.lit(0), F.min("sum").over(order)))
    runs = runs.withColumns(
        {"before": F.coalesce(F.lag("after").over(order), F.lit(0)), "pos": F.row_number().over(order)}
    )
    runs = runs.withColumns({"lo": F.least("before", "after"), "hi": F.greatest("before", "after")}).where("lo < hi")
    runs = stage(runs.select("takes", "size", "at", "length", "q", "pos", "lo", "hi"), "pack-runs")
    ends = runs.select(F.explode(F.array("lo", "hi")).alias("level")).distinct()
    by_level = Window.orderBy("level")
    ends = ends.select(
        "level",
        F.row_number().over(by_level).alias("k"),
        (F.lead("level").over(by_level) - F.col("level")).alias("width"),
    )
    low, high = ends.select(
        F.col("level").alias("lo"), F.col("k").alias("k_lo")
    ), ends.select(F.col("level").alias("hi"), F.col("k").alias("k_hi"))
    cut = runs.join(low, "lo").join(high, "hi").withColumn(
        "k", F.explode(F.sequence("k_lo", F.col("k_hi") - 1))
    ).join(ends, "k")
    near = Window.partitionBy("k").orderBy("pos")
    cut = cut.withColumns({"laid": F.lag(F.struct("at", "lo", "size")).over(near), "next": F.lead("takes").over(near)})
    cut = stage(cut, "pack-cut")
    inside = F.col("level") - F.col("lo")
    met = cut.where("takes = 1").withColumns(
        {"first": F.col("laid.at") + F.col("level") - F.col("laid.lo"), "gap": F.col("laid.size")}
    )
    # copy t of the run's units takes ranks of its own
    each = met.withColumn("t", F.explode(F.sequence(F.lit(0).cast("long"), F.col("q") - 1)))
    matches = each.select(
        F.lit(_MATCH).alias("kind"), "length", (
            F.col("at") + F.col("t") * (F.col("hi") - F.col("lo")) + inside
        ).alias("done"), none.alias("left"), none.alias("gap"), "first",
        F.col("width").alias("n"), (size - F.col("gap") + F.col("t") * F.col("length")).alias("offset"),
    )
    smaller = met.where("gap > size").select(
        (F.col("gap") - F.col("size")).alias("gap"), "first", F.col("width").alias("n")
    )
    left = cut.where("takes = 0 AND (next IS NULL OR next = 0)").select(
        F.col("size").alias("gap"), (F.col("at") + inside).alias("first"), F.col("width").alias("n")
    )
    return matches.union(_joined(smaller.union(left)))


def _joined(gaps: DataFrame) -> DataFrame:
    """State rows of gaps, where runs of one size whose sequences follow each other are one."""
    order = Window.partitionBy("gap").orderBy("first")
    begins = (F.coalesce(F.lag(F.col("first") + F.col("n")).over(order), F.lit(-1)) != F.col("first")).cast("int")
    gaps = gaps.withColumn("begins", begins).withColumn("run", F.sum("begins").over(order))
    return _gap_rows(gaps.groupBy("gap", "run").agg(F.min("first").alias("first"), F.sum("n").alias("n")))


def best_fit(counts: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """Matches (length, done: first rank, n, first: sequence, offset) of documents, given as counts (length, n).

    The histogram says how many sequences there must be at least; so many are open at first. A round sweeps over documents
    and gaps; where the longest document fits no gap, it opens as many sequences as such documents fill. Where documents
    far outnumber the gaps that can hold them, several of a length go into a gap at once, else there would be a round for
    each document of a sequence. There are some ten to twenty rounds, whatever the corpus.
    """
    spark = counts.sparkSession
    scratch = _shared.Scratch(spark)
    none = F.lit(None).cast("long")
    docs = counts.select(F.col("length").cast("long").alias("length"), F.col("n").cast("long").alias("left"))
    big = F.sum(F.when(F.col("length") * 2 > size, F.col("left")))
    least, halves = docs.agg(F.ceil(F.sum(F.col("length") * F.col("left")) / size), big).first()
    opened = max(least or 0, halves or 0)
    start = docs.select(
        F.lit(_DOC).alias("kind"),
        "length",
        F.lit(0).cast("long").alias("done"),
        "left",
        *[none.alias(c) for c in ("gap", "first", "n", "offset")],
    )

    def fresh(first: int, n: int) -> DataFrame:
        return _gap_rows(spark.createDataFrame([(size, first, n)], "gap long, first long, n long"))

    state = scratch.stage(start.union(fresh(0, opened)) if opened else start, "pack-round")
    found = []
    while True:
        # a row for each length and each size of gap
        seen = state.groupBy(
            "kind", F.coalesce("length", "gap").alias("at")
        ).agg(F.sum(F.coalesce("left", "n")).alias("n")).collect()
        waiting, there = ({r["at"]: r["n"] for r in seen if r["kind"] == k} for k in (_DOC, _GAP))
        if not waiting:
            break
        docs, gaps = state.where(F.col("kind") == _DOC), state.where(F.col("kind") == _GAP)
        top, widest = max(waiting), max(there, default=0)
        if top > widest:
            more = -(-sum(k * n for k, n in waiting.items() if k > widest) // size)
            gaps = gaps.union(fresh(opened, more))
            opened, widest, there[size] = opened + more, size, more
        fitting = sum(n for g, n in there.items() if g >= min(waiting))
        bundle = max(1, sum(waiting.values()) // fitting)
        small = size if bundle * top <= widest else size // SMALL
        swept = scratch.stage(_swept(docs, gaps, size, bundle, small, widest, scratch.stage), "pack-swept")
        matches = swept.where(F.col("kind") == _MATCH)
        found.append(matches)
        state = scratch.stage(_without(docs, matches).union(swept.where(F.col("kind") == _GAP)), "pack-round")
    out = spark.createDataFrame([], _STATE)
    for x in found:
        out = out.union(x)
    out = _shared.staged(out.select("length", "done", "n", "first", "offset"), "pack-matches")
    scratch.clear()
    return out


def pieces(
    docs: DataFrame,
    vocabulary: str,
    *,
    size: int = SEQUENCE,
    end_id: int = END_ID,
    text_col: str = "text",
    id_col: str = "doc_id",
    with_ids: bool = False,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and the ids themselves, if asked for) of every piece."""
    json = docs.sparkSession.sparkContext.broadcast(_bpe.read(vocabulary))
    rows = docs.select(F.col(id_col).alias(id_col), _shared.text_or_empty(text_col).alias("_text"))
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _bpe.coder(_bpe.ByteCoder, json.value)
        for batch in batches:
            owner, piece, start, length, crc, held = [], [], [], [], [], []
            for i, ids in enumerate(coder.encode(batch.column(1).to_pylist())):
                ids += end
                n = len(ids) // 4
                first = n if n <= size else (n % size or size)
                for k, b in enumerate([first, *range(first + size, n + 1, size)]):
                    a = 0 if not k else b - size
                    part = ids[4 * a : 4 * b]
                    owner.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(part))
                    held.append(part)
            columns = [
                batch.column(0).take(pa.array(owner, pa.int64())),
                pa.array(piece, pa.int32()),
                *(pa.array(x, pa.int64()) for x in (start, length, crc)),
            ]
            yield pa.RecordBatch.from_arrays(
                columns + [pa.array(held, pa.binary())] * with_ids,
                [id_col, "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids,
            )

    schema = rows.select(id_col).schema.add("piece", "integer").add("start", "long").add("length", "long").add(
        "ids_crc32", "long"
    )
    return rows.mapInArrow(cut, schema.add("ids", "binary") if with_ids else schema)


def pack(
    docs: DataFrame,
    vocabulary: str,
    *,
    size: int = SEQUENCE,
    end_id: int = END_ID,
    text_col: str = "text",
    id_col: str = "doc_id",
    with_ids: bool = False,
) -> DataFrame:
    """Every piece with its sequence_id and its offset there."""
    spark = docs.sparkSession
    _shared.tune(spark)
    found = pieces(docs, vocabulary, size=size, end_id=end_id, text_col=text_col, id_col=id_col, with_ids=with_ids)
    # a piece's number tells rows with equal or no ids apart, and stays what it is
    cut = _shared.staged(found.withColumn("_nr", F.monotonically_increasing_id()), "pieces")
    # ranks within a length: counted in as many lots as there are partitions, so that no lot holds a whole length
    place = F.xxhash64(id_col, "piece", "start", "ids_crc32", "_nr")
    lots = cut.withColumn("_lot", F.pmod(place, F.lit(_shared.n_partitions(spark))).cast("int"))
    counted = lots.groupBy("length", "_lot").agg(F.count(F.lit(1)).alias("n"))
    # a row for each length; counted with all partitions before the rounds, which are small, begin
    lengths = _shared.staged(counted.groupBy("length").agg(F.sum("n").alias("n")), "pack-lengths")
    with _shared.small_plans(spark):
        matches = best_fit(lengths, size).collect()
    # the size of a sequence bounds the number of matches, whatever the corpus; each has its rows by first rank
    table = np.array(
        sorted((r["length"], r["done"], r["first"], r["offset"]) for r in matches) or [(0, 0, 0, 0)], np.int64
    )
    plan = spark.sparkContext.broadcast((table[:, 0] * (1 << 50) + table[:, 1], table))
    before = counted.withColumn(
        "_before", F.sum("n").over(Window.partitionBy("length").orderBy("_lot")) - F.col("n")
    ).drop("n")
    order = Window.partitionBy("length", "_lot").orderBy(id_col, "piece", "ids_crc32", "_nr")
    ranked = lots.withColumn("_nth", F.row_number().over(order)).join(before, ["length", "_lot"]).withColumn(
        "_rank", F.col("_before") + F.col("_nth") - 1
    )
    own = [*[c for c in cut.columns if c != "_nr"], "_rank"]
    n, at = len(own) - 1, own.index("length")

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, rows = plan.value
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (at, n))
            row = rows[np.searchsorted(keys, length * (1 << 50) + rank, side="right") - 1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:n], pa.array(row[:, 2] + rank - row[:, 1]), pa.array(row[:, 3])],
                [*own[:n], "sequence_id", "offset"],
            )

    return ranked.select(*own).mapInArrow(put, cut.drop("_nr").schema.add("sequence_id", "long").add("offset", "long"))
