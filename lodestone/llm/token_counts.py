"""Token counts: an exact histogram of encoded lengths, whose suffix sums answer every context limit.

Null and empty texts have length 0. Repeated rows count each. Ties don't matter; an empty table gives no rows. Only the
text column is read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _bpe, _shared

#: Lengths summed by one task; a second level sums the groups.
GROUP = 1024


def lengths(docs: DataFrame, vocabulary: str, text_col: str = "text") -> DataFrame:
    """length and n_docs: each task counts what it encodes, and sends a row for each length it met."""
    json = docs.sparkSession.sparkContext.broadcast(_bpe.read(vocabulary))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _bpe.coder(_bpe.ByteCoder, json.value)
        seen: dict[int, int] = {}
        for batch in batches:
            for ids in coder.encode(batch.column(0).to_pylist()):
                seen[len(ids) // 4] = seen.get(len(ids) // 4, 0) + 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.array(list(x), np.int64)) for x in (seen.keys(), seen.values())], ["length", "n"]
        )

    return docs.select(
        _shared.text_or_empty(text_col)
    ).mapInArrow(count, "length long, n long").groupBy("length").agg(F.sum("n").alias("n_docs"))


def histogram(docs: DataFrame, vocabulary: str, *, text_col: str = "text") -> DataFrame:
    """For each encoded length: n_docs, n_tokens, docs_at_least, tokens_at_least, truncated_tokens and quantile.

    docs_at_least and tokens_at_least are suffix sums over this length and longer ones; truncated_tokens is the corpus
    when each document is cut to this length; quantile is the share of documents no longer than this.
    """
    _shared.tune(docs.sparkSession)
    found = _shared.staged(lengths(docs, vocabulary, text_col), "lengths").withColumns(
        {"n_tokens": F.col("length") * F.col("n_docs"), "_group": F.floor(F.col("length") / GROUP)}
    )
    inside = Window.partitionBy("_group").orderBy(F.desc("length"))
    # one row for each GROUP lengths, so few even with very long texts
    groups = found.groupBy("_group").agg(F.sum("n_docs").alias("_d"), F.sum("n_tokens").alias("_t"))
    above = Window.orderBy(F.desc("_group"))
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    groups = groups.select(
        "_group",
        (F.sum("_d").over(above) - F.col("_d")).alias("_above_d"),
        (F.sum("_t").over(above) - F.col("_t")).alias("_above_t"),
        F.sum("_d").over(everything).alias("_all_d"),
        F.sum("_t").over(everything).alias("_all_t"),
    )
    out = found.withColumns(
        {"_in_d": F.sum("n_docs").over(inside), "_in_t": F.sum("n_tokens").over(inside)}
    ).join(groups, "_group")
    out = out.withColumns(
        {"docs_at_least": F.col("_in_d") + F.col("_above_d"), "tokens_at_least": F.col("_in_t") + F.col("_above_t")}
    )
    out = out.withColumns(
        {
            "truncated_tokens": F.col("_all_t") - F.col("tokens_at_least") + F.col("length") * F.col("docs_at_least"),
            "quantile": (F.col("_all_d") - F.col("docs_at_least") + F.col("n_docs")) / F.col("_all_d"),
        }
    )
    return out.select(
        "length", "n_docs", "n_tokens", "docs_at_least", "tokens_at_least", "truncated_tokens", "quantile"
    )


def truncated_totals(hist: DataFrame, limits: DataFrame) -> DataFrame:
    """For each context limit (a column `limit_tokens`): documents longer than it, and all tokens when cut to it.

    The longer documents are those at least as long as the next length of the histogram (a result of histogram()), whose
    suffix sums answer the limit. A range of limits or lengths each is sorted by one task, and carries over what the
    ranges above it begin with.
    """
    empty = [F.lit(None).cast("long").alias(c) for c in ("docs_at_least", "tokens_at_least")]
    asked = limits.select(
        F.col("limit_tokens").alias("_at"), F.lit(1).alias("_ask"), *empty
    ).where("_at IS NOT NULL").distinct()
    known = hist.select(F.col("length").alias("_at"), F.lit(0).alias("_ask"), "docs_at_least", "tokens_at_least")
    rows = asked.unionByName(known).withColumn("_group", F.floor(F.col("_at") / GROUP))
    # a length that equals a limit isn't longer than it, so it comes after the limit from above
    near = Window.partitionBy("_group").orderBy(F.desc("_at"), F.desc("_ask"))
    found = F.when(F.col("_ask") == 0, F.struct("docs_at_least", "tokens_at_least"))
    # one row for each GROUP lengths, so few even with very long texts
    groups = rows.groupBy("_group").agg(F.min_by(found, F.when(F.col("_ask") == 0, F.col("_at"))).alias("_least"))
    above = Window.orderBy(F.desc("_group")).rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select("_group", F.last("_least", ignorenulls=True).over(above).alias("_above"))
    everything = hist.agg(F.coalesce(F.max("tokens_at_least"), F.lit(0)).alias("_all"))
    out = rows.withColumn(
        "_in", F.last(found, ignorenulls=True).over(near)
    ).where("_ask = 1").join(groups, "_group").crossJoin(F.broadcast(everything))
    next_ = F.coalesce("_in", "_above")
    longer = F.coalesce(next_["docs_at_least"], F.lit(0))
    return out.select(
        F.col("_at").alias("limit_tokens"),
        longer.alias("docs_longer"),
        (
            F.col("_all") - F.coalesce(next_["tokens_at_least"], F.lit(0)) + F.col("_at") * longer
        ).alias("truncated_tokens"),
    )
