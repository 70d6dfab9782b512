"""Hashed n-gram multinomials for trusted-target and raw-corpus text, fitted in one pass and held in a fixed table."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _shared, _words

#: The model has 2**BITS cells for word unigrams and bigrams, whatever the corpus.
BITS = 16
#: At most so many labelled rows fit the target model; those of the lowest hash of their id.
MAX_LABELLED = 20_000
#: N-grams of expected target text added to each cell on both sides, so that a rare n-gram says little.
PRIOR = 10.0
_SLICES = 64


def trusted_sample(labels: DataFrame, bound: int = MAX_LABELLED) -> DataFrame:
    """At most `bound` ids of documents labelled as good, which may therefore be broadcast."""
    good = labels.where("quality = 1 AND doc_id IS NOT NULL").select("doc_id").distinct()
    return good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound).withColumn("_trusted", F.lit(True))


def features(block: _words.Block) -> tuple[np.ndarray, np.ndarray]:
    """Document and cell of every word and every pair of neighbouring words."""
    at, pairs = block.grams(2)
    doc = np.concatenate((block.doc, block.doc[at]))
    return doc, (np.concatenate((block.hash, pairs)) >> np.uint64(64 - BITS)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros((2, 1 << BITS), np.int64)
    for batch in batches:
        trusted = batch.column(1).fill_null(False).to_numpy(zero_copy_only=False)
        for first, end, data, offsets in _shared.blocks(batch.column(0)):
            doc, cell = features(_words.parse(data, offsets))
            counts[0] += np.bincount(cell, minlength=1 << BITS)
            if trusted[first:end].any():
                counts[1] += np.bincount(cell[trusted[first:end][doc]], minlength=1 << BITS)
    parts = [(s, x) for s, x in enumerate(counts.reshape(2 * _SLICES, -1)) if x.any()]
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([s for s, _ in parts], pa.int32()),
            pa.array([zlib.compress(x.tobytes(), 1) for _, x in parts], pa.binary()),
        ],
        ["slice", "counts"],
    )


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for s, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x = np.frombuffer(zlib.decompress(x), np.int64)
            total[s] = total[s] + x if s in total else x
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())],
        ["slice", "counts"],
    )


def fit(
    docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", bound: int = MAX_LABELLED
) -> np.ndarray:
    """Log-likelihood ratio of target to raw for each cell.

    Raw counts cover every document; target counts cover those in the bounded sample of trusted ids. Without trusted
    text all ratios are 0. The result has 2**BITS numbers, so it may go to the driver and to each task.
    """
    sample = trusted_sample(labels, bound).withColumnRenamed("doc_id", "_id")
    texts = docs.select(F.col(id_col).alias("_id"), _shared.text_or_empty(text_col).alias("_text"))
    rows = texts.join(F.broadcast(sample), "_id", "left").select("_text", "_trusted")
    partial = rows.mapInArrow(_count, "slice int, counts binary")
    # each task adds what it is sent as it comes: 64 slices of fixed size, however many tasks have counted
    found = partial.repartition("slice").mapInArrow(_add, "slice int, counts binary").collect()
    counts = np.zeros((2 * _SLICES, (1 << BITS) // _SLICES), np.int64)
    for s, x in found:
        counts[s] = np.frombuffer(x, np.int64)
    raw, target = counts.reshape(2, -1)
    if not target.sum():
        return np.zeros(1 << BITS)
    expected = raw * (target.sum() / raw.sum())
    return np.log((target + PRIOR) / (expected + PRIOR))


def ratios(block: _words.Block, model: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio per n-gram of each document; 0 without words."""
    doc, cell = features(block)
    n = np.bincount(doc, minlength=block.n_docs)
    return np.bincount(doc, weights=model[cell], minlength=block.n_docs) / np.maximum(n, 1)
