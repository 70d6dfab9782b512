"""Quality classifier: importance resampling of documents by two hashed n-gram models and Gumbel top-k.

A document's log weight is TEMPER times the log-likelihood ratio per n-gram of target to raw text; tempered by length,
long texts don't outweigh short ones, and the noise matters where the weights are near each other. With Gumbel noise from
a hash of the id added, the k largest keys are a sample of k documents without replacement, by weight. k is how many
documents rejection sampling would take on average: each with the probability of its weight against that of a document
whose ratio is `least_ratio`, at most 1.

A text without words (null, empty, white) has ratio 0 and isn't sampled: it is never kept. Ties at the k-th key are all
kept. Repeated rows share their key and their fate. Very long texts are read as a whole (see _words on memory). Input
columns named like a result, in any case of letters, are replaced; an empty table gives an empty result; without trusted
labels all texts with words stay. The same holds for passing(), a filter that keeps all columns as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _probe, _shared, _words, ngram_model

LEAST_RATIO = -0.11
#: Effective number of n-grams in the log weight.
TEMPER = 30.0
SEED = 20
#: Parts of a key, and of an acceptance, that are told apart: integers add up alike in any order.
_KEY_PARTS, _SHARE_PARTS = 1e9, 1e6
RESULTS = ["llr", "log_weight", "gumbel_key", "kept"]


def uniform(id_col: Column) -> Column:
    """A number between 0 and 1 for each id."""
    return (F.shiftrightunsigned(F.xxhash64(id_col, F.lit(SEED)), 12) + F.lit(0.5)) / F.lit(float(1 << 52))


def _keyed(docs: DataFrame, model, carry: list[str], text_col: str, id_col: str) -> DataFrame:
    """row, llr, log_weight, gumbel_key and, where the text has words, _key."""
    rows = docs.select(
        _shared.carried(
            carry, RESULTS
        ).alias("row") if carry else F.lit(0).alias("row"), F.col(id_col).alias("_id"), _shared.text_or_empty(text_col).alias("_text")
    )

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ratio, filled = [np.zeros(0)], [np.zeros(0, bool)]
            for _, _, data, offsets in _shared.blocks(batch.column(2)):
                block = _words.parse(data, offsets)
                ratio.append(ngram_model.ratios(block, model.value))
                filled.append(np.bincount(block.doc, minlength=block.n_docs) > 0)
            columns = [pa.array(np.concatenate(ratio)), pa.array(np.concatenate(filled))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], ["row", "_id", "llr", "_filled"])

    scored = rows.mapInArrow(score, rows.drop("_text").schema.add("llr", "double").add("_filled", "boolean"))
    weight = F.col("llr") * F.lit(TEMPER)
    scored = scored.withColumns({"log_weight": weight, "gumbel_key": weight - F.log(-F.log(uniform(F.col("_id"))))})
    # fixed-point keys, so that the k-th largest is found exactly
    fixed = (
        F.greatest(F.lit(0.0), F.least(F.lit(4e6), F.col("gumbel_key") + F.lit(2e6))) * F.lit(_KEY_PARTS)
    ).cast("long")
    return scored.withColumn("_key", F.when(F.col("_filled"), fixed))


def quality_classifier(
    docs: DataFrame, labels: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", least_ratio: float = LEAST_RATIO, carry: list[str] | None = None
) -> DataFrame:
    """docs (or its columns in `carry`) with llr, log_weight, gumbel_key and kept.

    Three passes over the texts: n-gram counts, keys (16 bytes a row are staged to find the k-th), verdicts. No text is
    shuffled; the k-th key comes from histogram probes of bounded size.
    """
    spark = docs.sparkSession
    _shared.tune(spark)
    model = spark.sparkContext.broadcast(ngram_model.fit(docs, labels, text_col, id_col))
    scratch = _shared.Scratch(spark)
    accepted = (
        F.exp(F.least(F.lit(0.0), F.col("log_weight") - F.lit(TEMPER * least_ratio))) * F.lit(_SHARE_PARTS)
    ).cast("long")
    keys = scratch.stage(
        _keyed(docs, model, [], text_col, id_col).where("_key IS NOT NULL").select("_key", accepted.alias("part")),
        "classifier-keys",
    )
    n, parts = keys.agg(F.count(F.lit(1)), F.coalesce(F.sum("part"), F.lit(0))).first()
    k = round(parts / _SHARE_PARTS)
    weighed = keys.select(F.col("_key").alias("key"), F.lit(1).cast("long").alias("weight"))
    least = _probe.boundaries(weighed, [n - k], 0, lower=True)[0][0]
    scratch.clear()
    judged = _keyed(docs, model, docs.columns if carry is None else carry, text_col, id_col)
    kept = F.coalesce(F.col("_key") >= least, F.lit(False))
    return judged.select("row.*", "llr", "log_weight", "gumbel_key", kept.alias("kept"))


def passing(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The sampled documents, with their own columns."""
    inner = docs.select(F.struct(*docs.columns).alias("row"), "text", "doc_id")
    return quality_classifier(inner, labels, carry=["row"], **options).where("kept").select("row.*")
