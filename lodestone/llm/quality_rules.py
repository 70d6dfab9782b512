"""Quality rules: fixed counts for every document and a hashed n-gram likelihood-ratio verdict.

Nulls and empty texts have no words and fail the base rules. Repeated rows each get a result, and ties at the threshold
are kept. Very long texts are read as a whole (see _words on memory). Input columns named like a result, in any case of
letters, are replaced. An empty table gives an empty result; without trusted labels every ratio is 0 and only the base
rules reject. The same holds for passing(), a filter that keeps all columns as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _shared, _words, ngram_model

#: Nats per n-gram. Text like the trusted text is near 0; text unlike it lies well below.
LEAST_RATIO = -0.11
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
FIELDS = ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, llr double"


def quality_rules(
    docs: DataFrame, labels: DataFrame, *, text_col: str = "text", id_col: str = "doc_id", least_ratio: float = LEAST_RATIO, carry: list[str] | None = None
) -> DataFrame:
    """docs (or its columns in `carry`) with the rule counts, base_failed, llr and kept.

    One pass counts n-grams over all documents, a second one judges each document where it lies; no text is shuffled.
    """
    _shared.tune(docs.sparkSession)
    names = [f.split()[0] for f in FIELDS.split(", ")]
    model = docs.sparkSession.sparkContext.broadcast(ngram_model.fit(docs, labels, text_col, id_col))
    rows = docs.select(
        _shared.carried(docs.columns if carry is None else carry, names).alias("row"),
        _shared.text_or_empty(text_col).alias("text"),
    )

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for _, _, data, offsets in _shared.blocks(batch.column(1)):
                block = _words.parse(data, offsets)
                parts.append(_words.rule_counts(block) | {"llr": ngram_model.ratios(block, model.value)})
            out = {}
            for k in (*COUNTS, "llr"):
                out[k] = np.concatenate([p[k] for p in parts]) if parts else np.zeros(
                    0, np.float64 if k == "llr" else np.int64
                )
            failed = (out["n_words"] < 50) | (100 * out["n_repeat_words"] > 50 * out["n_words"])
            kept = ~failed & (out["llr"] >= least_ratio)
            columns = [*(pa.array(out[k]) for k in COUNTS), pa.array(failed), pa.array(kept), pa.array(out["llr"])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["row", *names])

    schema = rows.select("row").schema
    for part in FIELDS.split(", "):
        schema = schema.add(*part.split())
    return rows.mapInArrow(judge, schema).select("row.*", *names)


def passing(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that the rules keep, with their own columns."""
    inner = docs.select(F.struct(*docs.columns).alias("row"), "text", "doc_id")
    return quality_rules(inner, labels, carry=["row"], **options).where("kept").select("row.*")
