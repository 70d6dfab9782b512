"""Ingest as one batch of DataFrames: files or markdown to chunks, extracted graph and embeddings, into a store."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..operators import chunking, embeddings, graph
from ..sources import files as file_sources
from ..sources.store import Store
from .analysis import Model

#: Errors of one kind that a result lists.
MOST_ERRORS = 100
ELEMENTS_SYSTEM = "Extract entities and relationships. One line each: Parsed relationship: E1 -> R -> E2 [strength: X.X]"
SUMMARY_SYSTEM = "Summarise as two sections, Entities: and Relationships:, one item a line, relationships as E1 -> R -> E2."


def model_column(rows: DataFrame, model: Model, system: str, column: str, out: str) -> DataFrame:
    """rows with a model's answer to a text column, or an error; the model is pickled to the workers.

    A call that fails costs its row only; a row that has an error already isn't asked about.
    """
    kept = rows.drop(out)
    if "error" not in kept.columns:
        kept = kept.withColumn("error", F.lit(None).cast("string"))
    kept = kept.select(*[c for c in kept.columns if c != "error"], "error")
    at = kept.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said, errors = [], []
            for t, e in zip(batch.column(at).to_pylist(), batch.columns[-1].to_pylist(), strict=True):
                answer = None
                if e is None:
                    try:
                        answer = model(system, t or "")
                    except Exception as x:  # noqa: BLE001  the model is a plug-in
                        e = f"{type(x).__name__}: {x}"
                said.append(answer)
                errors.append(e)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(said, pa.string()), pa.array(errors, pa.string())],
                [*batch.schema.names[:-1], out, "error"],
            )

    fields = [*kept.schema.fields[:-1], T.StructField(out, T.StringType()), T.StructField("error", T.StringType())]
    return kept.mapInArrow(run, T.StructType(fields))


def extract_elements(chunks: DataFrame, model: Model) -> DataFrame:
    return model_column(chunks, model, ELEMENTS_SYSTEM, "content", "elements")


def summarize_elements(elements: DataFrame, model: Model) -> DataFrame:
    return model_column(elements, model, SUMMARY_SYSTEM, "elements", "summary")


def summaries(chunks: DataFrame, model: Model) -> DataFrame:
    """repo, call_id, seq, summary and error of what a model says about chunks; each chunk is a call of its own."""
    said = summarize_elements(extract_elements(chunks.select("chunk_id", "repo", "content"), model), model)
    return said.select("repo", F.xxhash64("chunk_id").alias("call_id"), F.lit(0).alias("seq"), "summary", "error")


def extracted_graph(chunks: DataFrame, model: Model) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges that a model finds in chunks. Both read the model's answers, so stage these if it is slow."""
    return graph.graph_from_summaries(summaries(chunks, model).where("summary IS NOT NULL").drop("error"))


@dataclass
class IndexResult:
    repo: str
    chunks: int = 0
    nodes: int = 0
    edges: int = 0
    embeddings: int = 0
    errors: list[str] = field(default_factory=list)


def _staged(store: Store, rows: DataFrame) -> tuple[DataFrame, str]:
    """Rows written once in the store's folder: a model isn't asked again by whatever reads them."""
    folder = f"{store.path}/_staged/{uuid.uuid4().hex}"
    rows.write.parquet(folder)
    return store.spark.read.schema(rows.schema).parquet(folder), folder


def _finish(store: Store, repo: str, model: Model | None, provider: embeddings.Provider | None) -> IndexResult:
    """The graph and the embeddings of a repository whose chunks are in the store."""
    result = IndexResult(repo)
    for r in store.failed_files(repo).orderBy("path").limit(MOST_ERRORS).collect():
        result.errors.append(f"{r['path']}: {r['error']}")
    if model:
        mine = store.chunks().where(F.col("repo") == repo)
        try:
            said, folder = _staged(store, summaries(mine, model))
            nodes, edges = graph.graph_from_summaries(said.where("summary IS NOT NULL").drop("error"))
            store.put_all({"nodes": nodes, "edges": edges})
            for r in said.where("error IS NOT NULL").select("error").distinct().limit(MOST_ERRORS).collect():
                result.errors.append(f"extraction: {r['error']}")
            store.delete(folder)
        except Exception as e:  # noqa: BLE001  what fails here leaves the chunks in place
            result.errors.append(f"extraction: {e}")
    if provider:
        own, failed = embeddings.embedded(embeddings.entity_rows(store.nodes(), repo), provider, store)
        links, more = embeddings.embedded(embeddings.edge_rows(store.edges(), store.nodes(), repo), provider, store)
        # an entity's embedding is made once; an edge's follows the edge
        store.put_new("embeddings", own)
        store.put("embeddings", links)
        if failed + more:
            result.errors.append(f"embeddings: {failed + more} rows without a vector")
    for k, v in store.status(repo).items():
        if k in ("chunks", "nodes", "edges", "embeddings"):
            setattr(result, k, v)
    return result


def index_repository(
    store: Store,
    repo: str,
    path: str,
    *,
    model: Model | None = None,
    provider: embeddings.Provider | None = None,
    **about: str | None,
) -> IndexResult:
    """Scan a tree of files and index it; what isn't in the tree any more goes. A file that can't be read is an error of its own."""
    store.register(repo, **about)
    store.put_files(file_sources.scan_files(store.spark, path).withColumn("repo", F.lit(repo)), repo=repo)
    return _finish(store, repo, model, provider)


def index_markdown(
    store: Store,
    repo: str,
    markdown: str,
    *,
    source: str | None = None,
    url: str | None = None,
    metadata: Column | None = None,
    model: Model | None = None,
    provider: embeddings.Provider | None = None,
) -> IndexResult:
    """Index one markdown text."""
    store.register(repo)
    docs = file_sources.markdown_strings(store.spark, [(repo, markdown, source, url)])
    rows = chunking.markdown_rows(docs, user_metadata=metadata)
    store.put("chunks", rows.select("chunk_id", "repo", "entity_id", "chunk_type", "content", "metadata"))
    return _finish(store, repo, model, provider)


def update_repository(store: Store, repo: str, path: str, **options) -> IndexResult:
    """Index a tree again: new and changed chunks are written, those of shrunk or removed files go."""
    return index_repository(store, repo, path, **options)


def counts_in_output(said: DataFrame, column: str = "elements") -> DataFrame:
    """How many entities and relationships a model's outputs name."""
    entities, relations = text.extraction_counts(column)
    return said.agg(
        F.coalesce(F.sum(entities), F.lit(0)).alias("entities"),
        F.coalesce(F.sum(relations), F.lit(0)).alias("relationships"),
    )
