"""Schemas of the stored tables and the formulas of their identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Column types of each stored table, as DDL.
TABLES = {
    "nodes": "id string, repo string, properties string",
    "edges": "source string, target string, relationship string, weight double, source_repo string, target_repo string",
    "chunks": "chunk_id string, repo string, entity_id string, chunk_type string, content string, metadata string",
    "embeddings": "chunk_id string, repo string, entity_id string, chunk_type string, content string, embedding array<float>, metadata string",
    "repositories": "id string, name string, indexed_at timestamp, version string, branch string, commit_hash string, metadata string, embedding_model string",
    "cross_references": "id long, from_repo string, from_entity string, to_repo string, to_entity string, type string, strength double, context string",
    "schema_version": "version int, name string, applied_at timestamp",
    "files": "repo string, path string, n_chunks int, error string",
}
# Tables that are derived from others.
DERIVED = {"postings": "chunk_id string, repo string, term string, tf long, length long"}
# Columns that make a row unique, and whether the first or the last of equal rows stays.
KEYS = {
    "nodes": (["id"], "first"),
    "edges": (["source", "target", "relationship"], "last"),
    "chunks": (["chunk_id"], "last"),
    "embeddings": (["chunk_id"], "last"),
    "repositories": (["id"], "last"),
    "cross_references": (["from_repo", "from_entity", "to_repo", "to_entity", "type"], "last"),
    "schema_version": (["version"], "last"),
    "files": (["repo", "path"], "last"),
    "postings": (["chunk_id"], "last"),
}
EMBEDDING_KINDS = ("entity", "edge", "documentation", "code", "comment")
#: Structured extraction contract of a language model.
EXTRACTION = "entities array<string>, relationships array<struct<source:string, target:string, type:string, strength:double>>"


# The formulas of identifiers, which stored rows and their users rely on.
def code_chunk_id(repo: Column, path: Column, start: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", repo, path, start.cast("string")), 256), 1, 16)


def markdown_chunk_id(content: Column, index: Column) -> Column:
    return F.concat(F.lit("md-"), F.substring(F.sha2(F.concat(content, index.cast("string")), 256), 1, 16))


def entity_embedding_id(repo: Column, entity: Column) -> Column:
    return F.concat_ws("::", repo, F.lit("entity"), entity)


def edge_embedding_id(source_repo: Column, source: Column, relationship: Column, target: Column) -> Column:
    return F.concat_ws("::", source_repo, F.lit("edge"), source, relationship, target)


def resource_uri(repo: str, scheme: str = "lodestone") -> str:
    return f"{scheme}://repo/{repo}"
