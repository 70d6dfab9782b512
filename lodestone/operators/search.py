"""The retrieval operators. Each takes and returns DataFrames; results carry a rank from 1 with a total order.

Every search is also there for many queries at once: `queries` has query_id and what the search needs, and ranks are
per query.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import porter, text, vectors
from . import blocks, graph
from .blocks import K1, B

log = logging.getLogger("lodestone")


def in_repos(rows: DataFrame, repositories: list[str] | None, column: Column | str = "repo") -> DataFrame:
    """Only these repositories, if any are named."""
    return rows.where(
        (F.col(column) if isinstance(column, str) else column).isin(list(repositories))
    ) if repositories else rows


def top(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows and their rank. The limit comes first, so the rank sees n rows only."""
    return rows.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def top_each(rows: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows of each query and their rank; Spark prunes to n in each task before the shuffle."""
    return rows.withColumn(
        "rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    ).where(F.col("rank") <= n)


# dense


def dense(
    embeddings: DataFrame,
    query: list[float],
    *,
    repositories: list[str] | None = None,
    max_results: int = 20,
    min_similarity: float = 0.7,
) -> DataFrame:
    """Rows by cosine distance to one vector, which must be less than 1 - min_similarity."""
    q = F.array(*[F.lit(float(x)) for x in query])
    rows = in_repos(embeddings, repositories).withColumn("similarity", vectors.cosine("embedding", q))
    rows = rows.withColumn(
        "distance", F.round(1 - F.col("similarity"), 12)
    ).where(F.col("distance") < 1 - min_similarity)
    return top(
        rows.select("chunk_id", "repo", "entity_id", "chunk_type", "content", "distance", "similarity"),
        max_results,
        F.asc("distance"),
        F.asc("chunk_id"),
    )


def dense_batch(
    embeddings: DataFrame, queries: DataFrame, *, max_results: int = 20, min_similarity: float = 0.7
) -> DataFrame:
    """Rows by cosine distance for many vectors: (query_id, chunk_id, repo, content, distance, rank).

    queries: query_id, vector. Queries are a stated set, taken to all rows in blocks.
    """
    found = blocks.dense(embeddings, blocks.collected(queries, "vector"), max_results, min_similarity)
    return top_each(found, max_results, F.asc("distance"), F.asc("chunk_id"))


# sparse


def postings(chunks: DataFrame) -> DataFrame:
    """The inverted index: chunk_id, repo, term, tf and length (the chunk's terms). Terms aren't stemmed yet."""
    rows = chunks.select("chunk_id", "repo", text.tokens("content").alias("t"))
    rows = rows.select("chunk_id", "repo", F.size("t").cast("long").alias("length"), F.explode("t").alias("term"))
    return rows.groupBy("chunk_id", "repo", "term", "length").agg(F.count(F.lit(1)).alias("tf")).select(
        "chunk_id", "repo", "term", "tf", "length"
    )


def _stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        terms = batch.column(0)
        yield pa.RecordBatch.from_arrays(
            [terms, pa.array([porter.normal(t) for t in terms.to_pylist()], pa.string())], ["term", "stem"]
        )


def stemmed(index: DataFrame) -> DataFrame:
    """An inverted index of stems: the stemmer sees the vocabulary, not the text."""
    vocabulary = index.select("term").distinct().mapInArrow(_stems, "term string, stem string")
    keys = ["chunk_id", "repo", F.col("stem").alias("term"), "length"]
    return index.join(vocabulary, "term").groupBy(*keys).agg(F.sum("tf").alias("tf")).select(
        "chunk_id", "repo", "term", "tf", "length"
    )


def document_stats(chunks: DataFrame) -> DataFrame:
    """One row: number of chunks and their terms, over the whole table."""
    length = F.size(text.tokens("content")).cast("long")
    return chunks.agg(F.count(F.lit(1)).alias("n_chunks"), F.coalesce(F.sum(length), F.lit(0)).alias("n_terms"))


def _indexed(
    index: DataFrame,
    stats: DataFrame,
    asked: list[tuple[int, list[str]]],
    repositories: list[str] | None,
    mode: str,
    stem: bool,
) -> DataFrame:
    """As blocks.sparse(), from an inverted index: only the postings of the queries' terms are read."""
    terms = {q: {porter.normal(t) for t in own} if stem else set(own) for q, own in asked}
    rows = [(q, t, len(own)) for q, own in terms.items() for t in sorted(own)]
    # the queries are a stated set
    wanted = F.broadcast(index.sparkSession.createDataFrame(rows, "query_id long, term string, n_terms int"))
    literal = sorted({t for own in terms.values() for t in own})
    hits = index.where(F.col("term").isin(literal)) if len(literal) <= 1000 else index
    frequency = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df")).join(wanted.select("term").distinct(), "term")
    idf = F.greatest(F.log((F.col("n_chunks") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    mean = F.col("n_terms_all") / F.greatest(F.col("n_chunks"), F.lit(1))
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / mean))
    # one row of statistics, and one row for each term of the queries
    one = F.broadcast(stats.select("n_chunks", F.col("n_terms").alias("n_terms_all")))
    own = in_repos(hits, repositories).join(wanted, "term").join(F.broadcast(frequency), "term").crossJoin(one)
    scored = own.withColumn("part", -idf * weight).groupBy("query_id", "chunk_id", "repo")
    scored = scored.agg(F.sum("part").alias("bm25"), F.count(F.lit(1)).alias("n"), F.first("n_terms").alias("n_terms"))
    if mode == "and":
        scored = scored.where("n = n_terms")
    return scored.select("query_id", "chunk_id", "repo", F.round("bm25", 9).alias("bm25"))


def sparse_batch(
    chunks: DataFrame, queries: DataFrame, *, index: DataFrame | None = None, stats: DataFrame | None = None, repositories: list[str] | None = None, max_results: int = 20, mode: str = "and", stem: bool = True
) -> DataFrame:
    """BM25 for many queries: query_id, chunk_id, repo, content, bm25 (more negative is better), rank.

    Document frequencies and lengths are those of the whole table, also with a repository filter. mode 'and' asks for
    all terms of a query, 'or' for any. With an index (postings() or stemmed(), whichever `stem` says) only the postings
    of the queries' terms are read; without one, the texts are read twice and nothing is shuffled.

    With stems, a query that has "phrases", prefix*, NOT or OR is a search expression (blocks.Expression) of its own, for
    which the texts are read twice.
    """
    # queries are a stated set
    stated = blocks.collected(queries, F.coalesce("query", F.lit("")), F.array_distinct(text.tokens("query")))
    marked = {q: t for q, t, _ in stated if stem and blocks.Expression.meant(t)}
    asked = [(q, words) for q, _, words in stated if words and q not in marked]
    parts = [_expressed(chunks, q, t, max_results, repositories) for q, t in marked.items()]
    order = F.asc("bm25"), F.asc("chunk_id")
    out = []
    if index is None or not asked:
        parts.append(blocks.sparse(chunks, asked, max_results, repositories=repositories, mode=mode, stem=stem))
    else:
        found = _indexed(index, document_stats(chunks) if stats is None else stats, asked, repositories, mode, stem)
        best = top_each(found, max_results, *order).drop("rank")
        best = best.join(chunks.select("chunk_id", "content"), "chunk_id")
        best = best.select("query_id", "chunk_id", "repo", "content", "bm25")
        out.append(top_each(best, max_results, *order))
    if parts:
        best = top_each(reduce(DataFrame.union, parts), max_results, *order)
        out.append(blocks.with_content(best, chunks))
    return reduce(DataFrame.union, out)


def _expressed(chunks: DataFrame, query_id: int, query: str, n: int, repositories: list[str] | None) -> DataFrame:
    """A query with marks as an expression; one that can't be read finds nothing, and the log says why."""
    try:
        return blocks.expression(chunks, query_id, blocks.Expression(query), n, repositories=repositories)
    except ValueError as e:
        log.warning("%s: %s", query, e)
        return chunks.sparkSession.createDataFrame([], blocks.SPARSE)


def sparse(chunks: DataFrame, query: str, **options) -> DataFrame:
    """BM25 for one query."""
    one = chunks.sparkSession.createDataFrame([(0, query)], "query_id long, query string")
    found = sparse_batch(chunks, one, **options).drop("query_id", "content")
    return found.join(chunks.select("chunk_id", "entity_id", "content"), "chunk_id")


# pattern and fuzzy


def pattern(
    chunks: DataFrame, query: str, *, repositories: list[str] | None = None, max_results: int = 20
) -> DataFrame:
    """Substring match in any case."""
    rows = in_repos(chunks, repositories).where(text.like_anywhere("content", query))
    return top(
        rows.select("chunk_id", "repo", "content", F.lit(1.0).alias("score"), F.lit("exact").alias("match_type")),
        max_results,
        F.asc("chunk_id"),
    )


def regex(chunks: DataFrame, query: str, *, repositories: list[str] | None = None, max_results: int = 20) -> DataFrame:
    """Regular-expression match."""
    rows = in_repos(chunks, repositories).where(F.col("content").rlike(query))
    return top(
        rows.select("chunk_id", "repo", "content", F.lit(1.0).alias("score"), F.lit("regex").alias("match_type")),
        max_results,
        F.asc("chunk_id"),
    )


def query_trigrams(query: str) -> list[str]:
    """Distinct trigrams of one query, as functions.text.trigrams() has them."""
    padded = f"  {query} "
    return list(dict.fromkeys(padded[i : i + 3] for i in range(len(query) + 1))) if len(query) >= 3 else [query]


def trigram_matches(content: Column | str, query: str) -> Column:
    """How many distinct trigrams of the query the content has; case counts.

    A text of three characters or more has a trigram exactly when its padded form contains it, so no array of the
    text's trigrams is made.
    """
    c = F.col(content) if isinstance(content, str) else content
    if len(query) < 3:
        return (c == F.lit(query)).cast("int")
    padded = F.concat(F.lit("  "), c, F.lit(" "))
    held = F.size(F.filter(F.array(*map(F.lit, query_trigrams(query))), lambda g: padded.contains(g)))
    return F.when(F.length(c) < 3, F.lit(0)).otherwise(held)


def fuzzy(
    chunks: DataFrame,
    query: str,
    *,
    repositories: list[str] | None = None,
    max_results: int = 20,
    threshold: float = 0.7,
) -> DataFrame:
    """Chunks that share at least three tenths of the query's trigrams; of the best 3 * max_results, those whose closest
    window is similar enough."""
    n = len(query)
    least = math.ceil(len(query_trigrams(query)) * 0.3)
    rows = in_repos(chunks, repositories).withColumn(
        "matches", trigram_matches("content", query)
    ).where(F.col("matches") >= least)
    likely = rows.orderBy(F.desc("matches"), "chunk_id").limit(3 * max_results)
    scored = likely.withColumn(
        "score", 1 - text.window_edit_distance("content", query) / F.lit(float(max(n, 1)))
    ).where(F.col("score") >= threshold)
    return top(
        scored.select("chunk_id", "repo", "content", "score", F.lit("fuzzy").alias("match_type")),
        max_results,
        F.desc("score"),
        F.asc("chunk_id"),
    )


def fuzzy_batch(
    chunks: DataFrame, queries: DataFrame, *, repositories: list[str] | None = None, max_results: int = 20, threshold: float = 0.7
) -> DataFrame:
    """As fuzzy(), for many queries (query_id, query): query_id, chunk_id, repo, content, score, rank."""
    asked = [(q, t) for q, t in blocks.collected(queries, "query") if t]
    found = blocks.pattern(chunks, asked, max_results, repositories=repositories, threshold=threshold)
    return top_each(found, max_results, F.desc("score"), F.asc("chunk_id"))


def similar_names(
    candidates: DataFrame, column: str, query: str, *, threshold: float = 0.7, max_results: int = 10
) -> DataFrame:
    """Candidates by edit-distance similarity to the query."""
    scored = candidates.withColumn(
        "score", text.similarity(F.col(column), F.lit(query))
    ).where(F.col("score") >= threshold)
    return top(scored, max_results, F.desc("score"), F.asc(column))


# graph


def graph_search(
    nodes: DataFrame, edges: DataFrame, entities: list[str], *, repositories: list[str] | None = None
) -> DataFrame:
    """Nodes that match any of the entities, with each edge that touches them."""
    if not entities:
        return graph.incident(nodes, edges).where(F.lit(False)).withColumn("found_repo", F.lit(None).cast("string"))
    own = nodes.where(graph.matches_entities(entities)).withColumn(
        "found_repo", F.coalesce(graph.node_repo(), F.lit("unknown"))
    )
    return graph.incident(in_repos(own, repositories, "found_repo"), edges)


def entity(nodes: DataFrame, edges: DataFrame, name: str, *, repositories: list[str] | None = None) -> DataFrame:
    return graph_search(nodes, edges, [name], repositories=repositories)


def entity_relationships(
    nodes: DataFrame, edges: DataFrame, node_id: str, *, repositories: list[str] | None = None
) -> DataFrame:
    found = graph.neighbours(nodes, edges, node_id).withColumn(
        "found_repo", F.coalesce(graph.node_repo(), F.lit("unknown"))
    )
    return in_repos(found, repositories, "found_repo")


def graph_batch(nodes: DataFrame, edges: DataFrame, queries: DataFrame, *, max_results: int = 20) -> DataFrame:
    """The first rows of graph_search() for each of many queries: query_id, id, found_repo, properties, edge columns, rank.

    A query's words are its entity words. A node row comes with each of its edges, so the first rows are those of the
    first nodes.
    """
    asked = [(q, w) for q, w in blocks.collected(queries, text.query_entities("query")) if w]
    own = top_each(blocks.named(nodes, asked, max_results), max_results, F.asc("id")).drop("rank")
    # a step that takes all columns: what is below is the same for both readers, and Spark works it out once
    own = own.mapInArrow(lambda batches: batches, own.schema)
    # max_results ids for each of the stated queries at most
    ids = F.broadcast(own.select(F.col("id").alias("end")).distinct())
    order = [F.asc("id"), F.asc_nulls_last("relationship"), F.asc_nulls_last("source"), F.asc_nulls_last("target")]
    # of a node's edges no query takes more than the first, however many a hub has
    return top_each(graph.first_incident(own, edges, max_results, ids), max_results, *order)


# cross references


def cross_references(refs: DataFrame, repositories: list[str], min_strength: float = 0.7) -> DataFrame:
    """References that touch the repositories, strongest first; none for no repository."""
    if not repositories:
        return refs.where(F.lit(False))
    own = list(repositories)
    rows = refs.where((F.col("from_repo").isin(own) | F.col("to_repo").isin(own)) & (F.col("strength") >= min_strength))
    return rows.orderBy(F.desc("strength"), "id")


def cross_references_of(refs: DataFrame, results: DataFrame, min_strength: float = 0.7) -> DataFrame:
    """References between the repositories of results (column repo); none if these are fewer than two."""
    repos = results.select("repo").where("repo IS NOT NULL").distinct()
    enough = repos.crossJoin(repos.agg(F.count(F.lit(1)).alias("n"))).where("n >= 2").select("repo")
    strong = refs.where(F.col("strength") >= min_strength)
    either = strong.join(enough.withColumnRenamed("repo", "from_repo"), "from_repo", "left_semi").select(*refs.columns)
    other = strong.join(enough.withColumnRenamed("repo", "to_repo"), "to_repo", "left_semi").select(*refs.columns)
    return either.union(other).distinct()


def references_to(refs: DataFrame, entity_name: str, repo: str) -> DataFrame:
    return refs.where(
        F.col("from_entity").contains(entity_name) | F.col("to_entity").contains(entity_name) | (
            F.col("from_repo") == repo
        ) | (F.col("to_repo") == repo)
    )
