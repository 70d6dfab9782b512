"""A query for each operator over the test tables, and the same in DuckDB's SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import porter, text, vectors
from .operators import chunking, embeddings, graph, search
from .plans import analysis, fusion, hybrid, ingest
from .sources import adapters as A
from .sources import files as files_source
from .sources import store

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}

# Common tables of the SQL side, by name.
_SQL = {
    "chunks": """chunks AS (SELECT substr(sha256(source || ':' || CAST(doc_id AS VARCHAR) || ':' || CAST(s AS VARCHAR)), 1, 16) AS chunk_id, source AS repo, substr(text, s + 1, 600) AS content, s, text, doc_id
      FROM (SELECT source, doc_id, text, CAST(unnest(range(0, length(text), 500)) AS INTEGER) AS s FROM documents))""",
    "nodes": """nodes AS (
      SELECT 'region:' || r_regionkey AS id, 'region' AS repo, r_name AS name, 'region' AS kind, NULL AS description FROM region
      UNION ALL SELECT 'nation:' || n_nationkey, 'nation', n_name, 'nation', NULL FROM nation
      UNION ALL SELECT 'customer:' || c_custkey, 'customer', c_name, 'customer', c_mktsegment FROM customer
      UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier', s_name, 'supplier', NULL FROM supplier
      UNION ALL SELECT 'part:' || p_partkey, 'part', p_name, 'part', p_type FROM part)""",
    "edges": """edges AS (
      SELECT 'customer:' || c_custkey AS source, 'nation:' || c_nationkey AS target, 'located_in' AS relationship, 1.0::DOUBLE AS weight, 'customer' AS source_repo, 'nation' AS target_repo FROM customer
      UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'located_in', 1.0, 'supplier', 'nation' FROM supplier
      UNION ALL SELECT 'nation:' || n_nationkey, 'region:' || n_regionkey, 'part_of', 1.0, 'nation', 'region' FROM nation
      UNION ALL SELECT 'supplier:' || l_suppkey, 'part:' || l_partkey, 'supplies', round(q / max(q) OVER (), 6), 'supplier', 'part' FROM (SELECT l_suppkey, l_partkey, sum(l_quantity) AS q FROM lineitem GROUP BY ALL))""",
    "refs": """refs AS (
      SELECT CAST(s_nationkey * 100 + c_nationkey AS BIGINT) AS id, 'region_' || a.n_regionkey AS from_repo, 'nation:' || s_nationkey AS from_entity, 'region_' || b.n_regionkey AS to_repo, 'nation:' || c_nationkey AS to_entity, 'sells_to' AS type, round(q / sum(q) OVER (PARTITION BY s_nationkey), 6) AS strength
      FROM (SELECT s_nationkey, c_nationkey, sum(l_quantity) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)
      JOIN nation a ON a.n_nationkey = s_nationkey JOIN nation b ON b.n_nationkey = c_nationkey)""",
    "emb": """emb AS (SELECT CAST(vec_id AS VARCHAR) AS chunk_id, 'label_' || CAST(label AS VARCHAR) AS repo, CAST(embedding AS DOUBLE[]) AS e, vec_id FROM embeddings)""",
    "node_text": """node_text AS (SELECT *, concat('{"name":"', name, '","type":"', kind, '"', CASE WHEN description IS NULL THEN '' ELSE concat(',"description":"', description, '"') END, '}') AS properties FROM nodes)""",
    "ends": """ends AS (SELECT source AS node, * FROM edges UNION ALL SELECT target AS node, * FROM edges WHERE target <> source)""",
    "lists": """lists AS (
      SELECT * FROM (SELECT 'dense' AS source, CAST(row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank, 'o' || o_custkey AS id, o_orderpriority AS repo FROM orders) WHERE rank <= 60
      UNION ALL SELECT * FROM (SELECT 'sparse', CAST(row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS INTEGER) AS rank, 'o' || c_custkey, c_mktsegment FROM customer) WHERE rank <= 60
      UNION ALL SELECT * FROM (SELECT 'graph', CAST(row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS INTEGER) AS rank, 'o' || o_custkey, o_orderpriority FROM orders) WHERE rank <= 60)""",
    "fused": """scored AS (
      SELECT id, round(sum(CASE source WHEN 'dense' THEN 0.3 WHEN 'sparse' THEN 0.3 WHEN 'graph' THEN 0.2 END / (60 + rank)), 12) AS score,
        max(CASE WHEN source = 'dense' THEN rank END) AS dense, max(CASE WHEN source = 'sparse' THEN rank END) AS sparse, max(CASE WHEN source = 'pattern' THEN rank END) AS pattern, max(CASE WHEN source = 'graph' THEN rank END) AS graph,
        min(CASE source WHEN 'dense' THEN 0 WHEN 'sparse' THEN 1 ELSE 3 END * 1000000 + rank) AS place,
        arg_min(repo, CASE source WHEN 'dense' THEN 0 WHEN 'sparse' THEN 1 ELSE 3 END * 1000000 + rank) AS repo
      FROM lists GROUP BY id),
    fused AS (SELECT CAST(row_number() OVER (ORDER BY score DESC, place, id) AS INTEGER) AS rank, id, repo, score, dense, sparse, pattern, graph FROM scored QUALIFY rank <= 40)""",
}


def _with(names: str, select: str) -> str:
    return "WITH " + ", ".join(_SQL[n] for n in names.split()) + "\n" + select


def _add(name: str, sql: str | None = None):
    def put(f: Query) -> Query:
        _queries[name] = f
        if sql:
            _oracles[name] = sql
        return f

    return put


# chunking and functions


@_add("chunk_fixed_windows", _with("chunks", """
SELECT chunk_id, repo, sha256(content) AS content_sha256, s AS start_char, CAST(s + length(content) AS INTEGER) AS end_char,
  CAST(CASE WHEN s = 0 THEN 1 WHEN before + 2 <= lines THEN before + 2 ELSE 1 END AS INTEGER) AS start_line, CAST(CASE WHEN after + 2 <= lines THEN after + 2 ELSE lines END AS INTEGER) AS end_line
FROM (SELECT *, length(text) - length(replace(text, chr(10), '')) + 1 AS lines, length(substr(text, 1, s - 1)) - length(replace(substr(text, 1, s - 1), chr(10), '')) AS before, length(substr(text, 1, s + 599)) - length(replace(substr(text, 1, s + 599), chr(10), '')) AS after FROM chunks)"""))
def chunk_fixed_windows(spark, d):
    meta = F.from_json("metadata", "file string, start_line int, end_line int, start_char int, end_char int")
    rows = A.chunks(spark, d).withColumn("m", meta)
    return rows.select(
        "chunk_id",
        "repo",
        F.sha2("content", 256).alias("content_sha256"),
        "m.start_char",
        "m.end_char",
        "m.start_line",
        "m.end_line",
    )


@_add("chunk_counts_by_repo", _with("chunks", "SELECT repo, count(*) AS n_chunks, CAST(sum(length(content)) AS BIGINT) AS n_chars FROM chunks GROUP BY repo"))
def chunk_counts_by_repo(spark, d):
    return A.chunks(spark, d).groupBy("repo").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.sum(F.length("content")).cast("long").alias("n_chars")
    )


_TRIGRAMS = "SELECT p_partkey, g AS trigram, CAST(min(i) AS INTEGER) AS first_at FROM (SELECT p_partkey, unnest(range(1, length(p_name) + 2)) AS i, substr('  ' || p_name || ' ', i, 3) AS g FROM part) GROUP BY p_partkey, g"


@_add("trigram_index", f"SELECT p_partkey, trigram, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY first_at) - 1 AS INTEGER) AS position FROM ({_TRIGRAMS})")
def trigram_index(spark, d):
    return A.read(spark, d, "part").select(
        "p_partkey", F.posexplode(text.trigrams("p_name")).alias("position", "trigram")
    )


def _part_chunks(spark, d):
    p = A.read(spark, d, "part")
    return p.select(
        F.concat(F.lit("part:"), F.col("p_partkey").cast("string")).alias("chunk_id"),
        F.col("p_brand").alias("repo"),
        F.lit(None).cast("string").alias("entity_id"),
        F.col("p_name").alias("content"),
    )


_PART_NAME = "small rimg"


@_add("trigram_match_count", f"""
WITH grams AS ({_TRIGRAMS}), wanted AS (SELECT DISTINCT substr('  {_PART_NAME} ', i, 3) AS trigram FROM (SELECT unnest(range(1, {len(_PART_NAME)} + 2)) AS i))
SELECT 'part:' || p_partkey AS chunk_id, CAST(count(*) AS INTEGER) AS matches FROM grams JOIN wanted USING (trigram) GROUP BY p_partkey HAVING count(*) >= ceil((SELECT count(*) FROM wanted) * 0.3)""")
def trigram_match_count(spark, d):
    n = F.size(text.trigrams(F.lit(_PART_NAME)))
    return _part_chunks(spark, d).select(
        "chunk_id", search.trigram_matches("content", _PART_NAME).alias("matches")
    ).where(F.col("matches") >= F.ceil(n * F.lit(0.3)))


@_add("fuzzy_search", f"""
WITH grams AS ({_TRIGRAMS}), wanted AS (SELECT DISTINCT substr('  {_PART_NAME} ', i, 3) AS trigram FROM (SELECT unnest(range(1, {len(_PART_NAME)} + 2)) AS i)),
likely AS (SELECT p_partkey, count(*) AS matches FROM grams JOIN wanted USING (trigram) GROUP BY p_partkey HAVING count(*) >= ceil((SELECT count(*) FROM wanted) * 0.3) ORDER BY matches DESC, 'part:' || p_partkey LIMIT 60),
best AS (SELECT p_partkey, 1 - list_min(list_transform(range(1, length(p_name) - {len(_PART_NAME)} + 2), lambda i: levenshtein(substr(lower(p_name), i, {len(_PART_NAME)}), lower('{_PART_NAME}')))) / {len(_PART_NAME)}.0::DOUBLE AS score FROM likely JOIN part USING (p_partkey) WHERE length(p_name) >= {len(_PART_NAME)})
SELECT 'part:' || p_partkey AS chunk_id, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, 'part:' || p_partkey) AS INTEGER) AS rank FROM best WHERE score >= 0.4 QUALIFY rank <= 20""")
def fuzzy_search(spark, d):
    return search.fuzzy(_part_chunks(spark, d), _PART_NAME, threshold=0.4).select(
        "chunk_id", F.round("score", 6).alias("score"), "rank"
    )


@_add("levenshtein_similarity_topk", """
SELECT p_partkey, p_name, round(s, 6) AS score, CAST(row_number() OVER (ORDER BY s DESC, p_name, p_partkey) AS INTEGER) AS rank
FROM (SELECT *, 1 - levenshtein(lower(p_name), 'almond antique')::DOUBLE / greatest(length(p_name), 14) AS s FROM part) WHERE s >= 0.3 QUALIFY rank <= 10""")
def levenshtein_similarity_topk(spark, d):
    rows = A.read(spark, d, "part").withColumn(
        "s", text.similarity("p_name", F.lit("almond antique"))
    ).where("s >= 0.3")
    return search.top(rows, 10, F.desc("s"), F.asc("p_name"), F.asc("p_partkey")).select(
        "p_partkey", "p_name", F.round("s", 6).alias("score"), "rank"
    )


def _sql_grams(t: str) -> str:
    return f"list_distinct(list_transform(range(1, length({t}) + 2), lambda i: substr('  ' || lower({t}) || ' ', i, 3)))"


@_add("jaccard_fuzzy_match", f"""
SELECT p_partkey, contains(lower(p_name), 'blue') OR len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE >= 0.3 AS is_match
FROM (SELECT p_partkey, p_name, {_sql_grams("p_name")} AS a, {_sql_grams("'blue'")} AS b FROM part)""")
def jaccard_fuzzy_match(spark, d):
    return A.read(spark, d, "part").select(
        "p_partkey", text.fuzzy_match("p_name", F.lit("blue"), 0.3).alias("is_match")
    )


@_add("substring_search", _with("chunks", "SELECT chunk_id, repo, 1.0::DOUBLE AS score, 'exact' AS match_type, CAST(row_number() OVER (ORDER BY chunk_id) AS INTEGER) AS rank FROM chunks WHERE lower(content) LIKE '%license%' QUALIFY rank <= 20"))
def substring_search(spark, d):
    return search.pattern(A.chunks(spark, d), "License").drop("content")


@_add("regex_search", _with("chunks", "SELECT chunk_id, repo, CAST(row_number() OVER (ORDER BY chunk_id) AS INTEGER) AS rank FROM chunks WHERE regexp_matches(content, '[A-Z]{4,}[!]+') QUALIFY rank <= 20"))
def regex_search(spark, d):
    return search.regex(A.chunks(spark, d), "[A-Z]{4,}[!]+").select("chunk_id", "repo", "rank")


_SQL_IDS = ", ".join(f"regexp_extract_all(t, '{p}')" for p in text.IDENTIFIER_PATTERNS)


@_add("identifiers_extract", f"SELECT doc_id, array_to_string(list_sort(list_distinct(flatten([{_SQL_IDS}]))), ' ') AS identifiers FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)")
def identifiers_extract(spark, d):
    return A.read(spark, d, "documents").select(
        "doc_id", F.array_join(F.array_sort(text.identifiers(F.coalesce("text", F.lit("")))), " ").alias("identifiers")
    )


@_add("identifiers_normalize", "SELECT c_custkey, trim(regexp_replace(lower(c_name), '[-_./@\\\\]', '', 'g')) AS normalized, regexp_replace(lower(c_name), '[-_./@\\\\]', '', 'g') = regexp_replace(lower(c_mktsegment), '[-_./@\\\\]', '', 'g') AS same FROM customer")
def identifiers_normalize(spark, d):
    return A.read(spark, d, "customer").select(
        "c_custkey",
        text.normalize_identifier("c_name").alias("normalized"),
        text.identifiers_similar("c_name", "c_mktsegment").alias("same"),
    )


_STOPS = ", ".join(f"'{w}'" for w in text.STOP_WORDS)


@_add("stopword_entity_extract", f"SELECT conv_id, turn, array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array(lower(text), '\\s+'), lambda w: regexp_replace(w, '[^A-Za-z0-9_]', '', 'g')), lambda w: length(w) > 2 AND w NOT IN ({_STOPS})))), ' ') AS entities FROM (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations)")
def stopword_entity_extract(spark, d):
    said = F.coalesce("text", F.lit(""))
    return A.read(spark, d, "conversations").select(
        "conv_id", "turn", F.array_join(F.array_sort(text.query_entities(said)), " ").alias("entities")
    )


@_add("cosine_pairs", "SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id = b.vec_id + 1")
def cosine_pairs(spark, d):
    e = A.read(spark, d, "embeddings")
    a, b = e.select(F.col("vec_id").alias("a"), F.col("embedding").alias("x")), e.select(
        F.col("vec_id").alias("b"), F.col("embedding").alias("y"), (F.col("vec_id") + 1).alias("a")
    )
    return a.join(b, "a").select("a", "b", F.round(vectors.cosine("x", "y"), 6).alias("similarity"))


# search


def _vector(spark, d, vec_id: int = 0) -> list[float]:
    return A.read(spark, d, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"]


_DENSE = """SELECT emb.chunk_id, emb.repo, round(1 - list_cosine_similarity(emb.e, q.e), 12) AS distance FROM emb, (SELECT e FROM emb WHERE vec_id = 0) q"""


@_add("dense_topk", _with("emb", f"SELECT chunk_id, repo, round(distance, 6) AS distance, CAST(row_number() OVER (ORDER BY distance, chunk_id) AS INTEGER) AS rank FROM ({_DENSE}) WHERE distance < 0.9 QUALIFY rank <= 20"))
def dense_topk(spark, d):
    return search.dense(A.embeddings(spark, d), _vector(spark, d), min_similarity=0.1).select(
        "chunk_id", "repo", F.round("distance", 6).alias("distance"), "rank"
    )


@_add("dense_repo_filtered", _with("emb", f"SELECT chunk_id, repo, round(distance, 6) AS distance, CAST(row_number() OVER (ORDER BY distance, chunk_id) AS INTEGER) AS rank FROM ({_DENSE}) WHERE distance < 1 AND repo IN ('label_1', 'label_2') QUALIFY rank <= 20"))
def dense_repo_filtered(spark, d):
    return search.dense(
        A.embeddings(spark, d), _vector(spark, d), repositories=["label_1", "label_2"], min_similarity=0.0
    ).select("chunk_id", "repo", F.round("distance", 6).alias("distance"), "rank")


@_add("dense_batch_topk", _with("emb", """
SELECT q.vec_id AS query_id, emb.chunk_id, emb.repo, round(round(1 - list_cosine_similarity(emb.e, q.e), 12), 6) AS distance, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY round(1 - list_cosine_similarity(emb.e, q.e), 12), emb.chunk_id) AS INTEGER) AS rank
FROM emb, emb q WHERE q.vec_id % 20 = 0 AND round(1 - list_cosine_similarity(emb.e, q.e), 12) < 1 QUALIFY rank <= 10"""))
def dense_batch_topk(spark, d):
    queries = A.read(spark, d, "embeddings").where("vec_id % 20 = 0").select(
        F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")
    )
    return search.dense_batch(A.embeddings(spark, d), queries, max_results=10, min_similarity=0.0).select(
        "query_id", "chunk_id", "repo", F.round("distance", 6).alias("distance"), "rank"
    )


_BM25_QUERIES = "(VALUES (1, 'the'), (1, 'erst'), (2, 'thing'), (2, 'and'), (3, 'license'))"
_BM25 = f"""
terms AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(list_filter(regexp_split_to_array(lower(content), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')) AS term FROM chunks) GROUP BY ALL),
lengths AS (SELECT chunk_id, sum(tf) AS length FROM terms GROUP BY chunk_id), stats AS (SELECT (SELECT count(*) FROM chunks) AS n, (SELECT sum(tf) FROM terms) / (SELECT count(*) FROM chunks)::DOUBLE AS avg_length),
wanted AS (SELECT CAST(q AS BIGINT) AS query_id, term, count(*) OVER (PARTITION BY q) AS n_terms FROM {_BM25_QUERIES} w(q, term)),
df AS (SELECT term, count(*) AS df FROM terms GROUP BY term),
scored AS (SELECT query_id, chunk_id, round(sum(-greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avg_length))), 9) AS bm25
  FROM terms JOIN wanted USING (term) JOIN df USING (term) JOIN lengths USING (chunk_id), stats GROUP BY query_id, chunk_id HAVING count(*) = any_value(n_terms))
SELECT query_id, chunk_id, repo, round(bm25, 6) AS bm25, CAST(row_number() OVER (PARTITION BY query_id ORDER BY bm25, chunk_id) AS INTEGER) AS rank FROM scored JOIN chunks USING (chunk_id) QUALIFY rank <= 20"""


@_add("bm25_search", _with("chunks", "").rstrip() + "," + _BM25)
def bm25_search(spark, d):
    queries = spark.createDataFrame([(1, "The erst"), (2, "thing AND"), (3, "license")], "query_id long, query string")
    return search.sparse_batch(A.chunks(spark, d), queries, stem=False).select(
        "query_id", "chunk_id", "repo", F.round("bm25", 6).alias("bm25"), "rank"
    )


_STEMMED = [(1, "licensing works"), (2, "things")]
_STEMS = {porter.stem(w): i for i, q in _STEMMED for w in q.split()}
# the forms of the queries' words; texts may have any of them
_FORMS = sorted(
    {
        (w, porter.stem(w)) for base in ("licens", "work", "thing") for end in (
            "", "e", "s", "es", "ed", "ing", "er", "ers", "able", "ings", "ely"
        ) for w in (base + end,) if porter.stem(w) in _STEMS
    }
)


@_add("bm25_search_stemmed", _with("chunks", "").rstrip() + "," + f"""
words AS (SELECT chunk_id, unnest(list_filter(regexp_split_to_array(lower(content), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')) AS word FROM chunks),
forms(word, term) AS (VALUES {", ".join(map(str, _FORMS))}),
terms AS (SELECT chunk_id, term, count(*) AS tf FROM words JOIN forms USING (word) GROUP BY ALL),
lengths AS (SELECT chunk_id, count(*) AS length FROM words GROUP BY chunk_id),
stats AS (SELECT (SELECT count(*) FROM chunks) AS n, (SELECT count(*) FROM words) / (SELECT count(*) FROM chunks)::DOUBLE AS avg_length),
wanted AS (SELECT CAST(q AS BIGINT) AS query_id, term, count(*) OVER (PARTITION BY q) AS n_terms FROM (VALUES {", ".join(f"({i}, '{t}')" for t, i in _STEMS.items())}) w(q, term)),
df AS (SELECT term, count(*) AS df FROM terms GROUP BY term),
scored AS (SELECT query_id, chunk_id, round(sum(-greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / avg_length))), 9) AS bm25
  FROM terms JOIN wanted USING (term) JOIN df USING (term) JOIN lengths USING (chunk_id), stats GROUP BY query_id, chunk_id HAVING count(*) = any_value(n_terms))
SELECT query_id, chunk_id, repo, round(bm25, 6) AS bm25, CAST(row_number() OVER (PARTITION BY query_id ORDER BY bm25, chunk_id) AS INTEGER) AS rank FROM scored JOIN chunks USING (chunk_id) QUALIFY rank <= 20""")
def bm25_search_stemmed(spark, d):
    queries = spark.createDataFrame(_STEMMED, "query_id long, query string")
    return search.sparse_batch(A.chunks(spark, d), queries).select(
        "query_id", "chunk_id", "repo", F.round("bm25", 6).alias("bm25"), "rank"
    )


@_add("bm25_search_indexed", _with("chunks", "").rstrip() + "," + _BM25)
def bm25_search_indexed(spark, d):
    """As bm25_search, from postings that are there already (here: derived in the plan)."""
    queries = spark.createDataFrame([(1, "The erst"), (2, "thing AND"), (3, "license")], "query_id long, query string")
    chunks = A.chunks(spark, d)
    found = search.sparse_batch(chunks, queries, index=search.postings(chunks), stem=False)
    return found.select("query_id", "chunk_id", "repo", F.round("bm25", 6).alias("bm25"), "rank")


# graph

_NODES = "SELECT id, repo, name, kind, description FROM nodes"


def _named(rows: DataFrame) -> DataFrame:
    p = lambda n: F.get_json_object("properties", f"$.{n}").alias("kind" if n == "type" else n)
    return rows.select("id", "repo", p("name"), p("type"), p("description"))


@_add("graph_nodes", _with("nodes", _NODES))
def graph_nodes(spark, d):
    return _named(A.nodes(spark, d))


@_add("graph_edges", _with("edges", "SELECT * FROM edges"))
def graph_edges(spark, d):
    return A.edges(spark, d)


@_add("node_insert_ignore", "SELECT id, arg_min(repo, seq) AS repo FROM (SELECT 'c' || o_custkey AS id, o_orderpriority AS repo, o_orderkey AS seq FROM orders) GROUP BY id")
def node_insert_ignore(spark, d):
    rows = A.read(spark, d, "orders").select(
        F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("id"),
        F.col("o_orderpriority").alias("repo"),
        F.col("o_orderkey").alias("seq"),
    )
    return store.keep_first(rows.select("id", "repo").where(F.lit(False)), rows, ["id"], "seq")


@_add("edge_upsert_keep_last", "SELECT source, target, arg_max(weight, seq) AS weight FROM (SELECT 's' || l_suppkey AS source, 'p' || l_partkey AS target, l_quantity AS weight, l_orderkey * 10 + l_linenumber AS seq FROM lineitem) GROUP BY source, target")
def edge_upsert_keep_last(spark, d):
    rows = A.read(spark, d, "lineitem").select(
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("source"),
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("target"),
        F.col("l_quantity").alias("weight"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
    )
    return store.keep_last(rows.drop("seq").where(F.lit(False)), rows, ["source", "target"], "seq")


@_add("degree_centrality_top10", _with("nodes edges", "SELECT id, count(e.id2) AS degree FROM nodes LEFT JOIN (SELECT source AS id2 FROM edges UNION ALL SELECT target FROM edges) e ON id = e.id2 GROUP BY id ORDER BY degree DESC, id LIMIT 10"))
def degree_centrality_top10(spark, d):
    return graph.degree_top(A.nodes(spark, d), A.edges(spark, d))


@_add("relationship_types", _with("edges", "SELECT DISTINCT relationship FROM edges"))
def relationship_types(spark, d):
    return graph.relationship_types(A.edges(spark, d))


@_add("null_weight_audit", _with("edges", "SELECT source, target, relationship FROM (SELECT source, target, relationship, CASE WHEN relationship = 'part_of' THEN NULL ELSE weight END AS w FROM edges) WHERE w IS NULL ORDER BY ALL LIMIT 5"))
def null_weight_audit(spark, d):
    broken = A.edges(spark, d).withColumn("weight", F.when(F.col("relationship") != "part_of", F.col("weight")))
    return graph.missing_weights(broken).select("source", "target", "relationship")


@_add("node_edge_or_join", _with("nodes edges ends", "SELECT id, repo, source, target, relationship, weight FROM nodes LEFT JOIN (SELECT node, source, target, relationship, weight FROM ends) ON id = node"))
def node_edge_or_join(spark, d):
    return graph.incident(A.nodes(spark, d), A.edges(spark, d)).drop("properties")


@_add("graph_search", _with("nodes edges ends node_text", "SELECT id, repo AS found_repo, source, target, relationship, weight FROM node_text LEFT JOIN (SELECT node, source, target, relationship, weight FROM ends) ON id = node WHERE lower(id) LIKE '%nation:1%' OR lower(properties) LIKE '%nation:1%' OR lower(id) LIKE '%asia%' OR lower(properties) LIKE '%asia%'"))
def graph_search(spark, d):
    return search.graph_search(A.nodes(spark, d), A.edges(spark, d), ["nation:1", "ASIA"]).drop("properties", "repo")


@_add("entity_search", _with("nodes edges ends node_text", "SELECT id, repo AS found_repo, source, target, relationship FROM node_text LEFT JOIN (SELECT node, source, target, relationship FROM ends) ON id = node WHERE (lower(id) LIKE '%supplier:1%' OR lower(properties) LIKE '%supplier:1%') AND repo IN ('supplier')"))
def entity_search(spark, d):
    return search.entity(
        A.nodes(spark, d), A.edges(spark, d), "supplier:1", repositories=["supplier"]
    ).drop("properties", "repo", "weight")


@_add("entity_neighbours", _with("nodes edges", "SELECT id, relationship, weight, source, target FROM nodes JOIN edges ON (id = source OR id = target) AND id <> 'nation:3' WHERE source = 'nation:3' OR target = 'nation:3'"))
def entity_neighbours(spark, d):
    return search.entity_relationships(A.nodes(spark, d), A.edges(spark, d), "nation:3").select(
        "id", "relationship", "weight", "source", "target"
    )


@_add("k_hop_neighbours", _with("edges", """
, b AS (SELECT source AS x, target AS y FROM edges UNION SELECT target, source FROM edges), h1 AS (SELECT DISTINCT y AS id FROM b WHERE x = 'region:1'), h2 AS (SELECT DISTINCT y AS id FROM b JOIN h1 ON x = h1.id)
SELECT id, CAST(min(hop) AS INTEGER) AS hop FROM (SELECT 'region:1' AS id, 0 AS hop UNION ALL SELECT id, 1 FROM h1 UNION ALL SELECT id, 2 FROM h2) GROUP BY id""").replace("\n\n, b", ", b").replace(")\n\n,", "),"))
def k_hop_neighbours(spark, d):
    return graph.k_hop(A.edges(spark, d), spark.createDataFrame([("region:1",)], "id string"), 2)


@_add("edge_context_join", _with("nodes edges", "SELECT e.source, e.target, e.relationship, s.name AS source_name, t.name AS target_name FROM edges e JOIN nodes s ON s.id = e.source AND s.repo = e.source_repo JOIN nodes t ON t.id = e.target AND t.repo = e.target_repo WHERE e.source_repo = 'supplier' OR e.target_repo = 'supplier'"))
def edge_context_join(spark, d):
    found = graph.edges_in_context(A.edges(spark, d), A.nodes(spark, d), "supplier")
    return found.select(
        "source",
        "target",
        "relationship",
        F.get_json_object("source_props", "$.name").alias("source_name"),
        F.get_json_object("target_props", "$.name").alias("target_name"),
    )


@_add("edge_embedding_text", _with("nodes edges", """
SELECT e.source_repo || '::edge::' || e.source || '::' || relationship || '::' || e.target AS chunk_id, e.source_repo AS repo,
  s.name || ' <' || relationship || '> ' || t.name || ' :: context: ' || s.name || ' (' || s.kind || ') ' || relationship || ' ' || t.name || ' (' || t.kind || ')' || CASE WHEN s.description IS NULL THEN '' ELSE ', source: ' || s.description END || CASE WHEN t.description IS NULL THEN '' ELSE ', target: ' || t.description END || CASE WHEN weight > 0.5 THEN ', strong relationship' ELSE '' END || CASE WHEN e.source_repo <> e.target_repo THEN ', cross-repo: ' || e.source_repo || ' -> ' || e.target_repo ELSE '' END AS content
FROM edges e JOIN nodes s ON s.id = e.source AND s.repo = e.source_repo JOIN nodes t ON t.id = e.target AND t.repo = e.target_repo"""))
def edge_embedding_text(spark, d):
    return embeddings.edge_rows(A.edges(spark, d), A.nodes(spark, d)).select("chunk_id", "repo", "content")


@_add("entity_embedding_text", _with("nodes", "SELECT repo || '::entity::' || id AS chunk_id, id AS entity_id, name || ' :: ' || kind || ' :: ' || coalesce(description, 'no description') AS content FROM nodes"))
def entity_embedding_text(spark, d):
    return embeddings.entity_rows(A.nodes(spark, d)).select("chunk_id", "entity_id", "content")


@_add("orphan_anti_join", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 50)")
def orphan_anti_join(spark, d):
    owners = A.read(spark, d, "lineitem").where("l_quantity >= 50").select(F.col("l_partkey").alias("p_partkey"))
    return graph.orphans(A.read(spark, d, "part").select("p_partkey"), owners, ["p_partkey"])


_REF = "id, from_repo, from_entity, to_repo, to_entity, type, strength"


@_add("cross_references", _with("refs", f"SELECT {_REF} FROM refs WHERE (from_repo IN ('region_0', 'region_1') OR to_repo IN ('region_0', 'region_1')) AND strength >= 0.05"))
def cross_references(spark, d):
    return search.cross_references(A.cross_references(spark, d), ["region_0", "region_1"], 0.05).drop("context")


@_add("cross_refs_from_results", _with("refs", f"SELECT {_REF} FROM refs WHERE (from_repo IN ('region_2', 'region_3') OR to_repo IN ('region_2', 'region_3')) AND strength >= 0.04"))
def cross_refs_from_results(spark, d):
    results = spark.createDataFrame([("region_2",), ("region_3",), ("region_2",)], "repo string")
    return search.cross_references_of(A.cross_references(spark, d), results, 0.04).drop("context")


@_add("references_to_entity", _with("refs", f"SELECT {_REF} FROM refs WHERE contains(from_entity, 'nation:1') OR contains(to_entity, 'nation:1') OR from_repo = 'region_4' OR to_repo = 'region_4'"))
def references_to_entity(spark, d):
    return search.references_to(A.cross_references(spark, d), "nation:1", "region_4").drop("context")


# fusion and analysis


def _lists(spark, d):
    def of(rows, source, key, repo, *order):
        return search.top(rows, 60, *order).select(
            F.lit(0).cast("long").alias("query_id"),
            F.lit(source).alias("source"),
            F.col("rank").cast("int").alias("rank"),
            F.concat(F.lit("o"), F.col(key).cast("string")).alias("id"),
            F.col(repo).alias("repo"),
            F.lit("").alias("content"),
            F.lit(None).cast("string").alias("metadata"),
        )

    o, c = A.read(spark, d, "orders"), A.read(spark, d, "customer")
    return of(
        o, "dense", "o_custkey", "o_orderpriority", F.desc("o_totalprice"), F.asc("o_orderkey")
    ).union(of(c, "sparse", "c_custkey", "c_mktsegment", F.desc("c_acctbal"), F.asc("c_custkey"))).union(
        of(o, "graph", "o_custkey", "o_orderpriority", F.asc("o_orderdate"), F.asc("o_orderkey"))
    )


def _fused(spark, d):
    return fusion.fuse_lists(_lists(spark, d), analysis.profile("mixed"), max_results=40)


@_add("rrf_fusion", _with("lists fused", "SELECT rank, id, repo, round(score, 9) AS score, dense, sparse, pattern, graph FROM fused"))
def rrf_fusion(spark, d):
    return _fused(spark, d).select("rank", "id", "repo", F.round("score", 9).alias("score"), *fusion.SOURCES)


@_add("rrf_coverage", _with("lists fused", "SELECT round(avg((dense IS NOT NULL)::INT), 6) AS dense, round(avg((sparse IS NOT NULL)::INT), 6) AS sparse, round(avg((pattern IS NOT NULL)::INT), 6) AS pattern, round(avg((graph IS NOT NULL)::INT), 6) AS graph FROM fused"))
def rrf_coverage(spark, d):
    return fusion.total_coverage(_fused(spark, d)).select(*[F.round(s, 6).alias(s) for s in fusion.SOURCES])


@_add("rrf_diversity", _with("lists fused", "SELECT id, CAST((dense IS NOT NULL)::INT + (sparse IS NOT NULL)::INT + (pattern IS NOT NULL)::INT + (graph IS NOT NULL)::INT AS INTEGER) AS n_sources FROM fused WHERE n_sources >= 2"))
def rrf_diversity(spark, d):
    return fusion.with_diversity(_fused(spark, d), 2).select("id", fusion.diversity().alias("n_sources"))


@_add("rrf_by_repo", _with("lists fused", "SELECT repo, count(*) AS n_results, string_agg(id, ',' ORDER BY rank) AS ids FROM fused GROUP BY repo"))
def rrf_by_repo(spark, d):
    return fusion.by_repository(_fused(spark, d)).select(
        "repo", "n_results", F.array_join("results.id", ",").alias("ids")
    )


def _four(x: str) -> str:
    """Four decimals, halves up as seen in decimal."""
    return f"CAST(CAST(CAST({x} AS DECIMAL(18, 12)) AS DECIMAL(18, 4)) AS VARCHAR)"


_SHOWN = {
    "dense": ("Dense (semantic)", 0.3),
    "sparse": ("Sparse (keyword)", 0.3),
    "pattern": ("Pattern (fuzzy)", 0.2),
    "graph": ("Graph (relationships)", 0.2),
}
_EXPLAINED = ", ".join(f"CASE WHEN {s} IS NOT NULL THEN '  - {n}: rank ' || {s} || ' → score ' || {_four(f"{w} / (60 + {s})")} || ' (weight: {w})' END" for s, (n, w) in _SHOWN.items())
_TOTAL = " + ".join(f"coalesce({w} / (60 + {s}), 0)" for s, (_, w) in _SHOWN.items())


@_add("rrf_explanations", _with("lists fused", f"SELECT rank, id, concat_ws(chr(10), 'Total RRF score: ' || {_four(_TOTAL)}, {_EXPLAINED}) AS explanation FROM fused"))
def rrf_explanations(spark, d):
    return _fused(spark, d).select("rank", "id", fusion.explanation(analysis.profile("mixed")).alias("explanation"))


@_add("rrf_from_source", _with("lists fused", "SELECT rank, id, graph FROM fused WHERE graph IS NOT NULL"))
def rrf_from_source(spark, d):
    return fusion.from_source(_fused(spark, d), "graph").select("rank", "id", "graph")


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _sql_any(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower(query), {_quoted(w)})" for w in words) + ")"


_IDS_OF_QUERY = ", ".join(f"regexp_extract_all(query, '{p}')" for p in text.IDENTIFIER_PATTERNS)


_QUERY_TYPE = f"""CASE WHEN {_sql_any(analysis.RELATIONSHIP_WORDS)} THEN 'relationship'
  WHEN len(regexp_extract_all(query, {_quoted(analysis.SPECIALS)})) >= 2 OR regexp_matches(query, {_quoted(analysis.KEY_LIKE)}) THEN 'pattern'
  WHEN len(flatten([{_IDS_OF_QUERY}])) > 0 AND NOT {_sql_any(analysis.CONCEPTUAL_WORDS)} THEN 'identifier'
  WHEN regexp_matches(query, {_quoted(analysis.CONSONANTS)}) THEN 'fuzzy'
  WHEN {_sql_any(analysis.CONCEPTUAL_WORDS)} THEN 'conceptual' ELSE 'mixed' END"""


@_add("query_classification", f"""
SELECT CAST(query_id AS BIGINT) AS query_id, {_QUERY_TYPE} AS query_type, regexp_matches(query, {_quoted(analysis.CONSONANTS)}) AS has_typos
FROM (VALUES {", ".join(f"({i}, {_quoted(q)})" for i, q, _ in A.QUERIES)}) q(query_id, query)""")
def query_classification(spark, d):
    return analysis.analyze_batch(A.query_set(spark)).select("query_id", "query_type", "has_typos")


@_add("conversation_classification", f"SELECT query_type, count(*) AS n FROM (SELECT {_QUERY_TYPE} AS query_type FROM (SELECT coalesce(text, '') AS query FROM conversations)) GROUP BY query_type")
def conversation_classification(spark, d):
    said = A.read(spark, d, "conversations").select(F.coalesce("text", F.lit("")).alias("query"))
    return analysis.analyze_batch(said).groupBy("query_type").agg(F.count(F.lit(1)).alias("n"))


@_add("normalize_weights", "SELECT o_orderkey, round(CASE WHEN a + b + c + e = 0 THEN 0.25 ELSE a / (a + b + c + e) END, 9) AS dense, round(CASE WHEN a + b + c + e = 0 THEN 0.25 ELSE e / (a + b + c + e) END, 9) AS graph FROM (SELECT o_orderkey, (o_orderkey % 3)::DOUBLE AS a, (o_orderkey % 5)::DOUBLE AS b, (o_orderkey % 7)::DOUBLE AS c, (o_orderkey % 2)::DOUBLE AS e FROM orders)")
def normalize_weights(spark, d):
    k = F.col("o_orderkey")
    found = analysis.normalized_columns(
        {
            "dense": (k % 3).cast("double"),
            "sparse": (k % 5).cast("double"),
            "pattern": (k % 7).cast("double"),
            "graph": (k % 2).cast("double"),
        }
    )
    return A.read(spark, d, "orders").select(
        "o_orderkey", F.round(found["dense"], 9).alias("dense"), F.round(found["graph"], 9).alias("graph")
    )


@_add("token_estimate", _with("chunks", "SELECT repo, CAST(ceil((sum(length(content)) + sum(length(chunk_id))) / 4.0) AS BIGINT) AS tokens FROM chunks GROUP BY repo"))
def token_estimate(spark, d):
    return A.chunks(spark, d).groupBy("repo").agg(
        text.token_estimate(F.col("content"), F.col("chunk_id")).cast("long").alias("tokens")
    )


# store


@_add("repo_stats", _with("chunks nodes edges emb", """
SELECT repo, count(CASE WHEN w = 1 THEN 1 END) AS nodes, count(CASE WHEN w = 2 THEN 1 END) AS edges, count(CASE WHEN w = 3 THEN 1 END) AS chunks, count(CASE WHEN w = 4 THEN 1 END) AS embeddings, 'completed' AS status
FROM (SELECT repo, 1 AS w FROM nodes UNION ALL SELECT source_repo, 2 FROM edges UNION ALL SELECT repo, 3 FROM chunks UNION ALL SELECT repo, 4 FROM emb) GROUP BY repo"""))
def repo_stats(spark, d):
    return store.status_counts(
        {
            "nodes": A.nodes(spark, d),
            "edges": A.edges(spark, d),
            "chunks": A.chunks(spark, d),
            "embeddings": A.embeddings(spark, d),
        }
    )


_CASCADE = {
    "nodes": ("nodes", "repo"), "edges": ("edges", "source_repo target_repo"), "chunks": ("chunks", "repo"),
    "embeddings": ("emb", "repo"), "repositories": ("repos", "id"), "cross_references": ("refs", "from_repo to_repo"),
}
_GONE = ["supplier", "label_1", "region_1", "src1"]
_SQL["repos"] = "repos AS (SELECT DISTINCT repo AS id FROM (SELECT repo FROM nodes UNION ALL SELECT repo FROM emb UNION ALL SELECT repo FROM chunks))"


def _sql_left(what: str) -> str:
    table, columns = _CASCADE[what]
    tests = " AND ".join(f"{c} NOT IN ({', '.join(map(_quoted, _GONE))})" for c in columns.split())
    return f"SELECT '{what}' AS what, count(*) AS n FROM {table} WHERE {tests}"


@_add("repo_delete_cascade", _with("nodes edges refs emb chunks repos", " UNION ALL ".join(map(_sql_left, _CASCADE))))
def repo_delete_cascade(spark, d):
    """What is left of each table when some repositories are deleted."""
    tables = {
        "nodes": A.nodes(spark, d),
        "edges": A.edges(spark, d),
        "chunks": A.chunks(spark, d),
        "embeddings": A.embeddings(spark, d),
        "cross_references": A.cross_references(spark, d),
    }
    names = tables["nodes"].select("repo").union(
        tables["embeddings"].select("repo")
    ).union(tables["chunks"].select("repo"))
    left = tables | {"repositories": names.distinct().withColumnRenamed("repo", "id")}
    for repo in _GONE:
        left = store.without_repo(left, repo)
    parts = [
        rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n") for name, rows in left.items()
    ]
    return reduce(DataFrame.union, parts)


@_add("repository_upsert", "SELECT 'r' || o_custkey % 50 AS id, arg_max(o_orderpriority, o_orderkey) AS version FROM orders GROUP BY ALL")
def repository_upsert(spark, d):
    rows = A.read(spark, d, "orders").select(
        F.concat(F.lit("r"), (F.col("o_custkey") % 50).cast("string")).alias("id"),
        F.col("o_orderpriority").alias("version"),
        F.col("o_orderkey").alias("seq"),
    )
    return store.keep_last(rows.drop("seq").where(F.lit(False)), rows, ["id"], "seq")


@_add("prefix_stats", _with("nodes edges", "SELECT (SELECT count(*) FROM nodes WHERE id LIKE 'supplier:%') AS nodes, (SELECT count(*) FROM edges WHERE source LIKE 'supplier:%') AS edges"))
def prefix_stats(spark, d):
    """Nodes and edges by the prefix of their ids, as those of a markdown repository are told."""
    nodes = graph.with_prefix(A.nodes(spark, d), "id", "supplier", ":").agg(F.count(F.lit(1)).alias("nodes"))
    edges = graph.with_prefix(A.edges(spark, d), "source", "supplier", ":").agg(F.count(F.lit(1)).alias("edges"))
    # a row each
    return nodes.crossJoin(F.broadcast(edges))


@_add("repo_stamp", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment ELSE 'stamped' END AS repo FROM customer")
def repo_stamp(spark, d):
    key = F.col("c_custkey") % 3
    rows = A.read(spark, d, "customer").select(
        "c_custkey", F.when(key == 0, F.col("c_mktsegment")).when(key == 1, F.lit("")).alias("repo")
    )
    return graph.stamp_repo(rows, "stamped")


@_add("extraction_counts", "SELECT CAST(sum(s_suppkey % 3) AS BIGINT) AS entities, CAST(sum(s_suppkey % 2) AS BIGINT) AS relationships FROM supplier")
def extraction_counts(spark, d):
    n = F.col("s_suppkey")
    lines = F.concat(
        F.repeat(F.lit("Entity: x\n"), (n % 3).cast("int")),
        F.repeat(F.lit("Parsed relationship: a -> b\n"), (n % 2).cast("int")),
    )
    return ingest.counts_in_output(A.read(spark, d, "supplier").select(lines.alias("elements")))


@_add("centrality_summary", _with("nodes edges", """, top AS (SELECT id, count(e.id2) AS degree FROM nodes LEFT JOIN (SELECT source AS id2 FROM edges UNION ALL SELECT target FROM edges) e ON id = e.id2 GROUP BY id ORDER BY degree DESC, id LIMIT 10)
SELECT string_agg(nth || '. ' || id || ': ' || degree || ' edges', chr(10) ORDER BY nth) AS lines FROM (SELECT *, row_number() OVER (ORDER BY degree DESC, id) AS nth FROM top)""").replace("\n, top", ", top"))
def centrality_summary(spark, d):
    top = [(r["id"], r["degree"]) for r in graph.degree_top(A.nodes(spark, d), A.edges(spark, d)).collect()]
    return spark.createDataFrame([("\n".join(graph.centrality_text(top).strip().split("\n")[1:]),)], "lines string")


@_add("graph_export", _with("nodes edges", "SELECT 'node' AS kind, id AS source, NULL AS target, NULL AS relationship, NULL::DOUBLE AS weight FROM nodes UNION ALL SELECT 'link', source, target, relationship, weight FROM edges"))
def graph_export(spark, d):
    none = F.lit(None).cast("string")
    n = A.nodes(spark, d).select(
        F.lit("node").alias("kind"),
        F.col("id").alias("source"),
        none.alias("target"),
        none.alias("relationship"),
        F.lit(None).cast("double").alias("weight"),
    )
    return n.union(A.edges(spark, d).select(F.lit("link"), "source", "target", "relationship", "weight"))


_PAGE_TEXT = "regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->', ' ', 'gis'), '<[^>]+>', ' ', 'gs')"
for _entity, _char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _PAGE_TEXT = f"replace({_PAGE_TEXT}, '{_entity}', '{_char}')"


@_add("page_text_chunks", f"""
SELECT substr(sha256(concat_ws(':', 'web', url, CAST(s AS VARCHAR))), 1, 16) AS chunk_id, 'web' AS repo, sha256(substr(t, s + 1, 600)) AS content_sha256, s AS start_char, CAST(1 AS INTEGER) AS start_line, CAST(1 AS INTEGER) AS end_line
FROM (SELECT url, t, CAST(unnest(range(0, length(t), 500)) AS INTEGER) AS s FROM (SELECT url, trim(regexp_replace({_PAGE_TEXT}, '[ \t\n\x0B\f\r]+', ' ', 'g')) AS t FROM pages))""")
def page_text_chunks(spark, d):
    pages = A.read(spark, d, "pages").select(
        F.lit("web").alias("repo"), F.col("url").alias("path"), files_source.strip_tags("html").alias("text")
    )
    meta = F.from_json("metadata", "start_line int, end_line int, start_char int")
    rows = chunking.file_chunks(pages).withColumn("m", meta)
    return rows.select(
        "chunk_id", "repo", F.sha2("content", 256).alias("content_sha256"), "m.start_char", "m.start_line", "m.end_line"
    )


@_add("markdown_chunks")
def markdown_chunks(spark, d):
    return chunking.markdown_rows(A.markdown_docs(spark, d))


_SUPPLIER_NAME = "trim(lower(s_name))"


@_add("graph_from_summaries", f"SELECT {_SUPPLIER_NAME} AS source, 'nation ' || s_nationkey AS target, 'located_in' AS relationship, CASE s_suppkey % 3 WHEN 0 THEN 0.8 WHEN 1 THEN 0.4 ELSE 1.0 END::DOUBLE AS weight, 'suppliers' AS source_repo FROM supplier")
def graph_from_summaries(spark, d):
    return graph.graph_from_summaries(A.llm_summaries(spark, d))[1].drop("target_repo")


@_add("graph_nodes_from_summaries", f"SELECT DISTINCT id, 'suppliers' AS repo FROM (SELECT {_SUPPLIER_NAME} AS id FROM supplier UNION ALL SELECT 'nation ' || s_nationkey FROM supplier)")
def graph_nodes_from_summaries(spark, d):
    return graph.graph_from_summaries(A.llm_summaries(spark, d))[0].drop("properties")


@_add("entity_embeddings")
def entity_embeddings(spark, d):
    return embeddings.embed_entities(A.nodes(spark, d), embeddings.create_provider("hashing"))


@_add("edge_embeddings")
def edge_embeddings(spark, d):
    return embeddings.embed_edges(A.edges(spark, d), A.nodes(spark, d), embeddings.create_provider("hashing"))


# the whole


def tables(spark: SparkSession, d: str) -> hybrid.Tables:
    nodes = A.nodes(spark, d)
    return hybrid.Tables(
        A.chunks(spark, d),
        nodes,
        A.edges(spark, d),
        embeddings.embed_entities(nodes, embeddings.create_provider("hashing")),
        A.cross_references(spark, d),
    )


@_add("hybrid_search")
def hybrid_search(spark, d):
    engine = hybrid.HybridSearch(tables(spark, d), embeddings.create_provider("hashing"))
    return engine.search(
        "the license and region", force_weights={"dense": 0.3, "sparse": 0.3, "pattern": 0.2, "graph": 0.2}
    ).results


@_add("hybrid_batch")
def hybrid_batch(spark, d):
    """Each turn of the conversations whose id is divisible by 20 is a query, with its whole text."""
    said = A.read(spark, d, "conversations").where("conv_id % 20 = 0")
    queries = said.select(
        (F.col("conv_id") * 1000 + F.col("turn")).cast("long").alias("query_id"),
        F.coalesce("text", F.lit("")).alias("query"),
    )
    return hybrid.batch(tables(spark, d), queries, provider=embeddings.create_provider("hashing"), mode="or")


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)
