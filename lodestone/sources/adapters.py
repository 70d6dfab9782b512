"""The engine's tables from star-schema and text tables: chunks, nodes, edges, embeddings, references, fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunking


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt out to all cores, if the files that they come from give fewer tasks than there are cores.

    A small table in one row group would be worked on by one task; a large one has tasks enough and isn't moved.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spread(read(spark, sf_dir, "documents").select(*columns))


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of the repository that they came from."""
    return documents(spark, sf_dir, "doc_id", "source", "text").select(
        F.col("source").alias("repo"), F.col("doc_id").cast("string").alias("path"), "text"
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.file_chunks(files(spark, sf_dir))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node for each region, nation, customer, supplier and part."""

    def of(table: str, key: str, name: str, kind: str, description: str | None = None) -> DataFrame:
        hint = F.col(description).cast("string") if description else F.lit(None).cast("string")
        props = F.to_json(F.struct(F.col(name).alias("name"), F.lit(kind).alias("type"), hint.alias("description")))
        return read(spark, sf_dir, table).select(
            F.concat(F.lit(f"{table}:"), F.col(key).cast("string")).alias("id"),
            F.lit(table).alias("repo"),
            props.alias("properties"),
        )

    return of("region", "r_regionkey", "r_name", "region").union(of("nation", "n_nationkey", "n_name", "nation")).union(
        of("customer", "c_custkey", "c_name", "customer", "c_mktsegment")
    ).union(of("supplier", "s_suppkey", "s_name", "supplier")).union(
        of("part", "p_partkey", "p_name", "part", "p_type")
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers in nations, nations in regions, and what suppliers supply, by share of the largest quantity."""
    link = lambda t, k: F.concat(F.lit(f"{t}:"), F.col(k).cast("string"))

    def of(table: str, key: str, to: str, to_key: str, relation: str) -> DataFrame:
        return read(spark, sf_dir, table).select(
            link(table, key).alias("source"),
            link(to, to_key).alias("target"),
            F.lit(relation).alias("relationship"),
            F.lit(1.0).alias("weight"),
            F.lit(table).alias("source_repo"),
            F.lit(to).alias("target_repo"),
        )

    supplied = read(spark, sf_dir, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.sum("l_quantity").alias("q"))
    most = supplied.agg(F.max("q").alias("m"))
    # one row: the largest quantity
    supplies = supplied.crossJoin(F.broadcast(most)).select(
        link("supplier", "l_suppkey").alias("source"),
        link("part", "l_partkey").alias("target"),
        F.lit("supplies").alias("relationship"),
        F.round(F.try_divide("q", "m"), 6).alias("weight"),
        F.lit("supplier").alias("source_repo"),
        F.lit("part").alias("target_repo"),
    )
    return of("customer", "c_custkey", "nation", "c_nationkey", "located_in").union(
        of("supplier", "s_suppkey", "nation", "s_nationkey", "located_in")
    ).union(of("nation", "n_nationkey", "region", "n_regionkey", "part_of")).union(supplies)


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").cast("string").alias("chunk_id"),
        F.concat(F.lit("label_"), F.col("label").cast("string")).alias("repo"),
        F.lit("").alias("entity_id"),
        F.lit("entity").alias("chunk_type"),
        F.concat(F.lit("vector "), F.col("vec_id").cast("string")).alias("content"),
        "embedding",
        F.lit(None).cast("string").alias("metadata"),
    )


def cross_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier nations to customer nations, by the share of the supplier nation's quantity that goes there."""
    item = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    suppliers = read(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    sold = item.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(
        customers, F.col("o_custkey") == F.col("c_custkey")
    ).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    pairs = sold.groupBy("s_nationkey", "c_nationkey").agg(F.sum("l_quantity").alias("q"))
    total = pairs.groupBy("s_nationkey").agg(F.sum("q").alias("t"))
    nation = read(spark, sf_dir, "nation")
    name = lambda c: F.concat(F.lit("nation:"), F.col(c).cast("string"))
    region = lambda key, out: nation.select(F.col("n_nationkey").alias(key), F.concat(F.lit("region_"), F.col("n_regionkey").cast("string")).alias(out))
    found = pairs.join(total, "s_nationkey").join(
        region("s_nationkey", "from_repo"), "s_nationkey"
    ).join(region("c_nationkey", "to_repo"), "c_nationkey")
    return found.select(
        (F.col("s_nationkey") * 100 + F.col("c_nationkey")).cast("long").alias("id"),
        "from_repo",
        name("s_nationkey").alias("from_entity"),
        "to_repo",
        name("c_nationkey").alias("to_entity"),
        F.lit("sells_to").alias("type"),
        F.round(F.try_divide("q", "t"), 6).alias("strength"),
        F.lit(None).cast("string").alias("context"),
    )


def markdown_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A markdown document from each text: a section for each line, with code, tables and lists among them."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x != "")

    def section(x, i):
        n = (i + 1).cast("string")
        head = F.concat(F.lit("## Section "), n, F.lit("\n\n"), x)
        code = F.when((i + 1) % 3 == 0, F.concat(F.lit("\n\n```\ncode "), n, F.lit("\n\nend\n```"))).otherwise("")
        table = F.when(
            (i + 1) % 5 == 0, F.concat(F.lit("\n\n| a | b |\n|---|---|\n| "), n, F.lit(" | x |"))
        ).otherwise("")
        items = F.when((i + 1) % 4 == 0, F.concat(F.lit("\n\n- one "), n, F.lit("\n- two"))).otherwise("")
        return F.concat(head, code, table, items)

    body = F.array_join(F.transform(lines, section), "\n\n")
    return documents(spark, sf_dir, "doc_id", "source", "text").select(F.col("source").alias("repo"), "doc_id", F.concat(F.lit("# Doc "), F.col("doc_id").cast("string"), F.lit("\n\n"), body).alias("markdown"))


def llm_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model might say about suppliers: every spelling of headers, numbers, bold names and strengths."""
    s = read(spark, sf_dir, "supplier")
    kind = F.col("s_suppkey") % 3
    head = lambda w: F.when(kind == 0, f"### {w}:").when(kind == 1, f"**{w}:**").otherwise(f"{w}:")
    name, nation = F.col("s_name"), F.concat(F.lit("Nation "), F.col("s_nationkey").cast("string"))
    link = F.when(kind == 0, F.concat(name, F.lit(" -> located in [strength: 0.8] -> "), nation)).when(
        kind == 1, F.concat(name, F.lit(" -> located in -> "), nation, F.lit(" [strength: 0.4]"))
    ).otherwise(F.concat(name, F.lit(" -> located in -> "), nation))
    text = F.concat_ws(
        "\n",
        head("Entities"),
        F.concat(F.lit("1. **"), name, F.lit("**")),
        nation,
        head("Relationships"),
        link,
        F.concat(name, F.lit(" -> ships -> Nowhere")),
    )
    return s.select(
        F.lit("suppliers").alias("repo"),
        F.col("s_suppkey").cast("long").alias("call_id"),
        F.lit(0).alias("seq"),
        text.alias("summary"),
    )


#: Queries of each type and a few traps.
QUERIES = [
    (1, "how do i explain the of and tion", "conceptual"),
    (2, "what uses the supplier", "relationship"),
    (3, "dependencies of nation", "relationship"),
    (4, "StreamingTextResponse", "identifier"),
    (5, "streaming_text_response", "identifier"),
    (6, "authentcation modlue thndxr", "fuzzy"),
    (7, "foo.*bar[0-9]+", "pattern"),
    (8, "find sk-abcdef123456", "pattern"),
    (9, "error in the module", "mixed"),
    (10, "How to use the guide", "conceptual"),
    (11, "how to fix rhythm", "fuzzy"),
    (12, "is a + b * c", "pattern"),
    (13, "what is a nation", "conceptual"),
    (14, "the of and", "mixed"),
]


def query_set(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(QUERIES, "query_id long, query string, expected_type string")
