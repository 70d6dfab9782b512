"""The store: Parquet tables under a folder, with write-time keys, cascading deletes and migrations.

A table is dealt into buckets by a hash of its key. A write reads and replaces only the buckets that its keys fall into,
in a new folder; then one manifest names the folders of all tables, so changes to several tables are seen together or
not at all. Manifests are numbered, and of two writers at once the second fails instead of undoing the first. The inverted
index of chunks is kept by the same buckets and changes with them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import errors, schemas
from ..functions import text
from ..operators import graph, search


#: Buckets of a new table; a store of many TB takes some thousand.
BUCKETS = 8


def keep_first(old: DataFrame, new: DataFrame, keys: list[str], seq: str | None = None) -> DataFrame:
    """Insert or ignore: the row that was there, or came first, stays."""
    order = F.col(seq) if seq else F.monotonically_increasing_id()
    rows = old.withColumns({"_new": F.lit(0), "_seq": F.lit(0).cast("long")}).unionByName(
        new.withColumns({"_new": F.lit(1), "_seq": order.cast("long")}).select(*old.columns, "_new", "_seq")
    )
    return graph.latest(rows, keys, [F.asc("_new"), F.asc("_seq")]).select(*old.columns)


def keep_last(old: DataFrame, new: DataFrame, keys: list[str], seq: str | None = None) -> DataFrame:
    """Insert or replace: the row that came last stays."""
    order = F.col(seq) if seq else F.monotonically_increasing_id()
    rows = old.withColumns({"_new": F.lit(0), "_seq": F.lit(0).cast("long")}).unionByName(
        new.withColumns({"_new": F.lit(1), "_seq": order.cast("long")}).select(*old.columns, "_new", "_seq")
    )
    return graph.latest(rows, keys, [F.desc("_new"), F.desc("_seq")]).select(*old.columns)


def without_repo(tables: dict[str, DataFrame], repo: str) -> dict[str, DataFrame]:
    """All tables without a repository: its rows, edges and references that touch it, its embeddings."""
    away = {
        "nodes": ["repo"],
        "edges": ["source_repo", "target_repo"],
        "chunks": ["repo"],
        "embeddings": ["repo"],
        "repositories": ["id"],
        "cross_references": ["from_repo", "to_repo"],
        "files": ["repo"],
    }
    out = dict(tables)
    for name, columns in away.items():
        if name in tables:
            for c in columns:
                out[name] = out[name].where(~F.col(c).eqNullSafe(F.lit(repo)))
    return out


def status_counts(tables: dict[str, DataFrame], repo: str | None = None) -> DataFrame:
    """Nodes, edges, chunks and embeddings of each repository, and whether any are there."""
    parts = [
        tables["nodes"].select("repo", F.lit("nodes").alias("what")),
        tables["chunks"].select("repo", F.lit("chunks").alias("what")),
        tables["edges"].select(F.col("source_repo").alias("repo"), F.lit("edges").alias("what")),
    ]
    if "embeddings" in tables:
        parts.append(tables["embeddings"].select("repo", F.lit("embeddings").alias("what")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.union(p)
    rows = rows if repo is None else rows.where(F.col("repo") == repo)
    return rows.groupBy("repo").agg(
        *[F.count(F.when(F.col("what") == w, 1)).alias(w) for w in ("nodes", "edges", "chunks", "embeddings")]
    ).withColumn(
        "status",
        F.when(
            F.col("nodes") + F.col("edges") + F.col("chunks") + F.col("embeddings") > 0, "completed"
        ).otherwise("pending"),
    )


class Migration:
    def __init__(
        self,
        version: int,
        name: str,
        up: Callable[[dict[str, DataFrame]], dict[str, DataFrame]],
        down: Callable[[dict[str, DataFrame]], dict[str, DataFrame]],
    ):
        self.version, self.name, self.up, self.down = version, name, up, down


def _multi_repo_up(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Repository columns, 'default' where there is none, and the tables about repositories."""
    out = dict(tables)
    for name, columns in {"nodes": ["repo"], "edges": ["source_repo", "target_repo"], "chunks": ["repo"]}.items():
        if name in out:
            for c in columns:
                old = F.col(c) if c in out[name].columns else F.lit(None).cast("string")
                out[name] = out[name].withColumn(c, F.coalesce(old, F.lit("default")))
    if out:
        spark = next(iter(out.values())).sparkSession
        if "repositories" not in out:
            out["repositories"] = spark.createDataFrame([], schemas.TABLES["repositories"])
        if "cross_references" not in out:
            out["cross_references"] = spark.createDataFrame([], schemas.TABLES["cross_references"])
        default = spark.createDataFrame([("default", "default")], "id string, name string").select(
            "id",
            "name",
            F.current_timestamp().alias("indexed_at"),
            *[
                F.lit(None).cast("string").alias(c) for c in (
                    "version", "branch", "commit_hash", "metadata", "embedding_model"
                )
            ],
        )
        out["repositories"] = keep_first(out["repositories"], default, ["id"])
    return out


def _multi_repo_down(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables about repositories go, the columns stay."""
    return {k: v for k, v in tables.items() if k not in ("repositories", "cross_references")}


MIGRATIONS = [Migration(1, "add_multi_repo_support", _multi_repo_up, _multi_repo_down)]


@dataclass
class Change:
    """New folders of a table's buckets; all other buckets go if `whole`, the table itself if `dropped`."""

    schema: str = ""
    parts: dict[str, str] = field(default_factory=dict)
    touched: set[str] = field(default_factory=set)
    whole: bool = False
    dropped: bool = False
    stats: dict[str, list[int]] = field(default_factory=dict)


class Store:
    """Tables in a folder that Spark reaches. `buckets` holds for tables that aren't there yet."""

    def __init__(
        self, spark: SparkSession, path: str, migrations: list[Migration] | None = None, buckets: int = BUCKETS
    ):
        if not path:
            raise errors.StoreConnectionError("a store needs a path", context={"path": path})
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        self.migrations = MIGRATIONS if migrations is None else migrations
        jvm = spark._jvm
        self._at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # manifests

    def _numbers(self) -> list[int]:
        folder = self._at(f"{self.path}/_manifest")
        if not self._fs.exists(folder):
            return []
        return sorted(
            int(
                s.getPath().getName()[1:9]
            ) for s in self._fs.listStatus(folder) if s.getPath().getName().startswith("v")
        )

    def _read(self, number: int) -> dict:
        stream = self._fs.open(self._at(f"{self.path}/_manifest/v{number:08d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _manifest(self) -> tuple[int, dict]:
        numbers = self._numbers()
        return (numbers[-1], self._read(numbers[-1])) if numbers else (0, {})

    def delete(self, folder: str) -> None:
        self._fs.delete(self._at(folder), True)

    def _folders(self, manifest: dict) -> set[str]:
        return {p for t in manifest.values() for p in t["parts"].values()}

    def _commit(self, number: int, before: dict, changes: dict[str, Change]) -> None:
        """Make the changes the next manifest; what only manifests before the last one know is deleted."""
        after = {k: dict(v) for k, v in before.items()}
        for name, c in changes.items():
            if c.dropped:
                after.pop(name, None)
                continue
            old = before.get(name, {"buckets": self.buckets, "parts": {}, "stats": {}})
            kept = {} if c.whole else {b: p for b, p in old["parts"].items() if b not in c.touched}
            stats = {} if c.whole else {b: s for b, s in old.get("stats", {}).items() if b not in c.touched}
            after[name] = {
                "schema": c.schema, "buckets": old["buckets"], "parts": kept | c.parts, "stats": stats | c.stats
            }
        try:
            out = self._fs.create(self._at(f"{self.path}/_manifest/v{number + 1:08d}.json"), False)
        except Exception as e:
            raise errors.StoreConnectionError(
                "another writer has changed the store meanwhile", context={"path": self.path}
            ) from e
        out.write(bytearray(json.dumps(after).encode()))
        out.close()
        for n in self._numbers():
            if n < number:
                for gone in self._folders(self._read(n)) - self._folders(before) - self._folders(after):
                    self._fs.delete(self._at(f"{self.path}/{gone}"), True)
                self._fs.delete(self._at(f"{self.path}/_manifest/v{n:08d}.json"), False)

    # tables

    def _schema(self, name: str) -> str:
        return schemas.TABLES.get(name) or schemas.DERIVED[name]

    def _keys(self, name: str) -> list[str]:
        return schemas.KEYS[name][0]

    def has(self, name: str) -> bool:
        return name in self._manifest()[1]

    def _parts(self, manifest: dict, name: str, only: set[str] | None = None) -> DataFrame:
        about = manifest.get(name)
        if about is None:
            return self.spark.createDataFrame([], self._schema(name))
        schema = T.StructType.fromJson(json.loads(about["schema"]))
        paths = [f"{self.path}/{p}" for b, p in sorted(about["parts"].items()) if only is None or b in only]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def table(self, name: str) -> DataFrame:
        """A table; one that isn't there is empty, so its searches find nothing."""
        return self._parts(self._manifest()[1], name)

    def tables(self) -> dict[str, DataFrame]:
        there = self._manifest()[1]
        return {n: self._parts(there, n) for n in schemas.TABLES if n in there}

    def _bucket(self, name: str, n: int):
        return F.pmod(F.xxhash64(*self._keys(name)), F.lit(n)).cast("int").cast("string").alias("_bucket")

    def _lay(self, name: str, rows: DataFrame, n: int, order: list[str] | None = None) -> dict[str, str]:
        """Write rows by buckets to a new folder: bucket to folder."""
        own = f"{name}/{uuid.uuid4().hex}"
        dealt = rows.select("*", self._bucket(name, n)).repartition("_bucket")
        if order:
            dealt = dealt.sortWithinPartitions("_bucket", *order)
        dealt.write.partitionBy("_bucket").parquet(f"{self.path}/{own}")
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(f"{self.path}/{own}"))]
        return {x.partition("=")[2]: f"{own}/{x}" for x in names if x.startswith("_bucket=")}

    def _indexed(self, manifest: dict, change: Change) -> Change:
        """The inverted index of the buckets of chunks that a change holds, sorted by term, and their counts."""
        n = manifest.get("chunks", {}).get("buckets", self.buckets)
        paths = [f"{self.path}/{p}" for p in change.parts.values()]
        out = Change(self._as_json(schemas.DERIVED["postings"]), {}, change.touched, change.whole)
        if paths:
            chunks = self.spark.read.schema(T.StructType.fromJson(json.loads(change.schema))).parquet(*paths)
            out.parts = self._lay("postings", search.stemmed(search.postings(chunks)), n, ["term"])
            length = F.size(text.tokens("content")).cast("long")
            counts = chunks.groupBy(self._bucket("chunks", n)).agg(
                F.count(F.lit(1)), F.coalesce(F.sum(length), F.lit(0))
            )
            out.stats = {b: [c, t] for b, c, t in counts.collect()}
        return out

    def _as_json(self, ddl: str) -> str:
        return T.StructType.fromDDL(ddl).json()

    def _whole(self, name: str, rows: DataFrame, n: int) -> Change:
        return Change(rows.schema.json(), self._lay(name, rows, n), whole=True)

    def _finish(self, manifest: dict, changes: dict[str, Change]) -> dict[str, Change]:
        if "chunks" in changes and "repo" in changes["chunks"].schema:
            changes["postings"] = self._indexed(manifest, changes["chunks"])
        return changes

    def write_all(self, tables: dict[str, DataFrame], drop: list[str] | None = None) -> None:
        """Replace some tables and drop others, in one manifest."""
        number, there = self._manifest()
        changes = {n: self._whole(n, rows, there.get(n, {}).get("buckets", self.buckets)) for n, rows in tables.items()}
        changes |= {n: Change(dropped=True) for n in drop or []}
        self._commit(number, there, self._finish(there, changes))

    def write(self, name: str, rows: DataFrame) -> None:
        """Replace a table."""
        self.write_all({name: rows})

    def drop(self, name: str) -> None:
        self.write_all({}, [name])

    def _merged(
        self, manifest: dict, name: str, rows: DataFrame, gone: DataFrame | None, seq: str | None, rule: str | None
    ) -> Change:
        n = manifest.get(name, {}).get("buckets", self.buckets)
        keys, which = schemas.KEYS[name]
        empty = self._parts(manifest, name, set())
        order = F.col(seq) if seq else F.monotonically_increasing_id()
        # what comes in is worked out once; a model's answers, say, may differ the next time
        incoming = self._lay(name, rows.select(*empty.columns, order.cast("long").alias("_order")), n)
        touched = set(incoming)
        if gone is not None:
            touched |= {r[0] for r in gone.select(self._bucket(name, n)).distinct().collect()}
        old = self._parts(manifest, name, touched)
        if gone is not None:
            old = old.join(gone.select(*keys), keys, "left_anti").select(*empty.columns)
        schema = T.StructType([*empty.schema.fields, T.StructField("_order", T.LongType())])
        paths = [f"{self.path}/{p}" for p in incoming.values()]
        new = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        merge = keep_first if (rule or which) == "first" else keep_last
        parts = self._lay(name, merge(old, new, keys, "_order"), n)
        if paths:
            self._fs.delete(self._at(paths[0].rpartition("/")[0]), True)
        return Change(empty.schema.json(), parts, touched)

    def put_all(
        self,
        tables: dict[str, DataFrame],
        gone: dict[str, DataFrame] | None = None,
        seq: str | None = None,
        rule: str | None = None,
    ) -> None:
        """Delete the rows with the keys in `gone`, then write rows under each table's rule for equal keys, in one manifest.

        The rule: the first of nodes stays, the last of all else; `rule` may say otherwise.
        """
        number, there = self._manifest()
        gone = gone or {}
        changes = {}
        for name in [*tables, *[g for g in gone if g not in tables]]:
            rows = tables[name] if name in tables else self._parts(there, name, set())
            changes[name] = self._merged(there, name, rows, gone.get(name), seq, rule)
        self._commit(number, there, self._finish(there, changes))

    def put(self, name: str, rows: DataFrame, seq: str | None = None) -> None:
        """Write rows of one table."""
        self.put_all({name: rows}, seq=seq)

    def put_new(self, name: str, rows: DataFrame) -> None:
        """Append rows whose key isn't there."""
        self.put_all({name: rows}, rule="first")

    def nodes(self) -> DataFrame:
        return self.table("nodes")

    def edges(self) -> DataFrame:
        return self.table("edges")

    def chunks(self) -> DataFrame:
        return self.table("chunks")

    def postings(self) -> DataFrame:
        """The inverted index of stems, sorted by term within each file, so that a search reads the terms it asks for."""
        return self.table("postings")

    def posting_stats(self) -> DataFrame:
        """One row: number of chunks and their terms."""
        stats = self._manifest()[1].get("postings", {}).get("stats", {}).values()
        return self.spark.createDataFrame(
            [(sum(s[0] for s in stats), sum(s[1] for s in stats))], "n_chunks long, n_terms long"
        )

    def trigrams(self) -> DataFrame:
        """chunk_id, position and trigram, derived."""
        return self.chunks().select("chunk_id", F.posexplode(text.trigrams("content")).alias("position", "trigram"))

    # files

    def put_files(self, files: DataFrame, *, repo: str | None = None) -> None:
        """Chunk files (repo, path, text and error) into the store; what a file has lost since its last version goes.

        A file with an error keeps what it had and is listed with the error in `files`. With `repo`, these are all files of
        that repository, and those that aren't among them go as a whole.
        """
        from ..operators import chunking

        folder = f"{self.path}/_staged/{uuid.uuid4().hex}"
        files.select("repo", "path", "text", "error").write.parquet(folder)
        files = self.spark.read.schema("repo string, path string, text string, error string").parquet(folder)
        step = chunking.SIZE - chunking.OVERLAP
        count = F.when(F.col("error").isNull(), F.ceil(F.coalesce(F.length("text"), F.lit(0)) / step)).cast("int")
        now = files.select("repo", "path", count.alias("n_chunks"), "error")
        there_ = self._manifest()[1]
        n = there_.get("files", {}).get("buckets", self.buckets)
        # some files are looked up in their buckets only
        own = None if repo is not None else {r[0] for r in files.select(self._bucket("files", n)).distinct().collect()}
        known = self._parts(there_, "files", own).select("repo", "path", F.col("n_chunks").alias("_had"))
        if repo is not None:
            known = known.where(F.col("repo") == repo)
        both = now.join(known, ["repo", "path"], "left" if repo is None else "full")
        there = F.coalesce("n_chunks", F.when(F.col("error").isNotNull(), F.col("_had")), F.lit(0))
        # beyond the chunks that a file has now, those it had
        lost = both.where(F.col("_had") > there).select(
            "repo", "path", F.explode(F.sequence(there, F.col("_had") - 1)).alias("i")
        )
        gone = lost.select(schemas.code_chunk_id(F.col("repo"), F.col("path"), F.col("i") * step).alias("chunk_id"))
        rows = now.join(known, ["repo", "path"], "left")
        rows = rows.select("repo", "path", F.coalesce("n_chunks", "_had", F.lit(0)).alias("n_chunks"), "error")
        away = both.join(now.select("repo", "path"), ["repo", "path"], "left_anti").select("repo", "path")
        chunks = chunking.file_chunks(files.where("error IS NULL").select("repo", "path", "text"))
        self.put_all({"chunks": chunks, "files": rows}, {"chunks": gone, "files": away})
        self._fs.delete(self._at(folder), True)

    def failed_files(self, repo: str | None = None) -> DataFrame:
        """Files that couldn't be read, and why."""
        found = self.table("files").where("error IS NOT NULL")
        return found if repo is None else found.where(F.col("repo") == repo)

    # repositories

    def register(self, repo: str, name: str | None = None, **about: str | None) -> str:
        """Insert a repository, or update all but its id and time of indexing."""
        columns = ["version", "branch", "commit_hash", "metadata", "embedding_model"]
        new = self.spark.createDataFrame(
            [(repo, name or repo, *[about.get(c) for c in columns])],
            ", ".join(f"{c} string" for c in ["id", "name", *columns]),
        )
        old = self.table("repositories")
        known = old.select("id", F.col("indexed_at").alias("_at"))
        row = new.join(known, "id", "left").withColumn(
            "indexed_at", F.coalesce("_at", F.current_timestamp())
        ).select(*old.columns)
        self.write("repositories", keep_last(old, row, ["id"]))
        return repo

    def repository(self, repo: str) -> dict | None:
        found = self.table("repositories").where(F.col("id") == repo).limit(1).collect()
        return found[0].asDict() if found else None

    def repositories(self) -> DataFrame:
        return self.table("repositories").orderBy(F.desc("indexed_at"), "id")

    def status(self, repo: str) -> dict:
        tables = {n: self.table(n) for n in ("nodes", "edges", "chunks", "embeddings")}
        found = status_counts(tables, repo).collect()
        return found[0].asDict() if found else {
            "repo": repo, "nodes": 0, "edges": 0, "chunks": 0, "embeddings": 0, "status": "pending"
        }

    def is_indexed(self, repo: str) -> bool:
        return self.status(repo)["status"] == "completed"

    def delete_repository(self, repo: str) -> None:
        """Take a repository out of all tables at once; only buckets that hold rows of it are written anew."""
        number, there = self._manifest()
        before = {n: self._parts(there, n) for n in schemas.TABLES if n in there}
        after, changes = without_repo(before, repo), {}
        for name, rows in after.items():
            if rows is before[name]:
                continue
            n, keys = there[name]["buckets"], self._keys(name)
            gone = before[name].join(rows.select(*keys), keys, "left_anti").select(self._bucket(name, n)).distinct()
            touched = {r[0] for r in gone.collect()}
            if touched:
                left = without_repo({name: self._parts(there, name, touched)}, repo)[name]
                changes[name] = Change(there[name]["schema"], self._lay(name, left, n), touched)
        if changes:
            self._commit(number, there, self._finish(there, changes))

    def clear(self, everything: bool = False) -> None:
        """Empty nodes, edges, chunks and files; with `everything`, also embeddings, repositories and references."""
        names = [
            n for n in (
                "nodes",
                "edges",
                "chunks",
                "files",
                *(("embeddings", "repositories", "cross_references") if everything else ()),
            ) if self.has(n)
        ]
        self.write_all({n: self.spark.createDataFrame([], schemas.TABLES[n]) for n in names})

    # migrations

    def version(self) -> int:
        return self.table("schema_version").agg(F.coalesce(F.max("version"), F.lit(0))).first()[0]

    def applied(self) -> DataFrame:
        return self.table("schema_version").orderBy("version")

    def _apply(self, change: Callable[[dict[str, DataFrame]], dict[str, DataFrame]]) -> None:
        before = {
            n: t for n, t in self.tables().items() if n != "schema_version"
        } or {n: self.table(n) for n in ("nodes", "edges", "chunks")}
        after = change(before)
        self.write_all(after, [n for n in before if n not in after])

    def migrate(self) -> list[int]:
        """Apply what is pending, in ascending order."""
        done = []
        for m in sorted(self.migrations, key=lambda m: m.version):
            if m.version > self.version():
                try:
                    self._apply(m.up)
                except Exception as e:
                    raise errors.StoreSchemaError(
                        f"migration {m.version} ({m.name}) failed", context={"version": m.version}
                    ) from e
                row = self.spark.createDataFrame(
                    [(m.version, m.name)], "version int, name string"
                ).withColumn("applied_at", F.current_timestamp())
                self.write("schema_version", keep_last(self.table("schema_version"), row, ["version"]))
                done.append(m.version)
        return done

    def rollback_to(self, version: int) -> list[int]:
        """Undo migrations above a version, in descending order."""
        undone = []
        for m in sorted(self.migrations, key=lambda m: -m.version):
            if version < m.version <= self.version():
                self._apply(m.down)
                self.write("schema_version", self.table("schema_version").where(F.col("version") != m.version))
                undone.append(m.version)
        return undone

    # memo

    def load_or_run(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A named result: read if it is there whole, else made and kept."""
        path = f"{self.path}/_memo/{name}"
        if not self._fs.exists(self._at(f"{path}/_SUCCESS")):
            make().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)
