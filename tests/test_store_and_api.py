import pytest
from pyspark.sql import functions as F

from lodestone import api, errors
from lodestone.operators import embeddings, graph
from lodestone.plans import ingest
from lodestone.sources import files
from lodestone.sources.store import Store
from lodestone.streaming import ingest as stream

SAID = "Entities:\nauth\nuser\nRelationships:\nauth -> uses -> user [strength: 0.9]"


@pytest.fixture()
def store(spark, tmp_path):
    return Store(spark, f"file://{tmp_path}/store")


def test_writes_follow_each_table_rule(spark, store):
    store.put(
        "nodes",
        spark.createDataFrame(
            [("a", "r", "1"), ("a", "r", "2")], "id string, repo string, properties string"
        ).coalesce(1),
    )
    store.put(
        "nodes", spark.createDataFrame([("a", "r", "3"), ("b", "r", "4")], "id string, repo string, properties string")
    )
    assert {(r["id"], r["properties"]) for r in store.nodes().collect()} == {("a", "1"), ("b", "4")}
    edge = "source string, target string, relationship string, weight double, source_repo string, target_repo string"
    store.put("edges", spark.createDataFrame([("a", "b", "x", 0.1, "r", "r")], edge))
    store.put("edges", spark.createDataFrame([("a", "b", "x", 0.2, "r", "r")], edge))
    assert [r["weight"] for r in store.edges().collect()] == [0.2]


def test_migrations_and_repositories(spark, store):
    assert store.version() == 0 and store.migrate() == [1] and store.migrate() == [] and store.version() == 1
    assert store.repository("default")["name"] == "default"
    store.register("one", version="1")
    at = store.repository("one")["indexed_at"]
    store.register("one", version="2")
    assert store.repository("one")["version"] == "2" and store.repository("one")["indexed_at"] == at
    assert store.rollback_to(0) == [1] and not store.has("repositories")


def test_empty_path():
    with pytest.raises(errors.StoreConnectionError):
        Store(None, "")


def test_scan_prunes_folders(spark, tmp_path):
    for p in ("src/a.ts", "node_modules/x.ts", "tests/t.ts", "README.md", "b.py", "sub/build/c.js"):
        (tmp_path / "tests" / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "tests" / p).write_text("text " + p)
    found = files.scan_files(spark, f"file://{tmp_path}/tests")
    assert {r["path"] for r in found.collect()} == {"src/a.ts", "README.md"}


def test_index_search_delete(spark, store, tmp_path):
    (tmp_path / "repo").mkdir()
    (tmp_path / "repo/auth.ts").write_text("export class AuthModule { session user }\n" * 30)
    (tmp_path / "repo/note.md").write_text("# Auth\n\nuser authentication session\n")
    provider = embeddings.create_provider("hashing")
    model = lambda system, prompt: SAID
    result = ingest.index_repository(store, "r", f"file://{tmp_path}/repo", model=model, provider=provider)
    assert (result.nodes, result.edges, result.embeddings, result.errors) == (2, 1, 3, []) and result.chunks > 2
    again = ingest.index_repository(store, "r", f"file://{tmp_path}/repo", model=model, provider=provider)
    assert again == result
    engine = api.Engine(store, provider=provider)
    text = engine.query_repositories("user authentication session", attendant=api.NONE)
    assert text.startswith("# user authentication session") and "Weights: " in text and "## Results: " in text
    assert "Tokens:" in engine.smart_query("user authentication session")
    assert "auth" in engine.query_dependency("auth")
    assert engine.get_cross_references("auth").startswith("No reference")
    assert engine.call("query_dependency", {"dependency": "a", "aspect": "odd"})["is_error"]
    with pytest.raises(errors.ToolError):
        engine.call("nothing", {})
    assert "**r**" in engine.list_repositories() and engine.resources()[0]["uri"] == "lodestone://repo/r"
    assert '"id": "r"' in engine.read_resource("lodestone://repo/r")
    assert engine.ask("q", lambda s, p: p).count(" edges") == 3
    assert '"links"' in graph.export_text(store.nodes(), store.edges())
    graph.export(store.nodes(), store.edges(), f"file://{tmp_path}/out")
    assert spark.read.json(f"file://{tmp_path}/out/links").count() == 1
    with pytest.raises(ValueError, match="more than 1"):
        graph.export_text(store.nodes(), store.edges(), most=1)
    assert store.trigrams().count() > 0 and store.postings().count() > 0
    store.delete_repository("r")
    assert store.status("r")["status"] == "pending" and store.nodes().isEmpty()


def test_markdown_ingest_and_failing_model(store):
    def broken(system, prompt):
        raise RuntimeError("no model")

    result = ingest.index_markdown(store, "docs", "# T\n\nsome words", source="s", model=broken)
    assert result.chunks == 1 and result.errors
    row = store.chunks().first()
    assert row["chunk_id"].startswith("md-") and row["chunk_type"] == "documentation"
    store.clear()
    assert store.chunks().isEmpty() and store.repository("docs") is not None
    store.clear(everything=True)
    assert store.repository("docs") is None


def test_memo_and_stream(spark, store, tmp_path):
    made = []
    make = lambda: made.append(1) or spark.range(3)
    assert store.load_or_run("x", make).count() == 3 == store.load_or_run("x", make).count() and made == [1]
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.txt").write_text("b" * 700)
    for _ in range(2):
        stream.ingest(
            stream.file_stream(spark, f"file://{folder}", "r"), store, f"file://{tmp_path}/cp", once=True
        ).awaitTermination()
    assert store.chunks().count() == 2


def test_stream_keeps_folders_apart_and_drops_what_a_file_has_lost(spark, store, tmp_path):
    folder = tmp_path / "in"
    for d in ("a", "b"):
        (folder / d).mkdir(parents=True)
        (folder / d / "f.txt").write_text(d * 1200)
    (folder / "bad.txt").write_bytes(b"\xff\xfe\x00")
    run = lambda: stream.ingest(stream.file_stream(spark, f"file://{folder}", "r"), store, f"file://{tmp_path}/cp", once=True).awaitTermination()
    run()
    assert store.chunks().count() == 6 and [
        (r["path"], r["error"]) for r in store.failed_files().collect()
    ] == [("bad.txt", "not valid UTF-8")]
    (folder / "a" / "f2.txt").write_text("c")
    run()
    assert {
        (r["path"], r["n_chunks"]) for r in store.table("files").collect()
    } == {("a/f.txt", 3), ("b/f.txt", 3), ("a/f2.txt", 1), ("bad.txt", 0)}
    short = spark.createDataFrame(
        [("r", "a/f.txt", "x" * 10, None), ("r", "b/f.txt", None, "gone bad")],
        "repo string, path string, text string, error string",
    )
    store.put_files(short)
    assert store.chunks().count() == 5 and store.table("files").where("path = 'b/f.txt'").first()["n_chunks"] == 3
    assert store.postings().select("chunk_id").distinct().count() == store.posting_stats().first()["n_chunks"] == 5


def test_update_forgets_shrunk_and_removed_files(spark, store, tmp_path):
    (tmp_path / "repo").mkdir()
    (tmp_path / "repo/a.ts").write_text("word " * 400)
    (tmp_path / "repo/b.ts").write_text("other " * 10)
    assert ingest.index_repository(store, "r", f"file://{tmp_path}/repo").chunks == 5
    (tmp_path / "repo/a.ts").write_text("word")
    (tmp_path / "repo/b.ts").unlink()
    (tmp_path / "repo/c.ts").write_bytes(b"a\xff")
    (tmp_path / "repo/d.ts").write_text("new")
    result = ingest.update_repository(store, "r", f"file://{tmp_path}/repo")
    assert sorted(
        r["content"] for r in store.chunks().collect()
    ) == ["new", "word"] and result.errors == ["c.ts: not valid UTF-8"]
    assert {r["path"] for r in store.table("files").collect()} == {"a.ts", "c.ts", "d.ts"}


def test_a_write_reads_and_replaces_only_its_buckets(spark, store):
    kind = "id string, repo string, properties string"
    store.put("nodes", spark.createDataFrame([(f"n{i}", "r", "1") for i in range(200)], kind))
    before = store._manifest()[1]["nodes"]["parts"]
    store.put("nodes", spark.createDataFrame([("new", "r", "1"), ("n5", "r", "2")], kind))
    after = store._manifest()[1]["nodes"]["parts"]
    assert len(before) == 8 and sum(before[b] != after[b] for b in before) <= 2
    assert store.nodes().count() == 201 and store.nodes().where("id = 'n5'").first()["properties"] == "1"


def test_two_writers_and_whole_commits(spark, store):
    kind = "id string, repo string, properties string"
    rows = spark.createDataFrame([("a", "r", "1")], kind)
    store.put("nodes", rows)
    number, there = store._manifest()
    store.put("nodes", spark.createDataFrame([("b", "r", "1")], kind))
    with pytest.raises(errors.StoreConnectionError):
        store._commit(number, there, {})
    for i in range(4):
        store.put("nodes", spark.createDataFrame([(f"c{i}", "r", "1")], kind))
    assert len(store._numbers()) == 2 and store.nodes().count() == 6


def test_named_files_keep_folders_order_and_repeats(spark, tmp_path):
    for p in ("a/x.ts", "b/x.ts", "y.ts"):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text("text " + p)
    names = ["b/x.ts", "y.ts", "a/x.ts", "b/x.ts"]
    got = files.read_documents(spark, names, f"file://{tmp_path}").collect()
    assert [(r["nth"], r["name"], r["text"]) for r in got] == [(i, n, "text " + n) for i, n in enumerate(names)]


def test_failures_of_plug_ins_cost_what_they_touch(spark, store):
    class Broken:
        dimension = 2

        def embed_batch(self, texts):
            if any("bad" in t for t in texts):
                raise RuntimeError("429")
            return [[1.0, 0.0] for _ in texts]

    def model(system, prompt):
        if "bad" in prompt:
            raise RuntimeError("429")
        return SAID

    store.put(
        "nodes",
        spark.createDataFrame(
            [("good", "docs", "{}"), ("bad", "docs", "{}")], "id string, repo string, properties string"
        ),
    )
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        result = ingest.index_markdown(store, "docs", "# T\n\n" + "good words " * 200 + "\n\n# U\n\n" + "bad words " * 200, model=model, provider=Broken())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert result.nodes == 4 and result.errors[0] == "extraction: RuntimeError: 429" and result.errors[1].startswith(
        "embeddings: 1 rows"
    )
    assert {
        r["entity_id"] for r in store.table("embeddings").where("chunk_type = 'entity'").collect()
    } == {"good", "auth", "user"}


def test_any_failure_of_the_model_leaves_the_heuristic():
    from lodestone.plans import analysis

    def broken(system, prompt):
        raise RuntimeError("429")

    assert analysis.analyze("what uses x", model=broken).query_type == "relationship"
    assert analysis.analyze(
        "what uses x", model=lambda s, p: '{"query_type": "odd", "weights": {}}'
    ).query_type == "relationship"


def test_attendant_choice():
    config = api.Config()
    assert api.select_attendant("simple", [], 10, config, True) == api.LOCAL
    assert api.select_attendant("how do I x", [], 10, config, True) == api.ESCALATED
    assert api.select_attendant("x", list("abcd"), 10, config, True) == api.ESCALATED
    assert api.select_attendant("x", list("abcd"), 9999, config, False) == api.LOCAL
    assert api.select_attendant(
        "x", [], 0, api.Config(auto_escalate=False, default_attendant=api.NONE), True
    ) == api.NONE


def test_errors():
    assert errors.recovery(errors.ModelAPIError("x", context={"status_code": 429})).backoff_ms == (1000, 5000, 15000)
    assert errors.recovery(errors.QueryTimeoutError("x")).max_retries == 2
    assert errors.recovery(ValueError()).can_retry is False
    assert errors.wrap(ValueError("x"), "c").to_dict()["context"] == {"context": "c"}


def test_tags_are_stripped(spark):
    rows = spark.createDataFrame([("<p>a &amp; b</p><script>x()</script><!-- c -->",), (None,)], "html string")
    assert [r[0] for r in rows.select(files.strip_tags("html")).collect()] == ["a & b", None]
    assert rows.select(F.lit(1)).count() == 2


def test_totals_are_counted_before_heads_are_cut():
    found = api.Combined(
        graph=[{"id": f"n{i}", "repo": "r", "properties": "{}"} for i in range(50)], totals={"graph": 1234}
    )
    assert "## Entities: 1234, the first 10" in api.render_raw("q", found) and "## Entities: 1234, the first 10" in api.Attendant().sections(found)[1]
    assert "Nothing found" in api.render_raw("q", api.Combined())


def test_engine_counts_and_uses_the_index(spark, store):
    kind = "id string, repo string, properties string"
    store.put("nodes", spark.createDataFrame([(f"node{i:03d}", "r", "{}") for i in range(120)], kind))
    chunk = "chunk_id string, repo string, entity_id string, chunk_type string, content string, metadata string"
    store.put(
        "chunks",
        spark.createDataFrame(
            [(f"c{i}", "r", None, "code", f"word{i % 7} running things", None) for i in range(40)], chunk
        ),
    )
    engine = api.Engine(store)
    assert "## Entities: 120, the first 10" in engine.query_dependency("node", aspect="usage")
    assert engine.tables.index is not None and engine.tables.stats.first()["n_chunks"] == 40
    got = engine.search.search(
        "word3 runs", force_weights={"dense": 0.0, "sparse": 1.0, "pattern": 0.0, "graph": 0.0}
    ).results
    assert {r["content"] for r in got.collect()} == {"word3 running things"}


def test_chat_model_over_http(monkeypatch):
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from lodestone.plans import models

    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append(json.loads(self.rfile.read(int(self.headers["Content-Length"]))))
            self.send_response(429 if len(seen) == 1 else 400 if len(seen) == 3 else 200)
            self.end_headers()
            self.wfile.write(json.dumps({"choices": [{"message": {"content": "said"}}]}).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    monkeypatch.setenv("OPENAI_API_KEY", "k")
    monkeypatch.setenv("OPENAI_BASE_URL", f"http://127.0.0.1:{server.server_port}/v1")
    monkeypatch.setattr(models.time, "sleep", lambda s: None)
    model = api.create_model("openai")
    assert model("sys", "prompt") == "said" and len(seen) == 2 and seen[1]["messages"][1]["content"] == "prompt"
    with pytest.raises(errors.ModelAPIError):
        model("sys", "prompt")
    server.shutdown()
    monkeypatch.delenv("OPENAI_API_KEY")
    with pytest.raises(errors.ConfigurationError):
        api.create_model("openai")
