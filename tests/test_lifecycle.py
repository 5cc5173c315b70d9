import pytest
from pyspark.sql import functions as F

from tessera.api import KnowledgeBase, query_request
from tessera.functions import embed
from tessera.operators import compact, eventlog, graph, metrics, mutate, shards
from tessera.policy import InvalidRequest, ShardingPolicy
from tessera.sources import files
from tessera.sources.store import BlobStore, SnapshotStore, VersionMismatch
from tessera.streaming import pipeline


def test_compare_and_swap(spark, tmp_path):
    store = BlobStore(spark, str(tmp_path))
    v = store.put_if("a/b.json", b"1", "")
    with pytest.raises(VersionMismatch):
        store.put_if("a/b.json", b"2", "")
    assert store.put_if("a/b.json", b"2", v) != v and store.get("a/b.json") == b"2"
    with pytest.raises(VersionMismatch):
        store.put_if("a/b.json", b"3", v)
    assert [k for k, _ in store.list("a")] == ["a/b.json"]


def test_an_unfinished_replacement_is_finished(spark, tmp_path):
    store = BlobStore(spark, str(tmp_path))
    v = store.put_if("x.json", b"1", "")
    store.create(f"x.json.{v}.next", b"2")  # its writer was lost before the move
    with pytest.raises(VersionMismatch):
        store.put_if("x.json", b"3", v)
    assert store.get("x.json") == b"2" and store.put_if("x.json", b"3", store.head("x.json"))
    assert [k for k, _ in store.list("")] == ["x.json"]


def test_publish_is_versioned(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path))
    one = spark.createDataFrame([("a",)], "id string")
    first = store.publish("kb", {"docs": one}, None)
    with pytest.raises(VersionMismatch):
        store.publish("kb", {"docs": one}, None)
    store.publish("kb", {"docs": one.union(one)}, first.version)
    assert store.read("kb", "docs", first).count() == 1 and store.read("kb", "docs").count() == 2
    assert len(store.collect_garbage("kb")) == 1 and store.read("kb", "docs").count() == 2
    store.drop("kb")
    assert store.current("kb") is None


@pytest.fixture(scope="module")
def kb(spark, tmp_path_factory):
    base = KnowledgeBase(spark, str(tmp_path_factory.mktemp("kb")), "demo", embed.local(64), ShardingPolicy(compaction_min_shards=2), rows_per_shard=2)
    rows = [("a", "Alice works at Acme with Bob"), ("b", "Bob likes bread and Berlin"), ("c", "Carol paints Copenhagen"), ("d", "Dave studies databases"), ("e", "Erin writes about engines")]
    base.upsert(spark.createDataFrame(rows, "id string, text string"), with_graph=True)
    return base


def test_search_modes(kb):
    assert kb.search("databases study").first().id == "d"
    hits = query_request(kb, {"query": "Alice", "search_mode": "graph", "k": 3})
    assert hits and {"score", "graph_score"} <= set(hits[0])
    assert "score" not in query_request(kb, {"query": "Alice", "k": 2})[0]
    assert kb.search("databases study", mode="adaptive", top_k=2).count() == 2
    with pytest.raises(InvalidRequest):
        kb.search("the of and")


def test_upsert_delete_compact(spark, kb):
    before = kb.status()["version"]
    kb.upsert(spark.createDataFrame([("d", "now about gardens"), ("d", "finally about oceans")], "id string, text string"))
    assert kb.search("oceans").first().content == "finally about oceans"
    kb.delete([" e "])
    assert "e" not in {r.id for r in kb.search("engines", top_k=10).collect()}
    assert kb.status()["version"] == before + 2
    listed = {r.shard_id: r for r in kb.store.read("demo", "shards").collect()}
    worn = [r for r in listed.values() if r.min_id <= "e" <= r.max_id]
    assert [r.tombstone_ratio for r in worn] == [1.0 / worn[0].vector_rows] and any(r.graph_available for r in listed.values())
    assert "e" in {r.id for r in kb.store.read("demo", "docs").collect()}  # a delete writes no documents anew
    assert kb.compact() in ("size tier", "deleted rows")
    assert {r.id for r in kb.search("anything else", top_k=10).collect()} == {"a", "b", "c", "d"}
    with pytest.raises(InvalidRequest):
        kb.delete([""])


def test_a_base_may_become_empty(spark, tmp_path):
    base = KnowledgeBase(spark, str(tmp_path), "gone", embed.local(16))
    base.upsert(spark.createDataFrame([("a", "something to find")], "id string, text string"))
    base.delete(["a"], hard=True)
    assert base.search("something").count() == 0 and base.status()["shards"] == 0
    base.upsert(spark.createDataFrame([("b", "another thing")], "id string, text string"))
    assert [r.id for r in base.search("thing").collect()] == ["b"]


def test_documents_are_embedded_once(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)
    inner = embed.local(16)

    def counting(texts):
        calls.add(len(texts))
        return inner(texts)

    base = KnowledgeBase(spark, str(tmp_path), "once", counting)
    base.upsert(spark.createDataFrame([(str(i), f"word{i} and more") for i in range(7)], "id string, text string"))
    assert calls.value == 7


def test_code_index_is_incremental(spark, tmp_path):
    tree = tmp_path / "tree"
    tree.mkdir()
    (tree / "main.go").write_text('package main\nfunc Alpha() string { return "alpha" }\n')
    (tree / "util.go").write_text('package main\nfunc Beta() string { return "beta" }\n')
    (tree / "empty.py").write_text("")
    (tree / ".env").write_text("KEY=1")
    base = KnowledgeBase(spark, str(tmp_path / "root"), "code", embed.local(32))
    first = base.index_code(str(tree), "repo")
    assert (first["scanned_files"], first["indexed_files"], first["chunks_indexed"], first["skipped_files"]) == (3, 3, 2, 1)
    version = base.status()["version"]
    second = base.index_code(str(tree), "repo")
    assert (second["indexed_files"], second["unchanged_files"], second["chunks_indexed"]) == (0, 3, 0) and base.status()["version"] == version
    (tree / "util.go").write_text('package main\nfunc Beta() string { return "changed" }\n')
    third = base.index_code(str(tree), "repo")
    assert (third["indexed_files"], third["unchanged_files"], third["chunks_deleted"], third["chunks_indexed"]) == (1, 2, 1, 1)
    hit = base.code_search("changed beta", 5, path="util.go", language="GO").collect()
    assert [(r.path, r.language, r.symbol, r.start_line) for r in hit] == [("util.go", "go", "Beta", 2)] and "changed" in hit[0].content
    assert [r.id for r in base.code_search("changed beta", 5, path="util.go", exact=True).collect()] == [hit[0].id]
    (tree / "main.go").unlink()
    fourth = base.index_code(str(tree), "repo")
    assert (fourth["deleted_files"], fourth["chunks_deleted"], fourth["indexed_files"]) == (1, 1, 0)
    assert base.code_status()["files"] == 2 and base.code_status()["chunks"] == 1
    assert {r.path for r in base.code_search("alpha").collect()} == {"util.go"}
    assert not base.store.blobs.list("code/staging")
    with pytest.raises(InvalidRequest):
        base.code_search("  ")


def test_sharding_does_not_change_top_k(spark):
    docs = spark.range(57).select(F.format_string("%03d", "id").alias("id"), F.array(F.sin("id"), F.cos("id")).cast("array<float>").alias("embedding"))
    for n in (1, 5, 100):
        placed = shards.assign(docs, n)
        assert placed.groupBy("shard_id").count().agg(F.max("count")).first()[0] <= n
        assert placed.count() == 57


def test_expand_counts_walks_and_drops_zero_weights(spark):
    edges = spark.createDataFrame([("a", "b", 1.0, "t", "c1"), ("b", "c", 0.0, "t", "c1"), ("b", "d", None, "t", "c1")], "src string, dst string, weight double, rel_type string, chunk_id string")
    start = spark.createDataFrame([("a", 1.0)], "node string, s double")
    got = {r.node: round(r.s, 6) for r in graph.expand(start, graph.neighbours(edges, 25), 2, 0.5).collect()}
    assert got == {"a": 1.25, "b": 0.5, "d": 0.25}


def test_upserts_are_idempotent(spark):
    docs = spark.createDataFrame([("a", "1"), ("b", "2")], "id string, content string")
    batch = spark.createDataFrame([("b", "3", 1), ("b", "4", 2)], "id string, content string, n int")
    once = mutate.upsert(docs, batch, "n")
    twice = mutate.upsert(once, batch, "n")
    assert sorted(once.collect()) == sorted(twice.collect()) == [("a", "1"), ("b", "4")]
    assert mutate.upsert(docs, batch.drop("n")).count() == 3


def test_event_machine(spark):
    rows = [("e1", "k", "pending", 0, 3, None), ("e2", "k", "claimed", 3, 3, "2024-01-01 00:00:00"), ("e3", "k", "claimed", 1, 3, "2099-01-01 00:00:00")]
    log = spark.createDataFrame(rows, "event_id string, kind string, status string, attempt int, max_attempts int, u string").select("*", F.col("u").cast("timestamp").alias("claimed_until"), F.lit("2024-01-01").cast("timestamp").alias("created_at")).drop("u")
    now = F.lit("2024-01-02").cast("timestamp")
    state = lambda df: {r.event_id: r.status for r in df.collect()}
    assert state(eventlog.requeued(log, now)) == {"e1": "pending", "e2": "pending", "e3": "pending"}
    failed = spark.createDataFrame([("e2", 3), ("e3", 7)], "event_id string, attempt int")
    assert state(eventlog.after_failure(log, failed)) == {"e1": "pending", "e2": "dead", "e3": "claimed"}
    claimed = eventlog.claim(log, "k", "w", now)
    assert state(claimed)["e1"] == "claimed" and claimed.where("event_id = 'e1'").first().attempt == 1
    assert state(eventlog.acknowledged(claimed, spark.createDataFrame([("e1",)], "event_id string")))["e1"] == "done"


def test_lineage_ends_on_a_cycle(spark):
    log = spark.createDataFrame([("a", "document.upsert", "b"), ("b", "kb.published", "a")], "event_id string, kind string, causation_id string")
    assert eventlog.lineage(log, log.where("event_id = 'a'"), 3).count() == 4


def test_compaction_plan(spark):
    rows = [(f"s{i}", 100 << 20 if i < 3 else 1 << 10, 0.5 if i == 0 else 0.0, 1) for i in range(5)]
    listed = spark.createDataFrame(rows, "shard_id string, size_bytes long, tombstone_ratio double, vector_rows long")
    chosen, why = compact.candidates(listed, ShardingPolicy(compaction_min_shards=2))
    assert why == "size tier" and [r.shard_id for r in chosen.collect()] == ["s0", "s1", "s2"]
    assert compact.candidates(listed, ShardingPolicy())[0] is None
    assert compact.replaced(["a", "b", "c", "d"], ["b", "d"], "n") == ["a", "n", "c"]


def test_open_metrics(spark):
    rows = spark.createDataFrame([('a"b', 2)], "kb string, n long")
    assert [r.line for r in metrics.open_metrics(rows, "hits", "kb", "n").collect()] == ["# TYPE hits counter", 'hits{kb="a\\"b"} 2']


def test_rate_limit_replays_each_key_in_order(spark):
    rows = [(k, i * 0.05 * (1 + (k or "z").count("a"))) for i in range(400) for k in ("a", "b", None)] + [("a", 500.0)]
    df = spark.createDataFrame(rows, "ip string, s double").select("ip", F.col("s").cast("timestamp").alias("ts"))
    got = {(r.ip, r.allowed): r.n for r in metrics.rate_limited(df, 10.0, 20.0).groupBy("ip", "allowed").agg(F.count("*").alias("n")).collect()}
    want = {}
    for key in ("a", "b", None):
        tokens, last = 20.0, None
        for s in sorted(s for k, s in rows if k == key):
            tokens = min(20.0, tokens + (0 if last is None else (s - last) * 10.0))
            last, ok = s, tokens >= 1
            tokens -= ok
            want[(key, ok)] = want.get((key, ok), 0) + 1
    assert got == want


def test_uploads_fail_one_by_one(spark):
    rows = [("a.txt", None, b" hello "), ("b.bin", "application/zip", b"x"), ("c.txt", "text/plain", b"  "), ("d.html", None, b"<p>x</p>")]
    got = {(r.name, r.status): r.text for r in files.pages(spark.createDataFrame(rows, "name string, content_type string, content binary")).collect()}
    assert got == {("a.txt", "succeeded"): "hello", ("b.bin", "failed"): None, ("c.txt", "failed"): None, ("d.html", "succeeded"): "x"}


def test_source_tree(spark, tmp_path):
    for name, data in {"src/a.go": b"package a", ".env": b"K=1", "node_modules/x.js": b"1", "bin.dat": b"\x00\x01", "README.md": b"# hi", "pkg/__init__.py": b"", "_a b+c%20.py": b"x = 1", ".ci/run.yml": b"a: 1"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r.path: r.language for r in files.source_tree(spark, str(tmp_path)).collect()}
    assert got == {"src/a.go": "go", "README.md": "markdown", "pkg/__init__.py": "python", "_a b+c%20.py": "python", ".ci/run.yml": "yaml"}
    assert files.source_tree(spark, f"file://{tmp_path}/", include=["*.go"]).select("path", "text").collect() == [("src/a.go", "package a")]


def test_corpus_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([("1", "é\n\"x\""), ("2", "")], "id string, text string")
    files.write_corpus(docs, str(tmp_path / "c"))
    assert [tuple(r) for r in files.read_corpus(spark, str(tmp_path / "c")).collect()] == [("1", "é\n\"x\"")]


def test_streamed_ingest_replays_to_the_same_table(spark, tmp_path):
    docs = spark.createDataFrame([(str(i), f"document number {i} about topic{i}") for i in range(20)], "id string, text string")
    docs.write.parquet(str(tmp_path / "in"))
    store = SnapshotStore(spark, str(tmp_path / "root"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    pipeline.ingest(stream, store, "kb", str(tmp_path / "check"), embedder=embed.local(16))
    first = sorted(r.id for r in store.read("kb", "docs").collect())
    pipeline.publisher(store, "kb")(pipeline.embedded(pipeline.chunked(docs), embed.local(16)), 0)
    assert sorted(r.id for r in store.read("kb", "docs").collect()) == first and len(first) == 20
    assert store.current("kb").version == 1


def test_the_last_of_equal_ids_of_a_micro_batch_wins(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path))
    rows = spark.createDataFrame([("a", "old", [1.0]), ("b", "x", [2.0]), ("a", "new", [3.0]), ("c", "none", None)], "id string, content string, embedding array<float>").coalesce(1)
    pipeline.publisher(store, "kb")(rows, 0)
    assert {r.id: r.content for r in store.read("kb", "docs").collect()} == {"a": "new", "b": "x"}
    assert not store.blobs.list("kb/staging")


def test_stateful_retries(spark, tmp_path):
    rows = [("a", False), ("a", False), ("a", False), ("b", False), ("b", True)]
    spark.createDataFrame(rows, "event_id string, ok boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    got = {}

    def keep(batch, _):
        got.update({r.event_id: (r.attempt, r.status) for r in batch.collect()})

    stream = spark.readStream.schema("event_id string, ok boolean").parquet(str(tmp_path / "in"))
    pipeline.retry_states(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert got == {"a": (3, "dead"), "b": (2, "done")}
