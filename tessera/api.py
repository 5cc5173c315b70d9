"""The library surface: a knowledge base over a snapshot store."""

from __future__ import annotations

import contextlib
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import code, embed, text
from .operators import codeindex, compact, graph, graphbuild, mutate, search, shards
from .plans import planner
from .policy import Expansion, InvalidRequest, SearchOptions, ShardingPolicy, parse_mode, validate_query, with_retry
from .sources import files
from .sources.store import SHARDS, NotFound, Snapshot, SnapshotStore, VersionMismatch


class _NothingToDo(Exception):
    """A change that finds nothing to change."""


class KnowledgeBase:
    """Documents, their graph and their search, as versioned tables under one root.

    Every write reads the current version, writes new tables and publishes them if the version still stands; a
    conflict is retried on the newer version.
    """

    def __init__(self, spark: SparkSession, root: str, kb_id: str, embedder: embed.Embedder | None = None, policy: ShardingPolicy | None = None, grapher: graphbuild.Grapher | None = None, attempts: int = 5, rows_per_shard: int | None = None):
        self.spark, self.kb_id, self.store = spark, kb_id, SnapshotStore(spark, root)
        self.embedder, self.grapher, self.policy, self.attempts = embedder or embed.local(), grapher, policy or ShardingPolicy(), attempts
        self.rows_per_shard = rows_per_shard or self.policy.max_rows_per_shard

    CODE = {
        "code_files": "path string, hash string, language string, size_bytes long, chunk_ids array<string>",
        "code_chunks": "id string, path string, hash string, language string, symbol string, kind string, start_line int, end_line int",
    }

    def _table(self, name: str, schema: str, now: Snapshot | None) -> DataFrame:
        if now is None or name not in now.manifest["tables"]:
            return self.spark.createDataFrame([], schema)
        return self.store.read(self.kb_id, name, now).drop("shard_id")

    DOCS = "id string, content string, embedding array<float>, media_refs string"
    TABLES = {
        "doc_tombstones": "doc_id string, deleted_at timestamp",
        "entities": "id string, name string",
        "edges": "src string, dst string, weight double, rel_type string, chunk_id string",
        "doc_entities": "doc_id string, entity_id string, weight double, chunk_id string",
    }

    def _now(self) -> Snapshot:
        now = self.store.current(self.kb_id)
        if now is None:
            raise NotFound(self.kb_id)
        return now

    def _publish(self, change) -> Snapshot:
        """Publish what ``change`` makes of the current version, with the table of shards that goes with it.

        Rewritten documents leave deleted rows behind and are dealt anew to shards.  Where only tombstones or mappings
        change, documents stay as they are and the shards' shares of deleted rows follow.
        """

        def once() -> Snapshot:
            now = self.store.current(self.kb_id)
            tables = change(now)
            names = set(tables) | set(now.manifest["tables"] if now else ())
            given = lambda read: [read(t) if t in names else None for t in ("doc_tombstones", "doc_entities")]
            if "docs" in tables:
                dead = tables.get("doc_tombstones", self._table("doc_tombstones", self.TABLES["doc_tombstones"], now))
                if "shard_id" not in tables["docs"].columns:
                    tables["docs"] = shards.assign(mutate.active(tables["docs"], dead), self.rows_per_shard)
                tables[SHARDS] = lambda read: shards.metadata(read("docs"), *given(read))
            elif SHARDS in names and "docs" in names:
                tables[SHARDS] = lambda read: read(SHARDS).drop("tombstone_ratio", "graph_available").join(shards.health(read("docs"), *given(read)), "shard_id")
            return self.store.publish(self.kb_id, tables, now.version if now else None)

        return with_retry(once, self.attempts, (VersionMismatch,))

    def _active(self, now: Snapshot) -> DataFrame:
        """The documents that are not deleted, by shard."""
        return mutate.active(self.store.read(self.kb_id, "docs", now), self._table("doc_tombstones", self.TABLES["doc_tombstones"], now))

    def embed(self, value: str) -> list[float]:
        got = self.embedder([value])[0]
        if got is None:
            raise InvalidRequest("the text has no indexable words")
        return [float(x) for x in got]

    def upsert(self, documents: DataFrame, with_graph: bool = False) -> Snapshot:
        """Documents (``id, text[, media_refs]``), embedded whole; with their graph if asked."""
        refs = F.col("media_refs") if "media_refs" in documents.columns else F.lit(None).cast("string")
        made = embed.embedded(documents.select("id", F.col("text").alias("content"), refs.alias("media_refs")), self.embedder)
        rows, key = self.store.staged(self.kb_id, made.withColumn("__order", F.monotonically_increasing_id()))  # embeds each document once
        try:
            if (bad := rows.where("embedding is null").select("id").first()) is not None:
                raise InvalidRequest(f"document {bad['id']} has no indexable words")
            return self.upsert_embedded(rows.drop("embed_error"), documents if with_graph else None)
        finally:
            self.store.blobs.delete(key)

    def upsert_embedded(self, rows: DataFrame, graph_documents: DataFrame | None = None) -> Snapshot:
        """Rows of ``docs`` that are embedded already; of equal ids the last by ``__order``, or by position, wins."""
        if "__order" not in rows.columns:
            rows = rows.withColumn("__order", F.monotonically_increasing_id())

        def change(now: Snapshot | None) -> dict[str, DataFrame]:
            docs, dead = self._table("docs", self.DOCS, now), self._table("doc_tombstones", self.TABLES["doc_tombstones"], now)
            out = {"docs": mutate.upsert(docs, rows, "__order").select("id", "content", "embedding", "media_refs"), "doc_tombstones": mutate.clear_tombstones(dead, rows)}
            if graph_documents is not None:
                cut = text.chunks(graph_documents)
                found = graphbuild.extract(cut, self.grapher or graphbuild.capitalised)
                links, mapped = graphbuild.edges(found), graphbuild.mappings(found)
                new = (graphbuild.doc_entities(cut.select("chunk_id", "doc_id"), mapped, links), links, graphbuild.entities(found))
                old = tuple(self._table(t, self.TABLES[t], now) for t in ("doc_entities", "edges", "entities"))
                out["doc_entities"], out["edges"], out["entities"] = mutate.refresh_graph(old, new, graph_documents.select("id"))
            return out

        return self._publish(change)

    def delete(self, ids: list[str], hard: bool = False, now_value=None) -> Snapshot:
        """Delete documents: by tombstone, or for good with the graph that only they hold up."""
        names = self.spark.createDataFrame([(i,) for i in mutate.checked_ids(ids)], "id string")

        def change(now: Snapshot | None) -> dict[str, DataFrame]:
            if now is None:
                raise NotFound(self.kb_id)
            docs, dead, mapped, links, named = (self._table(t, s, now) for t, s in [("docs", self.DOCS), *((t, self.TABLES[t]) for t in ("doc_tombstones", "doc_entities", "edges", "entities"))])
            if hard:
                docs, dead = mutate.hard_delete(docs, dead, names)
                mapped, links, named = mutate.prune_graph(mapped, links, named, names)
                return {"docs": docs, "doc_tombstones": dead, "doc_entities": mapped, "edges": links, "entities": named}
            dead, mapped = mutate.soft_delete(dead, mapped, names, now_value or F.current_timestamp())
            return {"doc_tombstones": dead, "doc_entities": mapped}

        return self._publish(change)

    def index_code(self, root: str, repo: str = "", include: list[str] | None = None, exclude: list[str] | None = None) -> dict:
        """Index the source files below ``root``; returns the tallies of the scan.

        Only new and changed files are cut and embedded, each chunk once.  A scan that finds no difference publishes
        nothing.  Chunks without a word to embed are left out and counted.
        """
        scan = lambda only=None: files.source_tree(self.spark, root, include, exclude, only)
        found, listing = self.store.staged(self.kb_id, scan().drop("text"))
        made, counts = [listing], {}

        def lists(now: Snapshot | None) -> tuple[DataFrame, DataFrame, DataFrame]:
            old, chunks = (self._table(t, s, now) for t, s in self.CODE.items())
            return old, chunks, codeindex.diff(old, found)

        def tallied(now: Snapshot | None) -> dict:
            old, _, changes = lists(now)
            n, gone = codeindex.tally(changes).first(), codeindex.stale_chunks(old, changes).count()
            return {"indexed_files": n["new"] + n["changed"], "unchanged_files": n["unchanged"], "deleted_files": n["deleted"], "chunks_deleted": gone, "chunks_indexed": 0, "chunks_without_words": 0}

        def change(now: Snapshot | None) -> dict[str, DataFrame]:
            counts.update(tallied(now))
            old, chunks, changes = lists(now)
            touched = scan(changes.where(F.col("change").isin("new", "changed")))
            rows, key = self.store.staged(self.kb_id, embed.embedded(code.chunked(touched, repo).dropDuplicates(["id"]), self.embedder))
            made.append(key)
            fresh = rows.where("embedding is not null")
            counts["chunks_indexed"], counts["chunks_without_words"] = fresh.count(), rows.where("embedding is null").count()
            docs, dead = self._table("docs", self.DOCS, now), self._table("doc_tombstones", self.TABLES["doc_tombstones"], now)
            left = docs.join(codeindex.stale_chunks(old, changes), "id", "left_anti")
            new = fresh.select("id", "content", "embedding", F.lit(None).cast("string").alias("media_refs"))
            out = {"docs": mutate.upsert(left, new).select("id", "content", "embedding", "media_refs"), "doc_tombstones": mutate.clear_tombstones(dead, new)}
            out["code_files"], out["code_chunks"] = codeindex.refreshed(old, chunks, found, changes, fresh)
            return out

        try:
            now = self.store.current(self.kb_id)
            counts.update(tallied(now))
            if counts["indexed_files"] or counts["deleted_files"]:
                self._publish(change)
            scanned = counts["indexed_files"] + counts["unchanged_files"]
            return {"scanned_files": scanned, "skipped_files": files.listed(self.spark, root).count() - scanned, **counts}
        finally:
            for key in made:
                self.store.blobs.delete(key)

    def code_status(self) -> dict:
        """Files, chunks and bytes of the code index."""
        return codeindex.status(self._table("code_files", self.CODE["code_files"], self._now())).first().asDict()

    def code_search(self, query: str | list[float], top_k: int = 10, path: str | None = None, language: str | None = None, exact: bool = False) -> DataFrame:
        """Nearest code chunks whose path holds ``path`` and whose language is ``language``, with their lines and symbol.

        The planned search's nearest ``max(200, 20 top_k)`` are filtered; ``exact`` filters all chunks first.
        """
        if isinstance(query, str) and not query.strip():
            raise InvalidRequest("query must not be empty")
        k, now = top_k if top_k > 0 else 10, self._now()
        vector, chunks = self.embed(query) if isinstance(query, str) else query, self._table("code_chunks", self.CODE["code_chunks"], now)
        docs = self._active(now)
        if exact:
            hits = search.code_search(docs, chunks, vector, k, path, language, exact=True)
            return hits.join(docs.select("id", "content"), "id").orderBy("distance", "id")
        hits = planner.vector_search(docs, self.store.read(self.kb_id, SHARDS, now), vector, search.code_fanout(k), self.policy)
        return search.code_hits(hits.select("id", "content", "distance"), chunks, k, path, language)

    def search(self, query: str | list[float], options: SearchOptions | None = None, **changes) -> DataFrame:
        """``id, content, distance, graph_score, score``, best first."""
        o = replace(options or SearchOptions(), **changes).normalised()
        vector = self.embed(query) if isinstance(query, str) else query
        now = self._now()
        docs, listed = self._active(now), self.store.read(self.kb_id, SHARDS, now)
        known = listed.where(F.size("centroid") > 0).select(F.size("centroid").alias("n")).first()
        validate_query(vector, known["n"] if known else None)
        if o.mode == "vector":
            return planner.vector_search(docs, listed, vector, o.top_k, self.policy, o.max_distance)
        tables = {t: self._table(t, s, now) for t, s in self.TABLES.items()}
        hits = graph.run(docs, tables["doc_entities"], tables["edges"], vector, o)
        return hits.join(docs.select("id", "content"), "id").orderBy(F.desc("score"), "distance", "id")

    def compact(self) -> str:
        """Merge small or worn shards if there is debt, leaving their deleted rows behind; says why or why not."""
        why = ["not initialised"]

        def change(now: Snapshot | None) -> dict[str, DataFrame]:
            chosen, why[0] = compact.candidates(self.store.read(self.kb_id, SHARDS, now), self.policy)
            if chosen is None:
                raise _NothingToDo
            gone = [r["shard_id"] for r in chosen.select("shard_id").collect()]  # a few: the limit of a merge
            return {"docs": self._active(now).withColumn("shard_id", F.when(F.col("shard_id").isin(gone), min(gone)).otherwise(F.col("shard_id")))}

        if self.store.current(self.kb_id) is not None:
            with contextlib.suppress(_NothingToDo):
                self._publish(change)
        return why[0]

    def status(self) -> dict:
        now = self.store.current(self.kb_id)
        held = now is not None and SHARDS in now.manifest["tables"]
        return {"version": now.version if now else 0, "shards": self.store.read(self.kb_id, SHARDS, now).count() if held else 0, "bytes": now.manifest["total_size_bytes"] if now else 0}

    def drop(self) -> None:
        self.store.drop(self.kb_id)


def query_request(kb: KnowledgeBase, body: dict) -> list[dict]:
    """A query as a request body: ``{"query", "k", "search_mode", "max_distance", "expansion"}``; scores appear unless the mode is vector."""
    mode = parse_mode(body.get("search_mode"))
    if not str(body.get("query", "")).strip():
        raise InvalidRequest("query must not be empty")
    expansion = Expansion(**body.get("expansion", {}))
    hits = kb.search(body["query"], SearchOptions(mode, int(body.get("k", 10)), body.get("max_distance"), expansion)).collect()
    columns = ["id", "content", "distance"] + ([] if mode == "vector" else ["score", "graph_score"])
    return [{c: h[c] for c in columns} for h in hits]


__all__ = ["KnowledgeBase", "query_request", "search", "SearchOptions", "Expansion", "ShardingPolicy"]
