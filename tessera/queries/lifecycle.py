"""Mutations, compaction, garbage, files, media, cache."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from ..functions import strings as S
from ..operators import codeindex, compact, media, mutate, shards
from .fixtures import Tables, with_tables

NOW = "TIMESTAMP '2024-01-20 00:00:00'"


def _narrow(t: Tables):
    return t("docs").select("id", F.md5("content").alias("content"))


def _batch(t: Tables):
    rows = t("docs").where("vec_id % 3 = 0").select("id", F.concat(F.lit("new "), F.col("label").cast("string")).alias("content"), "vec_id")
    again = rows.where("vec_id % 6 = 0").select("id", F.concat("content", F.lit(" again")).alias("content"), (F.col("vec_id") + 100000).alias("vec_id"))
    return rows.unionByName(again)


def _upsert(t: Tables):
    return mutate.upsert(_narrow(t), _batch(t), order="vec_id").select("id", "content")


def _bulk(t: Tables):
    return mutate.upsert(_narrow(t), _batch(t).drop("vec_id")).select("id", "content")


def _soft(t: Tables):
    ids = t("docs").where("vec_id % 13 = 0").select("id")
    dead, mapped = mutate.soft_delete(t("doc_tombstones"), t("doc_entities"), ids, F.expr(NOW))
    live = mutate.active(t("docs"), dead)
    count = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count(live, "active").unionByName(count(dead, "tombstones")).unionByName(count(mapped, "mappings"))


def _reconstructed(t: Tables):
    placed = shards.assign(t("docs"), 100)
    whole = shards.reconstruct(shards.graph_subsets(placed, t("doc_entities"), t("entities"), t("edges")))
    names = {"docs": F.col("id"), "doc_entities": F.concat_ws(" ", "doc_id", "entity_id", "chunk_id"), "entities": F.concat_ws(" ", "id", "name"), "edges": F.concat_ws(" ", "src", "dst", "rel_type", "chunk_id")}
    out = [whole[k].groupBy(v.alias("name")).agg(F.count("*").alias("n")).select(F.lit(k).alias("table_name"), "name", "n") for k, v in names.items()]
    return functools.reduce(lambda a, b: a.unionByName(b), out)


def _gc(t: Tables):
    queue = t("events_log").where("kind = 'kb.published'").select("kb_id", F.concat(F.lit("shard-"), F.lpad((F.floor(F.substring("event_id", 5, 10).cast("long") / 4) % 60).cast("string"), 5, "0")).alias("shard_key"), (F.col("created_at").cast("timestamp") + F.expr("INTERVAL 2 MINUTES")).alias("not_before")).groupBy("kb_id", "shard_key").agg(F.max("not_before").alias("not_before"))
    active = t("shard_rows").select("kb_id", F.col("shard_id").alias("shard_key"))
    return compact.gc_plan(queue, active, F.expr(NOW)).groupBy("kb_id", "action").agg(F.count("*").alias("n"))


def _evict(t: Tables):
    entries = t("requests").groupBy(F.concat(F.lit("kb-"), (F.col("user_id") % 50).cast("string")).alias("kb_id")).agg((F.sum("latency_ms") + 1000).alias("bytes"), F.max("ts").cast("timestamp").alias("last_touch"))
    return compact.lru_evictions(entries, 150_000, 86_400, F.expr("TIMESTAMP '2024-01-31 12:00:00'"), ["kb-1"]).select("kb_id", "bytes", "verdict")


def _marked(t: Tables):
    live = t("references").where("doc % 2 = 0").select("kb_id", "media_id")
    return media.gc_mark(t("media_objects"), live, 1704067200000 + 150 * 3600000).groupBy("kb_id", "state").agg(F.count("*").alias("n"))


def _validated(t: Tables):
    return media.validated(t("references"), t("media_objects")).groupBy("kb_id", "error").agg(F.count("*").alias("n"))


def _refs(t: Tables):
    from ..functions.media_refs import encoded

    refs = t("references").groupBy("kb_id", (F.col("doc").cast("long") % 97).alias("g")).agg(F.collect_list("media_id").alias("ids"))
    text = refs.select("kb_id", encoded(F.lit(None).cast("array<struct<media_id:string,blob_key:string,role:string,label:string,locator:struct<page:int,byte_start:bigint,byte_end:bigint,time_start_ms:bigint,time_end_ms:bigint,bounding_box:string>,metadata:string>>"), "ids").alias("media_refs"))
    return media.media_ids(text, "kb_id").select("kb_id", F.size("media_ids").alias("n"), F.element_at("media_ids", 1).alias("first"))


def _glob(t: Tables):
    path = F.concat(F.lit("src/"), F.coalesce("source", F.lit("x")), F.lit("/"), F.col("lang"), F.lit("/doc"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, ".go").when(F.col("doc_id") % 3 == 1, ".key").otherwise(".py"))
    rows = t("documents").select(path.alias("path"))
    return rows.where(S.selected("path", ["src/**/*.go", "*.py", "**/*.key"], ["src/src1/**", "**/fr/*"]) & ~S.secret_path("path")).withColumn("language", S.language("path"))


def _status(t: Tables):
    files = t("files_new").withColumn("chunk_ids", F.array(F.concat("path", F.lit("#0")), F.concat("path", F.lit("#1")))).withColumn("size_bytes", F.length("path").cast("long"))
    return codeindex.status(files)


def _refreshed(t: Tables):
    """Files and the chunk of each after a scan: what did not change keeps its old chunk."""
    chunk = lambda when: F.concat_ws("#", "path", "hash", F.coalesce("language", F.lit("")), F.lit(when))
    old, found = (t(n).withColumn("size_bytes", F.lit(1).cast("long")) for n in ("files_old", "files_new"))
    old = old.withColumn("chunk_ids", F.array(chunk("old")))
    chunks = old.select(F.explode("chunk_ids").alias("id"), "path")
    changes = codeindex.diff(old, found)
    fresh = found.join(changes.where(F.col("change").isin("new", "changed")), "path", "left_semi").select(chunk("new").alias("id"), "path")
    files, left = codeindex.refreshed(old, chunks, found, changes, fresh)
    return files.select("path", F.explode("chunk_ids").alias("chunk_id")).join(left.select("path", F.col("id").alias("chunk_id")), ["path", "chunk_id"])


def _ids(t: Tables):
    return t("documents").select(
        "doc_id", S.chunk_id(F.col("doc_id").cast("string"), F.col("doc_id") % 1200).alias("chunk"), S.page_id(F.col("source"), F.col("doc_id") % 7).alias("page"), S.repo_id(F.col("source")).alias("repo"), S.kb_id_of_key(F.concat(F.lit("a b/"), "source")).alias("kb")
    )


_MERGED = "merged AS (SELECT id, content FROM b), kept AS (SELECT id, md5(content) AS content FROM docs WHERE vec_id % 3 <> 0)"
_ROWS = "rows_ AS (SELECT id, concat('new ', CAST(label AS VARCHAR)) AS content, vec_id FROM docs WHERE vec_id % 3 = 0)"
_TIERS = "tiered AS (SELECT *, CAST(round(log2(size_bytes / 33554432.0)) AS INT) AS tier FROM shard_rows WHERE size_bytes > 0)"

QUERIES = {
    "upsert_last_wins": (
        _upsert,
        with_tables(f"WITH {_ROWS} SELECT id, md5(content) AS content FROM docs WHERE vec_id % 3 <> 0 UNION ALL SELECT id, CASE WHEN vec_id % 6 = 0 THEN concat(content, ' again') ELSE content END FROM rows_", "docs"),
    ),
    "upsert_keeps_duplicates": (
        _bulk,
        with_tables(f"WITH {_ROWS} SELECT id, md5(content) AS content FROM docs WHERE vec_id % 3 <> 0 UNION ALL SELECT id, content FROM rows_ UNION ALL SELECT id, concat(content, ' again') FROM rows_ WHERE vec_id % 6 = 0", "docs"),
    ),
    "upsert_clears_tombstone": (
        lambda t: mutate.clear_tombstones(t("doc_tombstones"), _batch(t)).select("doc_id"),
        with_tables("SELECT doc_id FROM doc_tombstones WHERE doc_id NOT IN (SELECT id FROM docs WHERE vec_id % 3 = 0)", "docs", "doc_tombstones"),
    ),
    "soft_delete_active_docs": (
        _soft,
        with_tables(
            """WITH dead AS (SELECT doc_id FROM doc_tombstones UNION SELECT id FROM docs WHERE vec_id % 13 = 0) SELECT 'active' AS kind, count(*) AS n FROM docs WHERE id NOT IN (SELECT doc_id FROM dead) UNION ALL SELECT 'tombstones', count(*) FROM dead
            UNION ALL SELECT 'mappings', count(*) FROM doc_entities WHERE doc_id NOT IN (SELECT id FROM docs WHERE vec_id % 13 = 0)""",
            "docs", "doc_tombstones", "doc_entities",
        ),
    ),
    "active_docs": (lambda t: mutate.active(t("docs"), t("doc_tombstones")).select("id"), with_tables("SELECT id FROM docs WHERE id NOT IN (SELECT doc_id FROM doc_tombstones)", "docs", "doc_tombstones")),
    "reconstruct_union": (
        _reconstructed,
        with_tables(
            """SELECT 'docs' AS table_name, id AS name, count(*) AS n FROM docs GROUP BY id
            UNION ALL SELECT 'doc_entities', concat_ws(' ', doc_id, entity_id, chunk_id), count(*) FROM doc_entities GROUP BY 2
            UNION ALL SELECT 'entities', concat_ws(' ', id, name), 1 FROM entities
            UNION ALL SELECT 'edges', concat_ws(' ', src, dst, rel_type, chunk_id), count(*) FROM (SELECT DISTINCT * FROM edges) t GROUP BY 2""",
            "docs", "doc_entities", "entities", "edges",
        ),
    ),
    "compaction_tiers": (
        lambda t: compact.tiers(t("shard_rows"), 32 << 20).groupBy("tier").agg(F.count("*").alias("n")),
        with_tables(f"WITH {_TIERS} SELECT tier, count(*) AS n FROM tiered GROUP BY 1", "shard_rows"),
    ),
    "compaction_densest": (lambda t: compact.densest(compact.tiers(t("shard_rows"), 32 << 20)), with_tables(f"WITH {_TIERS} SELECT tier, count(*) AS n FROM tiered GROUP BY 1 ORDER BY n DESC, abs(tier), tier LIMIT 1", "shard_rows")),
    "compaction_candidates": (
        lambda t: compact.pressured(t("shard_rows"), 0.2).select("shard_id", "size_bytes", "tombstone_ratio"),
        with_tables("SELECT shard_id, size_bytes, tombstone_ratio FROM shard_rows WHERE size_bytes > 0 AND tombstone_ratio >= 0.2 ORDER BY tombstone_ratio DESC, size_bytes, shard_id LIMIT 4", "shard_rows"),
    ),
    "manifest_bytes": (lambda t: t("shard_rows").groupBy("kb_id").agg(F.sum("size_bytes").alias("total_size_bytes"), F.max("shard_id").alias("max_id")), with_tables("SELECT kb_id, CAST(sum(size_bytes) AS BIGINT) AS total_size_bytes, max(shard_id) AS max_id FROM shard_rows GROUP BY 1", "shard_rows")),
    "shard_gc_plan": (
        _gc,
        with_tables(
            """WITH q AS (SELECT kb_id, concat('shard-', lpad(CAST((CAST(substr(event_id, 5, 10) AS BIGINT) // 4) % 60 AS VARCHAR), 5, '0')) AS shard_key, max(created_at + INTERVAL 2 MINUTES) AS not_before
              FROM events_log WHERE kind = 'kb.published' GROUP BY 1, 2),
            a AS (SELECT DISTINCT kb_id, shard_id AS shard_key, true AS live FROM shard_rows)
            SELECT kb_id, CASE WHEN not_before > TIMESTAMP '2024-01-20 00:00:00' THEN 'wait' WHEN live THEN 'keep' ELSE 'delete' END AS action, count(*) AS n FROM q LEFT JOIN a USING (kb_id, shard_key) GROUP BY 1, 2""",
            "events_log", "shard_rows",
        ),
    ),
    "code_index_refresh": (
        _refreshed,
        "SELECT concat('src/', CAST(doc_id AS VARCHAR), '.txt') AS path, concat_ws('#', concat('src/', CAST(doc_id AS VARCHAR), '.txt'), md5(CASE WHEN doc_id % 5 = 1 THEN concat(text, 'x') ELSE text END), coalesce(lang, ''), CASE WHEN doc_id % 10 <> 0 AND doc_id % 5 <> 1 AND text IS NOT NULL THEN 'old' ELSE 'new' END) AS chunk_id FROM documents WHERE doc_id % 7 <> 0",
    ),
    "cache_evict_plan": (
        _evict,
        with_tables(
            """WITH e AS (SELECT concat('kb-', CAST(user_id % 50 AS VARCHAR)) AS kb_id, CAST(sum(latency_ms) + 1000 AS BIGINT) AS bytes, max(ts) AS last_touch FROM requests GROUP BY 1),
            x AS (SELECT *, last_touch < TIMESTAMP '2024-01-31 12:00:00' - INTERVAL 86400 SECONDS AND kb_id <> 'kb-1' AS expired FROM e),
            s AS (SELECT *, sum(CASE WHEN expired THEN 0 ELSE bytes END) OVER () AS total, coalesce(sum(CASE WHEN kb_id = 'kb-1' OR expired THEN 0 ELSE bytes END) OVER (ORDER BY last_touch, kb_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM x)
            SELECT kb_id, bytes, CASE WHEN expired THEN 'expired' WHEN total - before > 150000 AND kb_id <> 'kb-1' THEN 'over budget' ELSE 'kept' END AS verdict FROM s""",
            "requests",
        ),
    ),
    "file_diff": (
        lambda t: codeindex.diff(t("files_old"), t("files_new")),
        with_tables(
            "SELECT path, CASE WHEN a.hash IS NULL THEN 'new' WHEN b.hash IS NULL THEN 'deleted' WHEN a.hash = b.hash AND coalesce(a.language, '') = coalesce(b.language, '') THEN 'unchanged' ELSE 'changed' END AS change FROM files_old a FULL OUTER JOIN files_new b USING (path)", "files_old", "files_new"
        ),
    ),
    "file_diff_tally": (
        lambda t: codeindex.tally(codeindex.diff(t("files_old"), t("files_new"))),
        with_tables(
            """SELECT count(*) FILTER (a.hash IS NULL) AS "new", count(*) FILTER (a.hash IS NOT NULL AND b.hash IS NOT NULL AND NOT (a.hash = b.hash AND coalesce(a.language, '') = coalesce(b.language, ''))) AS changed, count(*) FILTER (a.hash = b.hash AND coalesce(a.language, '') = coalesce(b.language, '')) AS unchanged, count(*) FILTER (b.hash IS NULL) AS deleted FROM files_old a FULL OUTER JOIN files_new b USING (path)""",
            "files_old", "files_new",
        ),
    ),
    "code_index_status": (_status, with_tables("SELECT count(*) AS files, count(*) * 2 AS chunks, CAST(sum(length(path)) AS BIGINT) AS bytes FROM files_new", "files_new")),
    "media_gc_mark": (
        _marked,
        with_tables(
            """WITH live AS (SELECT DISTINCT kb_id, media_id FROM "references" WHERE CAST(doc AS BIGINT) % 2 = 0)
            SELECT m.kb_id, CASE WHEN state = 'pending' AND l.media_id IS NOT NULL THEN 'active' WHEN state = 'pending' AND created_at_unix_ms <= 1704067200000 + 150 * 3600000 - 86400000 THEN 'tombstoned' ELSE state END AS state, count(*) AS n
            FROM media_objects m LEFT JOIN live l ON l.kb_id = m.kb_id AND l.media_id = m.id GROUP BY 1, 2""",
            "media_objects", "references",
        ).replace(", references AS (", ', "references" AS ('),
    ),
    "media_refs_validate": (
        _validated,
        with_tables(
            """SELECT r.kb_id, CASE WHEN m.id IS NULL THEN 'missing' WHEN m.kb_id <> r.kb_id THEN 'other kb' WHEN m.state = 'tombstoned' THEN 'tombstoned' END AS error, count(*) AS n FROM "references" r LEFT JOIN media_objects m ON m.id = r.media_id GROUP BY 1, 2""", "media_objects", "references"
        ).replace(", references AS (", ', "references" AS ('),
    ),
    "media_ids_distinct": (
        _refs,
        with_tables("""SELECT kb_id, CAST(count(DISTINCT media_id) AS INT) AS n, min(media_id) AS first FROM "references" GROUP BY 1""", "references").replace("WITH references AS (", 'WITH "references" AS ('),
    ),
    "media_page": (
        lambda t: media.page(t("media_objects").where("kb_id = 'kb-2'"), 20, "med_00000050").select("id", "filename"),
        with_tables("SELECT id, filename FROM media_objects WHERE kb_id = 'kb-2' AND id > 'med_00000050' ORDER BY id LIMIT 20", "media_objects"),
    ),
    "glob_filter": (
        _glob,
        """WITH p AS (SELECT concat('src/', coalesce(source, 'x'), '/', lang, '/doc', CAST(doc_id AS VARCHAR), CASE WHEN doc_id % 3 = 0 THEN '.go' WHEN doc_id % 3 = 1 THEN '.key' ELSE '.py' END) AS path FROM documents)
        SELECT path, CASE WHEN path LIKE '%.go' THEN 'go' ELSE 'python' END AS language FROM p WHERE path NOT LIKE '%.key' AND path NOT LIKE 'src/src1/%' AND path NOT LIKE '%/fr/%'""",
    ),
    "stable_ids": (
        _ids,
        "SELECT doc_id, concat(CAST(doc_id AS VARCHAR), '-chunk-', printf('%03d', doc_id % 1200)) AS chunk, concat(source, '-page-', CAST(doc_id % 7 AS VARCHAR)) AS page, left(sha256(source), 16) AS repo, concat('code-a-b-', source) AS kb FROM documents",
    ),
}
