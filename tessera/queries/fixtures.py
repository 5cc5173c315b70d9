"""Inputs of the queries, derived from the driver's tables by SQL that both engines run alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Derived tables in terms of base tables and of each other.
SQL = {
    "docs": """SELECT lpad(CAST(e.vec_id AS STRING),8,'0') AS id, coalesce(d.text, concat('vec ', CAST(e.vec_id AS STRING))) AS content,
       e.embedding, e.vec_id, e.label, d.lang, d.source FROM {embeddings} e LEFT JOIN {documents} d ON d.doc_id = e.vec_id""",
    "doc_entities": """SELECT id AS doc_id, concat('source:',source) AS entity_id, CAST(1.0 AS DOUBLE) AS weight, concat(id,'-chunk-000') AS chunk_id FROM {docs} WHERE source IS NOT NULL
       UNION ALL SELECT id, concat('lang:',lang), CAST(0.5 AS DOUBLE), concat(id,'-chunk-000') FROM {docs} WHERE lang IS NOT NULL
       UNION ALL SELECT id, concat('label:',CAST(label AS STRING)), CASE WHEN vec_id % 10 = 0 THEN CAST(NULL AS DOUBLE) ELSE CAST(2.0 AS DOUBLE) END, concat(id,'-chunk-000') FROM {docs}""",
    "edges": """SELECT concat('source:',source) AS src, concat('lang:',lang) AS dst, CAST(0.5 AS DOUBLE) AS weight, 'written_in' AS rel_type, concat(id,'-chunk-000') AS chunk_id FROM {docs} WHERE lang IS NOT NULL
       UNION ALL SELECT concat('lang:',lang), concat('label:',CAST(label AS STRING)), CAST(vec_id % 4 AS DOUBLE)/4, 'tagged', concat(id,'-chunk-000') FROM {docs} WHERE lang IS NOT NULL""",
    "entities": "SELECT DISTINCT entity_id AS id, entity_id AS name FROM {doc_entities}",
    "doc_tombstones": "SELECT id AS doc_id FROM {docs} WHERE vec_id % 11 = 0",
    "events_log": """SELECT concat('evt_',lpad(CAST(event_id AS STRING),10,'0')) AS event_id, concat('kb-',CAST(user_id % 5 AS STRING)) AS kb_id,
       CASE WHEN event_id % 4 = 0 THEN 'document.upsert' WHEN event_id % 4 = 1 THEN 'document.chunked' WHEN event_id % 4 = 2 THEN 'document.embedded' WHEN event_type='error' THEN 'worker.failed' ELSE 'kb.published' END AS kind,
       CASE WHEN event_id % 4 = 0 THEN NULL ELSE concat('evt_',lpad(CAST(event_id-1 AS STRING),10,'0')) END AS causation_id, concat('idem-',CAST(event_id % 4000 AS STRING)) AS idempotency_key,
       CASE WHEN event_id % 5 = 0 THEN 'pending' WHEN event_id % 5 = 1 THEN 'claimed' WHEN event_id % 5 = 2 THEN 'done' WHEN event_id % 5 = 3 THEN 'dead' ELSE 'pending' END AS status,
       CAST(event_id % 4 AS INT) AS attempt, 3 AS max_attempts, ts AS created_at, ts + INTERVAL 5 MINUTES AS claimed_until FROM {events}""",
    "requests": "SELECT event_id, event_type AS route, CASE WHEN event_type='error' THEN 500 ELSE 200 END AS status, CAST(floor(value*10) AS BIGINT) AS latency_ms, ts, user_id FROM {events}",
    "files_old": "SELECT concat('src/',CAST(doc_id AS STRING),'.txt') AS path, md5(text) AS hash, lang AS language FROM {documents} WHERE doc_id % 10 <> 0",
    "files_new": "SELECT concat('src/',CAST(doc_id AS STRING),'.txt') AS path, md5(CASE WHEN doc_id % 5 = 1 THEN concat(text,'x') ELSE text END) AS hash, lang AS language FROM {documents} WHERE doc_id % 7 <> 0",
    "media_objects": """SELECT concat('med_',lpad(CAST(page_id AS STRING),8,'0')) AS id, concat('kb-',CAST(page_id % 5 AS STRING)) AS kb_id,
       CASE WHEN page_id % 3 = 0 THEN 'pending' WHEN page_id % 3 = 1 THEN 'active' ELSE 'tombstoned' END AS state, CAST(1704067200000 + page_id*3600000 AS BIGINT) AS created_at_unix_ms, url AS filename FROM {pages}""",
    "shard_rows": """SELECT concat('shard-', lpad(CAST(o_custkey % 40 AS STRING),5,'0')) AS shard_id, concat('kb-', CAST(o_custkey % 5 AS STRING)) AS kb_id, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) * 40 AS BIGINT) AS size_bytes, count(*) AS vector_rows,
       round(CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 6) AS tombstone_ratio FROM {orders} GROUP BY 1, 2""",
    "references": "SELECT CAST(doc_id AS STRING) AS doc, concat('kb-', CAST(doc_id % 5 AS STRING)) AS kb_id, concat('med_', lpad(CAST(doc_id % 400 AS STRING),8,'0')) AS media_id FROM {documents}",
}
BASE = ["documents", "embeddings", "pages", "events", "orders", "lineitem", "customer", "conversations"]


class Tables:
    """Base and derived tables of a folder, by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self.made = spark, sf_dir, {}

    def __call__(self, name: str) -> DataFrame:
        if name not in self.made:
            if name in SQL:
                needs = {n: self(n) for n in [*SQL, *BASE] if f"{{{n}}}" in SQL[name]}
                self.made[name] = self.spark.sql(SQL[name], **needs)
            else:
                self.made[name] = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        return self.made[name]

    def query(self) -> list[float]:
        """The vector that searches look for: row 0 of ``embeddings``."""
        return [float(x) for x in self("embeddings").where("vec_id = 0").first()["embedding"]]


def with_tables(body: str, *names: str) -> str:
    """``body`` for DuckDB, after the derived tables that it names (and what they need), as common table expressions."""
    order: list[str] = []

    def need(name: str) -> None:
        for other in SQL:
            if f"{{{other}}}" in SQL[name]:
                need(other)
        if name not in order:
            order.append(name)

    for n in names:
        need(n)
    ctes = ", ".join(f"{n} AS ({SQL[n].format(**{x: x for x in [*SQL, *BASE]})})" for n in order)
    return f"WITH {ctes} {body}" if not body.lstrip().startswith("WITH ") else f"WITH {ctes}, {body.lstrip()[5:]}"


#: Distances of ``docs`` to the query vector, for DuckDB.
DIST = """dist AS (SELECT d.id, d.content, d.vec_id, d.label, d.lang, d.source, round(sqrt(list_sum(list_transform(list_zip(d.embedding, q.embedding),
  lambda z: (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) * (CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE))))), 6) AS distance FROM docs d, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"""
SHARDED = "sharded AS (SELECT *, concat('shard-', lpad(CAST(CAST(floor((row_number() OVER (ORDER BY id) - 1) / 100.0) AS INT) AS VARCHAR), 5, '0')) AS shard_id FROM docs)"
