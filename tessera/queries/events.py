"""The event log, metrics and schedules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import cron
from ..operators import eventlog, metrics
from .fixtures import Tables, with_tables

NOW_SQL = "TIMESTAMP '2024-01-20 00:00:00'"


def _now():
    return F.expr("TIMESTAMP_NTZ '2024-01-20 00:00:00'")


def _changes(before, after):
    return after.groupBy("kind", "status").agg(F.count("*").alias("n"))


def _claimed(t: Tables):
    return eventlog.claim(t("events_log"), "document.embedded", "w1", _now(), 25).where("claimed_by = 'w1'").select("event_id", "attempt", "status", "claimed_until")


def _failed(t: Tables):
    failures = t("events_log").where("event_id like '%7'").select("event_id", F.when(F.col("event_id").like("%17"), F.lit(99)).otherwise(F.col("attempt")).alias("attempt"))
    return _changes(None, eventlog.after_failure(t("events_log"), failures))


def _appended(t: Tables):
    log = t("events_log")
    old, new = log.where("event_id < 'evt_0000005000'"), log.where("event_id >= 'evt_0000004000'")
    return eventlog.append(old, new).select("event_id", "kind")


def _inbox(t: Tables):
    rows = t("events_log").select((F.col("kind")).alias("worker_id"), F.concat(F.lit("k"), (F.substring("event_id", 5, 10).cast("long") % 300).cast("string")).alias("idempotency_key"), "event_id", F.col("created_at").alias("processed_at"))
    won, lost = eventlog.mark_processed(rows.where("event_id < 'evt_0000000100'").groupBy("worker_id", "idempotency_key").agg(F.min("event_id").alias("event_id"), F.min("processed_at").alias("processed_at")), rows.where("event_id >= 'evt_0000000100'"))
    return won.select(F.lit("won").alias("side"), "worker_id").union(lost.select(F.lit("lost"), "worker_id")).groupBy("side", "worker_id").agg(F.count("*").alias("n"))


def _roots(t: Tables):
    return t("events_log").where("kind = 'document.upsert'").select("event_id")


def _lineage(t: Tables):
    return eventlog.lineage(t("events_log"), _roots(t), 4).groupBy("root").agg(F.count("*").alias("n"), F.max("depth").alias("depth"), F.max_by("kind", "depth").alias("last_kind"))


def _cron(t: Tables):
    at = F.col("ts")
    return t("requests").where(cron.is_due("*/15 8-18 1,15,20-25 * 1-5", at)).select("event_id")


def _limited(t: Tables):
    rows = t("requests").select("event_id", (F.col("user_id") % 3).cast("string").alias("ip"), "ts")
    return metrics.rate_limited(rows, rate=0.001, burst=5.0).groupBy("ip", "allowed").agg(F.count("*").alias("n"))


_FIRST = "row_number() OVER (PARTITION BY idempotency_key, kind, kb_id ORDER BY created_at, event_id)"
_TREE = """t AS (SELECT event_id AS root, event_id, kind, 0 AS depth FROM events_log WHERE kind = 'document.upsert' UNION ALL SELECT t.root, e.event_id, e.kind, t.depth + 1 FROM t JOIN events_log e ON e.causation_id = t.event_id WHERE t.depth < 4)"""


def _recursive(body: str) -> str:
    return with_tables(f"WITH {_TREE} {body}", "events_log").replace("WITH ", "WITH RECURSIVE ", 1)


QUERIES = {
    "event_dedup": (lambda t: eventlog.deduplicated(t("events_log")).select("event_id"), with_tables(f"SELECT event_id FROM (SELECT event_id, {_FIRST} AS rn FROM events_log) t WHERE rn = 1", "events_log")),
    "event_append": (
        _appended,
        with_tables(
            f"""WITH a AS (SELECT * FROM events_log WHERE event_id < 'evt_0000005000'), n AS (SELECT *, {_FIRST} AS rn FROM events_log WHERE event_id >= 'evt_0000004000')
            SELECT event_id, kind FROM a UNION ALL SELECT event_id, kind FROM n WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM a WHERE a.idempotency_key = n.idempotency_key AND a.kind = n.kind AND a.kb_id = n.kb_id)""",
            "events_log",
        ),
    ),
    "event_claim_next": (
        lambda t: eventlog.next_pending(t("events_log"), "document.chunked", 10).select("event_id", "kind"),
        with_tables("SELECT event_id, kind FROM events_log WHERE kind = 'document.chunked' AND status = 'pending' ORDER BY created_at, event_id LIMIT 10", "events_log"),
    ),
    "event_claim": (
        _claimed,
        with_tables(f"SELECT event_id, attempt + 1 AS attempt, 'claimed' AS status, {NOW_SQL} + INTERVAL 300 SECONDS AS claimed_until FROM (SELECT * FROM events_log WHERE kind = 'document.embedded' AND status = 'pending' ORDER BY created_at, event_id LIMIT 25) t", "events_log"),
    ),
    "event_requeue": (
        lambda t: eventlog.requeued(t("events_log"), _now()).groupBy("kind", "status").agg(F.count("*").alias("n")),
        with_tables(f"SELECT kind, CASE WHEN status = 'claimed' AND (claimed_until < {NOW_SQL} OR claimed_until > {NOW_SQL} + INTERVAL 1 HOUR) THEN 'pending' ELSE status END AS status, count(*) AS n FROM events_log GROUP BY 1, 2", "events_log"),
    ),
    "event_fail_transition": (
        _failed,
        with_tables(
            "SELECT kind, CASE WHEN event_id LIKE '%7' AND event_id NOT LIKE '%17' AND status = 'claimed' THEN CASE WHEN attempt >= max_attempts THEN 'dead' ELSE 'pending' END ELSE status END AS status, count(*) AS n FROM events_log GROUP BY 1, 2", "events_log"
        ),
    ),
    "event_ack": (
        lambda t: eventlog.acknowledged(t("events_log"), t("events_log").where("event_id like '%6'").select("event_id")).groupBy("kind", "status").agg(F.count("*").alias("n")),
        with_tables("SELECT kind, CASE WHEN event_id LIKE '%6' AND status = 'claimed' THEN 'done' ELSE status END AS status, count(*) AS n FROM events_log GROUP BY 1, 2", "events_log"),
    ),
    "event_retention": (
        lambda t: eventlog.retained(t("events_log"), _now(), 10).select("event_id"),
        with_tables(f"SELECT event_id FROM events_log WHERE NOT (status IN ('done', 'dead') AND created_at < {NOW_SQL} - INTERVAL 10 DAYS)", "events_log"),
    ),
    "event_page_keyset": (
        lambda t: eventlog.page(t("events_log"), 50, ("2024-01-10 00:00:00", "evt_")).select("event_id", "created_at"),
        with_tables("SELECT event_id, created_at FROM events_log WHERE (created_at, event_id) > (TIMESTAMP '2024-01-10 00:00:00', 'evt_') ORDER BY created_at, event_id LIMIT 50", "events_log"),
    ),
    "event_oldest_child": (
        lambda t: eventlog.oldest_child(t("events_log")),
        with_tables("SELECT causation_id, kind, event_id FROM (SELECT *, row_number() OVER (PARTITION BY causation_id, kind ORDER BY created_at, event_id) AS rn FROM events_log WHERE causation_id IS NOT NULL) t WHERE rn = 1", "events_log"),
    ),
    "event_lineage": (_lineage, _recursive("SELECT root, count(*) AS n, max(depth) AS depth, max_by(kind, depth) AS last_kind FROM t GROUP BY 1")),
    "operation_terminal": (
        lambda t: eventlog.terminal(t("events_log"), _roots(t), 4),
        _recursive("SELECT root, event_id, kind FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY CASE kind WHEN 'kb.published' THEN 0 WHEN 'media.uploaded' THEN 1 ELSE 2 END, depth, event_id) AS rn FROM t WHERE kind IN ('kb.published', 'media.uploaded', 'worker.failed')) x WHERE rn = 1"),
    ),
    "operation_stages": (
        lambda t: eventlog.stages(t("events_log"), _roots(t), 4).select("root", "depth", "stage", "event_id", "failed"),
        _recursive("SELECT root, depth, kind AS stage, event_id, EXISTS (SELECT 1 FROM events_log f WHERE f.kind = 'worker.failed' AND f.causation_id = t.event_id) AS failed FROM t WHERE kind <> 'worker.failed'"),
    ),
    "inbox_first_writer": (
        _inbox,
        with_tables(
            """WITH r AS (SELECT kind AS worker_id, concat('k', CAST(CAST(substr(event_id, 5, 10) AS BIGINT) % 300 AS VARCHAR)) AS k, event_id, created_at FROM events_log), f AS (SELECT DISTINCT worker_id, k FROM r WHERE event_id < 'evt_0000000100'),
            n AS (SELECT *, row_number() OVER (PARTITION BY worker_id, k ORDER BY created_at, event_id) AS rn, EXISTS (SELECT 1 FROM f WHERE f.worker_id = r.worker_id AND f.k = r.k) AS held FROM r WHERE event_id >= 'evt_0000000100')
            SELECT side, worker_id, count(*) AS n FROM (SELECT 'won' AS side, worker_id FROM f UNION ALL SELECT CASE WHEN rn = 1 AND NOT held THEN 'won' ELSE 'lost' END, worker_id FROM n) t GROUP BY 1, 2""",
            "events_log",
        ),
    ),
    "metrics_route": (
        lambda t: metrics.routes(t("requests")),
        with_tables("SELECT route, count(*) AS count, CAST(sum(CASE WHEN status >= 400 THEN 1 ELSE 0 END) AS BIGINT) AS errors, CAST(sum(greatest(latency_ms, 0)) AS BIGINT) AS latency_sum, min(greatest(latency_ms, 0)) AS latency_min, max(greatest(latency_ms, 0)) AS latency_max FROM requests GROUP BY 1", "requests"),
    ),
    "metrics_query_by_kb": (
        lambda t: metrics.by_key(t("requests").withColumn("kb_id", F.concat(F.lit("kb-"), (F.col("user_id") % 5).cast("string"))), ["kb_id"], ["latency_ms"]),
        with_tables("SELECT concat('kb-', CAST(user_id % 5 AS VARCHAR)) AS kb_id, count(*) AS count, CAST(sum(greatest(latency_ms, 0)) AS BIGINT) AS latency_ms_sum, max(greatest(latency_ms, 0)) AS latency_ms_max FROM requests GROUP BY 1", "requests"),
    ),
    "metrics_gauge": (
        lambda t: metrics.gauges(t("requests").withColumn("at", F.struct("ts", "event_id")), "route", "latency_ms", "at"),
        with_tables("SELECT route, latency_ms FROM (SELECT *, row_number() OVER (PARTITION BY route ORDER BY ts DESC, event_id DESC) AS rn FROM requests) t WHERE rn = 1", "requests"),
    ),
    "metrics_worker_outcome": (
        lambda t: metrics.outcomes(t("events_log")),
        with_tables("SELECT kind, CASE status WHEN 'done' THEN 'success' WHEN 'dead' THEN 'dead' WHEN 'claimed' THEN 'running' ELSE 'waiting' END AS outcome, count(*) AS count, CAST(sum(attempt) AS BIGINT) AS attempts FROM events_log GROUP BY 1, 2", "events_log"),
    ),
    "latency_percentiles": (
        lambda t: metrics.percentiles(t("requests"), "latency_ms"),
        with_tables("WITH l AS (SELECT list(latency_ms ORDER BY latency_ms) AS v, count(*) AS n FROM requests) SELECT " + ", ".join(f"v[1 + least(n * {p} // 100, n - 1)] AS p{p}" for p in (50, 90, 99)) + " FROM l", "requests"),
    ),
    "recent_ring_200": (lambda t: metrics.recent(t("requests"), 200, ("ts", "event_id")).select("event_id", "route"), with_tables("SELECT event_id, route FROM requests ORDER BY ts DESC, event_id DESC LIMIT 200", "requests")),
    "cron_due": (
        _cron,
        with_tables("SELECT event_id FROM requests WHERE minute(ts) % 15 = 0 AND hour(ts) BETWEEN 8 AND 18 AND (day(ts) IN (1, 15) OR day(ts) BETWEEN 20 AND 25) AND dayofweek(ts) BETWEEN 1 AND 5", "requests"),
    ),
    "status_classify": (
        lambda t: t("requests").select("event_id", F.when(F.col("status") >= 400, "error").otherwise("ok").alias("class"), F.greatest("latency_ms", F.lit(0)).alias("ms")),
        with_tables("SELECT event_id, CASE WHEN status >= 400 THEN 'error' ELSE 'ok' END AS class, greatest(latency_ms, 0) AS ms FROM requests", "requests"),
    ),
    "rate_limit": (
        _limited,
        with_tables(
            """WITH l AS (SELECT CAST(user_id % 3 AS VARCHAR) AS ip, list(epoch(ts) ORDER BY ts) AS times FROM requests GROUP BY 1),
            b AS (SELECT ip, len(times) AS total, list_reduce(list_transform(list_prepend(times[1], times), lambda s: {'s': s, 'tokens': CAST(5 AS DOUBLE), 'n': CAST(0 AS BIGINT)}),
              lambda a, x: {'s': x.s, 'tokens': least(5, a.tokens + (x.s - a.s) * 0.001) - CASE WHEN least(5, a.tokens + (x.s - a.s) * 0.001) >= 1 THEN 1 ELSE 0 END,
                'n': a.n + CASE WHEN least(5, a.tokens + (x.s - a.s) * 0.001) >= 1 THEN 1 ELSE 0 END}).n AS passed FROM l)
            SELECT ip, true AS allowed, passed AS n FROM b WHERE passed > 0 UNION ALL SELECT ip, false, total - passed FROM b WHERE total > passed""",
            "requests",
        ),
    ),
}
