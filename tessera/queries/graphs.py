"""Graph expansion, graph search and graph construction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import graph, graphbuild, mutate, shards
from ..policy import Expansion, SearchOptions
from .fixtures import DIST, SHARDED, Tables, with_tables

K = 10


def _start(t: Tables):
    return graph.seed_scores(t("doc_entities"), graph.seeds(t("docs"), t.query(), K))


def _capped(t: Tables, cap: int = 25, types: tuple[str, ...] = ()):
    return graph.neighbours(t("edges"), cap, types)


def _expanded(t: Tables, hops: int):
    return graph.expand(_start(t), _capped(t), hops, 0.7)


def _nodes(df):
    return df.select("node", V.rounded("s", 1e-9).alias("s"))


def _search(t: Tables, **changes):
    return graph.graph_search(t("docs"), t("doc_entities"), t("edges"), t.query(), K, Expansion(**changes))


def _by_shard(t: Tables):
    placed = shards.assign(t("docs"), 100)
    where = placed.select("id", "shard_id")
    mapped = t("doc_entities").join(where.withColumnRenamed("id", "doc_id"), "doc_id")
    chunks = mapped.select("chunk_id", "shard_id").distinct()
    links = t("edges").join(chunks, "chunk_id").select(*t("edges").columns, "shard_id")
    return graph.graph_search_by_shard(placed, mapped, links, t.query(), K, Expansion()).select("shard_id", "id", "distance", "graph_score", "score")


def _adaptive(t: Tables, floor: float):
    return graph.run(t("docs"), t("doc_entities"), t("edges"), t.query(), SearchOptions("adaptive", K, adaptive_min_similarity=floor)).select("id", "distance", "graph_score", "score")


def _shortest(t: Tables):
    start = t("docs").where("vec_id < 5 and source is not null").select(F.concat(F.lit("source:"), "source").alias("node")).distinct().withColumn("s", F.lit(1.0))
    return graph.shortest_hops(start, t("edges"), 2, 8).withColumn("s", V.rounded("s", 1e-9))


def _subset(t: Tables):
    first = shards.assign(t("docs"), 100).where("shard_id = 'shard-00001'")
    own, named, links = shards.graph_subset(first, t("doc_entities"), t("entities"), t("edges"))
    count = lambda df, kind: df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count(own, "doc_entities").unionByName(count(named, "entities")).unionByName(count(links, "edges"))


def _pruned(t: Tables):
    ids = t("docs").where("label < 9").select("id")
    mapped, links, named = mutate.prune_graph(t("doc_entities"), t("edges"), t("entities"), ids)
    return mapped.select(F.lit("mapping").alias("kind"), F.col("entity_id").alias("name")).union(links.select(F.lit("edge"), "src")).union(named.select(F.lit("entity"), "id")).groupBy("kind", "name").agg(F.count("*").alias("n"))


def _orphans(t: Tables):
    half = t("doc_entities").where("entity_id not like 'source:%'")
    links = t("edges").where("rel_type = 'tagged'")
    return mutate.orphans(t("entities"), half, links).select("id")


def _weights(t: Tables):
    chunk_docs = t("doc_entities").select("chunk_id", "doc_id").distinct()
    links = graphbuild.clean_edges(t("edges").where("rel_type = 'written_in'"))
    mapped = t("doc_entities").select("doc_id", "entity_id", "chunk_id")
    return graphbuild.doc_entities(chunk_docs, mapped, links)


_E0 = """seeds AS (SELECT id FROM (SELECT id, row_number() OVER (ORDER BY distance, id) AS rn FROM dist) t WHERE rn <= 10),
e0 AS (SELECT de.entity_id AS node, sum(CASE WHEN coalesce(de.weight, 1.0::DOUBLE) <= 0 THEN 1.0::DOUBLE ELSE coalesce(de.weight, 1.0::DOUBLE) END) AS s FROM doc_entities de JOIN seeds ON de.doc_id = seeds.id WHERE de.entity_id <> '' GROUP BY de.entity_id)"""


def _cap_sql(cap: int = 25, where: str = "true") -> str:
    return f"""und AS (SELECT src, dst, coalesce(weight, 1.0::DOUBLE) AS w, rel_type, chunk_id FROM edges WHERE {where} UNION ALL SELECT dst, src, coalesce(weight, 1.0::DOUBLE), rel_type, chunk_id FROM edges WHERE {where}),
cap AS (SELECT src, dst, w FROM (SELECT src, dst, w, row_number() OVER (PARTITION BY src ORDER BY w DESC, dst, rel_type, chunk_id) AS rn FROM und) t WHERE rn <= {cap})"""


_HOPS = """h1 AS (SELECT cap.dst AS node, sum(e0.s * cap.w * 0.7::DOUBLE) AS s FROM e0 JOIN cap ON cap.src = e0.node WHERE cap.w > 0 AND e0.s > 0 GROUP BY cap.dst),
h2 AS (SELECT cap.dst AS node, sum(h1.s * cap.w * 0.7::DOUBLE) AS s FROM h1 JOIN cap ON cap.src = h1.node WHERE cap.w > 0 AND h1.s > 0 GROUP BY cap.dst)"""


def _nodes_sql(*frontiers: str) -> str:
    union = " UNION ALL ".join(f"SELECT * FROM {f}" for f in frontiers)
    return f"ent0 AS (SELECT node, sum(s) AS s FROM ({union}) t GROUP BY node)"


_DOCS = """ent AS (SELECT node, s FROM (SELECT node, s, row_number() OVER (ORDER BY s DESC, node) AS rn FROM ent0) t WHERE rn <= 1000),
g AS (SELECT de.doc_id AS id, sum(ent.s * CASE WHEN coalesce(de.weight, 1.0::DOUBLE) <= 0 THEN 1.0::DOUBLE ELSE coalesce(de.weight, 1.0::DOUBLE) END) AS g FROM doc_entities de JOIN ent ON de.entity_id = ent.node GROUP BY de.doc_id)"""


def _search_sql(alpha: float = 0.7, where: str = "true", frontiers: tuple[str, ...] = ("e0", "h1", "h2"), tables: str = DIST) -> str:
    return f"""WITH {tables}, {_E0}, {_cap_sql(25, where)}, {_HOPS}, {_nodes_sql(*frontiers)}, {_DOCS}, mx AS (SELECT greatest(max(g), 0) AS m FROM g), cand AS (SELECT id FROM seeds UNION SELECT id FROM g),
r AS (SELECT d.id, d.distance, coalesce(g.g, 0::DOUBLE) AS graph_score, {alpha}::DOUBLE * (1 / (1 + d.distance)) + {round(1 - alpha, 10)}::DOUBLE * CASE WHEN mx.m > 0 THEN coalesce(g.g, 0::DOUBLE) / mx.m ELSE 0::DOUBLE END AS score
 FROM cand JOIN dist d ON d.id = cand.id LEFT JOIN g ON g.id = cand.id CROSS JOIN mx)
SELECT id, distance, round(graph_score + 1e-9::DOUBLE, 6) AS graph_score, round(score, 6) AS score FROM r ORDER BY round(score, 6) DESC, distance, id LIMIT 10"""


_BY_SHARD = with_tables(
    f"""WITH {DIST.replace('dist AS', 'alldist AS')}, {SHARDED}, dist AS (SELECT a.*, s.shard_id FROM alldist a JOIN sharded s USING (id)),
    de AS (SELECT d.doc_id, d.entity_id, d.chunk_id, CASE WHEN coalesce(d.weight, 1.0::DOUBLE) <= 0 THEN 1.0::DOUBLE ELSE coalesce(d.weight, 1.0::DOUBLE) END AS w, s.shard_id FROM doc_entities d JOIN sharded s ON s.id = d.doc_id),
    ed AS (SELECT e.*, c.shard_id FROM edges e JOIN (SELECT DISTINCT chunk_id, shard_id FROM de) c USING (chunk_id)),
    seeds AS (SELECT shard_id, id FROM (SELECT shard_id, id, row_number() OVER (PARTITION BY shard_id ORDER BY distance, id) AS rn FROM dist) t WHERE rn <= 10),
    e0 AS (SELECT de.shard_id, de.entity_id AS node, sum(w) AS s FROM de JOIN seeds ON de.doc_id = seeds.id WHERE de.entity_id <> '' GROUP BY 1, 2),
    und AS (SELECT shard_id, src, dst, coalesce(weight, 1.0::DOUBLE) AS w, rel_type, chunk_id FROM ed UNION ALL SELECT shard_id, dst, src, coalesce(weight, 1.0::DOUBLE), rel_type, chunk_id FROM ed),
    cap AS (SELECT shard_id, src, dst, w FROM (SELECT *, row_number() OVER (PARTITION BY shard_id, src ORDER BY w DESC, dst, rel_type, chunk_id) AS rn FROM und) t WHERE rn <= 25),
    h1 AS (SELECT cap.shard_id, cap.dst AS node, sum(e0.s * cap.w * 0.7::DOUBLE) AS s FROM e0 JOIN cap ON cap.src = e0.node AND cap.shard_id = e0.shard_id WHERE cap.w > 0 AND e0.s > 0 GROUP BY 1, 2),
    h2 AS (SELECT cap.shard_id, cap.dst AS node, sum(h1.s * cap.w * 0.7::DOUBLE) AS s FROM h1 JOIN cap ON cap.src = h1.node AND cap.shard_id = h1.shard_id WHERE cap.w > 0 AND h1.s > 0 GROUP BY 1, 2),
    ent0 AS (SELECT shard_id, node, sum(s) AS s FROM (SELECT * FROM e0 UNION ALL SELECT * FROM h1 UNION ALL SELECT * FROM h2) t GROUP BY 1, 2),
    ent AS (SELECT shard_id, node, s FROM (SELECT *, row_number() OVER (PARTITION BY shard_id ORDER BY s DESC, node) AS rn FROM ent0) t WHERE rn <= 1000),
    g AS (SELECT de.shard_id, de.doc_id AS id, sum(ent.s * de.w) AS g FROM de JOIN ent ON de.entity_id = ent.node AND de.shard_id = ent.shard_id GROUP BY 1, 2),
    mx AS (SELECT shard_id, greatest(max(g), 0) AS m FROM g GROUP BY 1), cand AS (SELECT shard_id, id FROM seeds UNION SELECT shard_id, id FROM g),
    r AS (SELECT d.shard_id, d.id, d.distance, coalesce(g.g, 0::DOUBLE) AS graph_score, 0.7::DOUBLE * (1 / (1 + d.distance)) + 0.3::DOUBLE * CASE WHEN mx.m > 0 THEN coalesce(g.g, 0::DOUBLE) / mx.m ELSE 0::DOUBLE END AS score
      FROM cand JOIN dist d ON d.id = cand.id LEFT JOIN g ON g.id = cand.id LEFT JOIN mx ON mx.shard_id = cand.shard_id)
    SELECT shard_id, id, distance, round(graph_score + 1e-9::DOUBLE, 6) AS graph_score, round(score, 6) AS score FROM r ORDER BY round(score, 6) DESC, distance, id LIMIT 10""",
    "docs", "doc_entities", "edges",
)
_GRAPH = ("docs", "doc_entities", "edges")

QUERIES = {
    "entities_distinct": (lambda t: t("entities"), with_tables("SELECT id, name FROM entities", "entities")),
    "edges_from_docs": (
        lambda t: t("edges").groupBy("src", "dst", "rel_type").agg(F.count("*").alias("n"), F.sum("weight").alias("weight")),
        with_tables("SELECT src, dst, rel_type, count(*) AS n, sum(weight) AS weight FROM edges GROUP BY 1, 2, 3", "edges"),
    ),
    "edges_cleaned": (
        lambda t: graphbuild.clean_edges(t("edges")),
        with_tables("SELECT src, dst, CASE WHEN coalesce(weight, 1) <= 0 THEN 1.0::DOUBLE ELSE coalesce(weight, 1) END AS weight, rel_type, chunk_id FROM edges WHERE src <> '' AND dst <> '' AND src <> dst", "edges"),
    ),
    "doc_entity_weights": (
        _weights,
        with_tables(
            """WITH l AS (SELECT src, dst, CASE WHEN coalesce(weight, 1) <= 0 THEN 1.0::DOUBLE ELSE coalesce(weight, 1) END AS weight, chunk_id FROM edges WHERE rel_type = 'written_in' AND src <> dst),
            c AS (SELECT DISTINCT chunk_id, doc_id FROM doc_entities), w AS (SELECT doc_id, entity_id, sum(weight) AS weight, chunk_id FROM (SELECT src AS entity_id, weight, chunk_id FROM l UNION ALL SELECT dst, weight, chunk_id FROM l) e JOIN c USING (chunk_id) GROUP BY doc_id, entity_id, chunk_id)
            SELECT doc_id, entity_id, weight, chunk_id FROM w UNION ALL SELECT DISTINCT doc_id, entity_id, 1.0::DOUBLE, chunk_id FROM doc_entities d WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.doc_id = d.doc_id AND w.entity_id = d.entity_id AND w.chunk_id = d.chunk_id)""",
            "doc_entities", "edges",
        ),
    ),
    "seed_entity_scores": (lambda t: _nodes(_start(t)), with_tables(f"WITH {DIST}, {_E0} SELECT node, round(s + 1e-9::DOUBLE, 6) AS s FROM e0", *_GRAPH)),
    "edges_bidirectional_capped": (lambda t: _capped(t, 5), with_tables(f"WITH {_cap_sql(5)} SELECT src, dst, w FROM cap", *_GRAPH)),
    "graph_expand_1hop": (lambda t: _nodes(_expanded(t, 1)), with_tables(f"WITH {DIST}, {_E0}, {_cap_sql()}, {_HOPS}, {_nodes_sql('e0', 'h1')} SELECT node, round(s + 1e-9::DOUBLE, 6) AS s FROM ent0", *_GRAPH)),
    "graph_expand_2hop": (lambda t: _nodes(_expanded(t, 2)), with_tables(f"WITH {DIST}, {_E0}, {_cap_sql()}, {_HOPS}, {_nodes_sql('e0', 'h1', 'h2')} SELECT node, round(s + 1e-9::DOUBLE, 6) AS s FROM ent0", *_GRAPH)),
    "topn_entities": (
        lambda t: graph.top_entities(_nodes(_expanded(t, 2)), 7),
        with_tables(f"WITH {DIST}, {_E0}, {_cap_sql()}, {_HOPS}, {_nodes_sql('e0', 'h1', 'h2')} SELECT node, round(s + 1e-9::DOUBLE, 6) AS s FROM ent0 ORDER BY round(s + 1e-9::DOUBLE, 6) DESC, node LIMIT 7", *_GRAPH),
    ),
    "doc_graph_scores": (
        lambda t: graph.doc_scores(t("doc_entities"), graph.top_entities(_expanded(t, 2), 1000)).select("id", V.rounded("g", 1e-9).alias("g")),
        with_tables(f"WITH {DIST}, {_E0}, {_cap_sql()}, {_HOPS}, {_nodes_sql('e0', 'h1', 'h2')}, {_DOCS} SELECT id, round(g + 1e-9::DOUBLE, 6) AS g FROM g", *_GRAPH),
    ),
    "graph_search": (_search, with_tables(_search_sql(), *_GRAPH)),
    "graph_search_edge_types": (lambda t: _search(t, edge_types=("written_in",)), with_tables(_search_sql(where="rel_type = 'written_in'"), *_GRAPH)),
    "graph_search_alpha0": (lambda t: _search(t, alpha=0.0), with_tables(_search_sql(0.0), *_GRAPH)),
    "graph_search_hops0": (lambda t: _search(t, hops=0), with_tables(_search_sql(frontiers=("e0",)), *_GRAPH)),
    "graph_search_sharded": (_by_shard, _BY_SHARD),
    "adaptive_search": (lambda t: _adaptive(t, 0.35), with_tables(f"WITH {DIST} SELECT id, distance, 0::DOUBLE AS graph_score, round(1 / (1 + distance), 6) AS score FROM dist ORDER BY distance, id LIMIT 10", "docs")),
    "adaptive_search_fallback": (
        lambda t: graph.run(t("docs").where("vec_id <> 0"), t("doc_entities"), t("edges"), t.query(), SearchOptions("adaptive", K, adaptive_min_similarity=0.99)).select("id", "distance", "graph_score", "score"),
        with_tables(_search_sql(tables=DIST.replace("WHERE vec_id = 0) q)", "WHERE vec_id = 0) q WHERE d.vec_id <> 0)")), *_GRAPH),
    ),
    "shortest_hops": (
        _shortest,
        with_tables(
            """WITH s0 AS (SELECT DISTINCT concat('source:', source) AS node FROM docs WHERE vec_id < 5 AND source IS NOT NULL), b AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges) t WHERE src <> dst),
            h1 AS (SELECT DISTINCT node AS src, b.dst FROM s0 JOIN b ON b.src = node), h2 AS (SELECT DISTINCT h1.src, b.dst FROM h1 JOIN b ON b.src = h1.dst WHERE b.dst <> h1.src AND NOT EXISTS (SELECT 1 FROM h1 x WHERE x.src = h1.src AND x.dst = b.dst)),
            r AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY hop, dst) AS rn FROM (SELECT src, dst, 1 AS hop FROM h1 UNION ALL SELECT src, dst, 2 FROM h2) t) SELECT src, dst, hop, round(pow(0.7, hop) + 1e-9, 6) AS s FROM r WHERE rn <= 8""",
            "docs", "edges",
        ),
    ),
    "shard_graph_subset": (
        _subset,
        with_tables(
            f"""WITH {SHARDED}, own AS (SELECT de.* FROM doc_entities de JOIN sharded s ON s.id = de.doc_id WHERE s.shard_id = 'shard-00001')
            SELECT 'doc_entities' AS kind, count(*) AS n FROM own UNION ALL SELECT 'entities', count(DISTINCT entity_id) FROM own UNION ALL SELECT 'edges', count(*) FROM (SELECT DISTINCT e.* FROM edges e JOIN own USING (chunk_id)) t""",
            "docs", "doc_entities", "edges",
        ),
    ),
    "orphan_entities": (
        _orphans,
        with_tables(
            "SELECT id FROM entities e WHERE NOT EXISTS (SELECT 1 FROM doc_entities d WHERE d.entity_id = e.id AND d.entity_id NOT LIKE 'source:%') AND NOT EXISTS (SELECT 1 FROM edges x WHERE x.rel_type = 'tagged' AND (x.src = e.id OR x.dst = e.id))", "entities", "edges"
        ),
    ),
    "hard_delete_prune": (
        _pruned,
        with_tables(
            """WITH gone AS (SELECT DISTINCT chunk_id FROM doc_entities JOIN docs ON docs.id = doc_id WHERE label < 9), m AS (SELECT doc_entities.* FROM doc_entities JOIN docs ON docs.id = doc_id WHERE label >= 9), l AS (SELECT * FROM edges WHERE chunk_id NOT IN (SELECT chunk_id FROM gone)),
            n AS (SELECT id FROM entities e WHERE EXISTS (SELECT 1 FROM m WHERE m.entity_id = e.id) OR EXISTS (SELECT 1 FROM l WHERE l.src = e.id OR l.dst = e.id))
            SELECT kind, name, count(*) AS n FROM (SELECT 'mapping' AS kind, entity_id AS name FROM m UNION ALL SELECT 'edge', src FROM l UNION ALL SELECT 'entity', id FROM n) t GROUP BY 1, 2""",
            "docs", "doc_entities", "edges", "entities",
        ),
    ),
}
