"""Entity graphs from chunks: extraction, clean-up, weights."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: An extractor: texts of a batch of chunks -> for each its entity names and its edges (src, dst, type, weight).
Grapher = Callable[[list[str]], list[tuple[list[str], list[tuple[str, str, str, float]]]]]
Canonical = Callable[[str], str]


def capitalised(texts: list[str]) -> list[tuple[list[str], list[tuple[str, str, str, float]]]]:
    """A grapher that needs no network: capitalised words, linked to the next one of the chunk."""
    import re

    out = []
    for text in texts:
        names = list(dict.fromkeys(re.findall(r"\b[A-Z][\w'-]{2,}", text)))
        out.append((names, [(a, b, "next_to", 1.0) for a, b in zip(names, names[1:])]))
    return out


def extract(chunks: DataFrame, grapher: Grapher = capitalised, canonical: Canonical | None = None, batch: int = 500) -> DataFrame:
    """``doc_id, chunk_id, entities, edges`` of each chunk; names are trimmed, blanks and repeats in a chunk dropped."""

    def run(batches) -> Iterator:
        import pandas as pd

        fix = lambda n: (canonical(n) if canonical else n).strip()
        for pdf in batches:
            for a in range(0, len(pdf), batch):
                part, rows = pdf.iloc[a : a + batch], []
                for d, c, (names, edges) in zip(part["doc_id"], part["chunk_id"], grapher(part["text"].tolist()), strict=True):
                    kept = [{"id": fix(n), "name": n.strip()} for n in dict.fromkeys(names) if fix(n)]
                    rows.append((d, c, kept, [{"src": fix(s), "dst": fix(t), "rel_type": r, "weight": float(w)} for s, t, r, w in edges]))
                yield pd.DataFrame(rows, columns=["doc_id", "chunk_id", "entities", "edges"])

    schema = "doc_id string, chunk_id string, entities array<struct<id:string,name:string>>, edges array<struct<src:string,dst:string,rel_type:string,weight:double>>"
    return chunks.select("doc_id", "chunk_id", "text").mapInPandas(run, schema)


def entities(extracted: DataFrame) -> DataFrame:
    """``id, name``: each entity once, by the name of its first chunk."""
    named = extracted.select("chunk_id", F.posexplode("entities").alias("pos", "e")).select("e.id", "e.name", "chunk_id", "pos")
    return named.groupBy("id").agg(F.min_by("name", F.struct("chunk_id", "pos")).alias("name"))


def edges(extracted: DataFrame) -> DataFrame:
    """``src, dst, weight, rel_type, chunk_id``: no blank ends, no loops, weights that aren't positive count as one."""
    raw = extracted.select("chunk_id", F.explode("edges").alias("e")).select("e.src", "e.dst", "e.weight", "e.rel_type", "chunk_id")
    return clean_edges(raw)


def clean_edges(raw: DataFrame) -> DataFrame:
    weight = F.when(F.coalesce("weight", F.lit(1.0)) <= 0, 1.0).otherwise(F.coalesce("weight", F.lit(1.0)))
    return raw.where("src <> '' and dst <> '' and src <> dst").withColumn("weight", weight).select("src", "dst", "weight", "rel_type", "chunk_id")


def mappings(extracted: DataFrame) -> DataFrame:
    return extracted.select("doc_id", "chunk_id", F.explode("entities").alias("e")).select("doc_id", F.col("e.id").alias("entity_id"), "chunk_id").distinct()


def doc_entities(chunk_docs: DataFrame, mapped: DataFrame, links: DataFrame) -> DataFrame:
    """``doc_id, entity_id, weight, chunk_id``: edge weights summed at both ends; an entity without an edge in the chunk weighs one.

    ``chunk_docs`` holds ``chunk_id, doc_id``; chunks that it doesn't know are dropped.
    """
    ends = links.select(F.col("src").alias("entity_id"), "weight", "chunk_id").unionByName(links.select(F.col("dst").alias("entity_id"), "weight", "chunk_id"))
    weighed = ends.join(chunk_docs, "chunk_id").groupBy("doc_id", "entity_id", "chunk_id").agg(F.sum("weight").alias("weight"))
    alone = mapped.select("entity_id", "chunk_id").join(chunk_docs, "chunk_id").select("doc_id", "entity_id", "chunk_id").distinct()
    alone = alone.join(weighed, ["doc_id", "entity_id", "chunk_id"], "left_anti").withColumn("weight", F.lit(1.0))
    return weighed.unionByName(alone).select("doc_id", "entity_id", "weight", "chunk_id")


def first_names(candidates: DataFrame, order: list[str]) -> DataFrame:
    """``id, name`` with the name that comes first in ``order``."""
    first = F.row_number().over(Window.partitionBy("id").orderBy(*order))
    return candidates.withColumn("__n", first).where("__n = 1").select("id", "name")
