"""Corpus preparation: chunks, embeddings, graphs from text, HTML, code; streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import code, embed, text
from ..operators import graphbuild
from ..sources import files
from ..streaming import pipeline
from .fixtures import Tables


def _documents(t: Tables):
    return t("documents").select(F.col("doc_id").cast("string").alias("id"), "text")


def _chunks(t: Tables):
    return text.chunks(_documents(t)).select("doc_id", "chunk_id", F.md5("text").alias("text_md5"), "start", "end")


def _spans(t: Tables):
    """Chunk totals by document, with how many are the exact bytes at their span."""
    cut = text.chunks(_documents(t))
    whole = _documents(t).select(F.col("id").alias("doc_id"), F.col("text").cast("binary").alias("b"))
    hit = cut.join(whole, "doc_id").withColumn("exact", F.substring("b", F.col("start") + 1, F.col("end") - F.col("start")) == F.col("text").cast("binary"))
    return hit.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.count_if("exact").alias("exact"), F.max(F.octet_length("text")).alias("largest"))


def _embedded(t: Tables):
    rows = embed.embedded(_documents(t).withColumnRenamed("text", "content"), embed.local(64), partitions=int(t.spark.conf.get("spark.sql.shuffle.partitions")))
    return rows.select("id", F.size("embedding").alias("dim"), F.round(F.element_at("embedding", 1).cast("double"), 6).alias("first"), "embed_error")


def _graph(t: Tables):
    found = graphbuild.extract(text.chunks(_documents(t)))
    return graphbuild.edges(found).groupBy("src", "dst").agg(F.count("*").alias("n"), F.sum("weight").alias("weight"))


def _html(t: Tables):
    return text.html_to_text(t("pages")).select("page_id", F.length("text").alias("n"), F.md5("text").alias("text_md5"))


def _code(t: Tables):
    body = F.regexp_replace(F.regexp_replace("text", r"\. ", ".\n"), r"(?m)^([A-Z]\w{2,9}) ", "def $1(\n")
    rows = t("documents").select(F.concat(F.lit("src/"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), F.md5("text").alias("hash"), F.lit("python").alias("language"), body.alias("text"))
    return code.chunked(rows, "repo").select("id", "path", "symbol", "kind", "start_line", "end_line")


def _requests(t: Tables):
    one = F.struct(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("text"))
    body = t("documents").select(F.to_json(F.struct(F.lit(" ").alias("kb_id"), F.array(one).alias("documents"))).alias("body"))
    return files.requests(body).select("kb_id", "id", F.md5("text").alias("text_md5"), "error")


def _conversations(t: Tables):
    turns = t("conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n").alias("text"))
    return text.chunks(turns, key="conv_id").groupBy("doc_id").agg(F.count("*").alias("chunks"), F.max(F.octet_length("text")).alias("largest"))


def _stream(t: Tables, name: str):
    folder = f"{t.dir}/{name}.parquet"
    return t.spark.readStream.schema(t(name).schema).parquet(folder if not folder.endswith(".parquet") or _is_folder(t, folder) else f"{t.dir}/{name}*.parquet")


def _is_folder(t: Tables, path: str) -> bool:
    p = t.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(t.spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory()


def _ran(t: Tables, frame, mode: str):
    """The rows of a stream run over what is there, written to the shared folder."""
    base = (t.spark.conf.get("spark.checkpoint.dir", None) or "/tmp/checkpoints").rstrip("/") + f"/streams/{uuid.uuid4().hex}"
    path, schema = f"{base}/rows", frame.schema

    def write(batch, _):
        batch.write.mode("append").parquet(path)

    frame.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return t.spark.read.schema(schema).parquet(path)


def _stream_dedup(t: Tables):
    rows = _stream(t, "events").select(F.col("event_id").cast("string").alias("event_id"), F.col("event_type").alias("kind"), F.lit("kb").alias("kb_id"), F.concat(F.lit("i"), (F.col("event_id") % 4000).cast("string")).alias("idempotency_key"), F.col("ts").alias("created_at"))
    return _ran(t, pipeline.deduplicated(rows), "append").groupBy("kind").agg(F.count("*").alias("n"))


def _stream_ingest(t: Tables):
    rows = _stream(t, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    return _ran(t, pipeline.embedded(pipeline.chunked(rows), embed.local(32)).select("id", F.size("embedding").alias("dim"), "embed_error"), "append")


QUERIES = {
    "text_chunks": (_chunks, None),
    "text_chunk_spans": (_spans, None),
    "local_embed": (_embedded, None),
    "graph_build_text": (_graph, None),
    "html_to_text": (_html, None),
    "code_chunks": (_code, None),
    "ingest_requests": (
        _requests,
        "SELECT 'default' AS kb_id, CAST(doc_id AS VARCHAR) AS id, md5(text) AS text_md5, CASE WHEN trim(coalesce(text, '')) = '' THEN 'empty text' END AS error FROM documents",
    ),
    "conversation_chunks": (_conversations, None),
    "stream_dedup": (_stream_dedup, "SELECT event_type AS kind, count(DISTINCT event_id % 4000) AS n FROM events GROUP BY 1"),
    "stream_ingest": (_stream_ingest, None),
}
