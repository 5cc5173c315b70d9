"""Files as sources and sinks: texts, PDF pages, source trees, JSON lines, requests, uploads."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import strings as S
from ..functions import text as X
from ..schemas import DOCUMENT

CORPUS = "id string, text string"
#: Names of folders that an index never enters.
IGNORED = [".git/**", "**/.git/**", "node_modules/**", "**/node_modules/**", "vendor/**", "dist/**", "build/**", "target/**", "**/__pycache__/**"]
MOST_BYTES = 1 << 20
#: How much of the files a task holds before it passes them on.
READ_BYTES = 16 << 20


def texts(spark: SparkSession, path: str) -> DataFrame:
    """``path, page, text``: whole text files as one page each, trimmed; blank ones are left out."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.trim("value").alias("text"))
    return rows.where("text <> ''").select("path", F.lit(1).alias("page"), "text")


def binaries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def pdf_pages(content: bytes) -> list[tuple[int, str]]:
    """(number, text) of the pages that have text; needs a PDF library."""
    import io

    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise RuntimeError("reading PDF needs the pypdf package") from e
    pages = ((i, (p.extract_text() or "").strip()) for i, p in enumerate(PdfReader(io.BytesIO(content)).pages, 1))
    return [(i, t) for i, t in pages if t]


def pages(files: DataFrame) -> DataFrame:
    """``name, page, text, status, error`` of uploaded files (``name, content_type, content``): each file succeeds or fails alone."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for name, kind, content in zip(pdf["name"], pdf["content_type"], pdf["content"], strict=True):
                try:
                    if kind == "application/pdf":
                        got = pdf_pages(bytes(content))
                    elif kind == "text/html":
                        got = [(1, X.html_text(bytes(content).decode("utf-8", "replace")).strip())]
                    elif str(kind).startswith("text/") or kind == "application/json":
                        got = [(1, bytes(content).decode("utf-8").strip())]
                    else:
                        raise ValueError(f"unsupported content type {kind}")
                    got = [(i, t) for i, t in got if t]
                    if not got:
                        raise ValueError("no text")
                    rows += [(name, i, t, "succeeded", None) for i, t in got]
                except Exception as e:
                    rows.append((name, None, None, "failed", str(e)))
            yield pd.DataFrame({k: pd.Series([r[i] for r in rows], dtype=t) for i, (k, t) in enumerate([("name", "object"), ("page", "Int32"), ("text", "object"), ("status", "object"), ("error", "object")])})

    kinds = files.select("name", S.content_type("content_type", "name").alias("content_type"), "content")
    return kinds.mapInPandas(run, "name string, page int, text string, status string, error string")


def page_chunks(found: DataFrame, size: int = X.DEFAULT_SIZE) -> DataFrame:
    """Chunks of pages with a locator: page, and byte range in it."""
    rows = found.where("status = 'succeeded'").select(S.page_id("name", "page").alias("id"), "page", "text")
    cut = X.chunks(rows, size).join(rows.select(F.col("id").alias("doc_id"), "page"), "doc_id")
    return cut.withColumn("locator", F.struct("page", F.col("start").cast("long").alias("byte_start"), F.col("end").cast("long").alias("byte_end")))


def successful(found: DataFrame) -> DataFrame:
    return found.groupBy("name").agg(F.min(F.col("status") == "succeeded").alias("ok")).agg(F.count_if("ok").alias("succeeded"), F.count("*").alias("files"))


def _tree(root: str):
    """The file system of a tree and the tree's path in it."""
    from pyarrow import fs

    if not re.match(r"[a-z][a-z0-9+.-]+:", root):
        return fs.LocalFileSystem(), root.rstrip("/")
    found, base = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", re.sub(r"^s3[an]:", "s3:", root)))
    return found, base.rstrip("/")


def listed(spark: SparkSession, root: str) -> DataFrame:
    """``path, size_bytes`` of all files below ``root``, hidden and empty ones too, which Spark's own readers pass over."""
    from pyarrow import fs

    system, base = _tree(root)
    rows = [(i.path[len(base) + 1 :], i.size) for i in system.get_file_info(fs.FileSelector(base, recursive=True)) if i.type == fs.FileType.File]
    return spark.createDataFrame(rows, "path string, size_bytes long")


def source_tree(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None, only: DataFrame | None = None) -> DataFrame:
    """``path, hash, size_bytes, language, text`` of the source files of a tree: no secrets, no binaries, nothing over the size limit.

    The driver lists names; files are opened in the tasks, and only those that the names, and the paths of ``only``,
    let through.  A file that is gone by then is left out.
    """
    names = listed(spark, root)
    names = names.where(F.col("size_bytes") <= MOST_BYTES).where(S.selected("path", include or [], [*IGNORED, *(exclude or [])]) & ~S.secret_path("path")).select("path")
    if only is not None:
        names = names.join(only.select("path"), "path", "left_semi")

    def read(batches):
        import pandas as pd

        system, base = _tree(root)
        for pdf in batches:
            rows: list[tuple[str, bytes]] = []
            held = 0
            for path in pdf["path"]:
                try:
                    with system.open_input_stream(f"{base}/{path}") as f:
                        rows.append((path, f.read()))
                except FileNotFoundError:
                    continue
                held += len(rows[-1][1])
                if held > READ_BYTES:
                    yield pd.DataFrame(rows, columns=["path", "content"])
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=["path", "content"])

    found = names.mapInPandas(read, "path string, content binary").where(~S.is_binary("content"))
    return found.select("path", F.sha2("content", 256).alias("hash"), F.octet_length("content").cast("long").alias("size_bytes"), S.language("path").alias("language"), F.decode("content", "UTF-8").alias("text"))


def write_corpus(docs: DataFrame, path: str) -> None:
    docs.select("id", "text").write.mode("overwrite").json(path)


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A JSON-lines corpus; lines without a text are left out."""
    return spark.read.schema(CORPUS).json(path).where("coalesce(text, '') <> ''")


def requests(rows: DataFrame, body: str = "body") -> DataFrame:
    """Documents of ingest requests: JSON ``{"kb_id", "documents": [{"id", "text", ...}]}``; requests without documents say so."""
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("kb_id", T.StringType()), T.StructField("documents", T.ArrayType(DOCUMENT))])
    parsed = rows.withColumn("r", F.from_json(body, schema))
    kb = F.when(F.trim(F.coalesce("r.kb_id", F.lit(""))) == "", "default").otherwise(F.trim("r.kb_id"))
    out = parsed.select(*rows.columns, kb.alias("kb_id"), F.explode_outer("r.documents").alias("d"))
    error = F.when(F.col("d").isNull(), "no documents").when(F.trim(F.coalesce("d.id", F.lit(""))) == "", "empty id").when(F.trim(F.coalesce("d.text", F.lit(""))) == "", "empty text")
    return out.select(*rows.columns, "kb_id", "d.*", error.alias("error"))


def routed(content_type: Column | str) -> Column:
    """Which reader takes a content type."""
    c = F.col(content_type) if isinstance(content_type, str) else content_type
    return F.when(c == "application/pdf", "pdf").when(c == "text/html", "html").when(c.startswith("text/") | (c == "application/json"), "text").otherwise("unsupported")
