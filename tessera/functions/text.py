"""Text splitting on UTF-8 bytes, and HTML to text."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_SIZE = 500
#: Coarse to fine; a sentence keeps its full stop.
SEPARATORS = (b"\n\n", b"\n", b".", b" ")
#: White space that is trimmed: U+001C-U+001F are not.
_SPACE = "\t\n\v\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def trimmed(piece: bytes) -> bytes:
    return piece.decode("utf-8", "surrogateescape").strip(_SPACE).encode("utf-8", "surrogateescape")


def _characters(piece: bytes, size: int) -> Iterator[bytes]:
    """Runs of whole characters of up to ``size`` bytes."""
    a = 0
    while len(piece) - a > size:
        b = a + size
        while b > a and piece[b] & 0xC0 == 0x80:
            b -= 1
        if b == a:  # one character is larger than the size
            b = a + 1
            while b < len(piece) and piece[b] & 0xC0 == 0x80:
                b += 1
        yield piece[a:b]
        a = b
    if last := trimmed(piece[a:]):
        yield last


def pieces(text: bytes, size: int, level: int = 0) -> Iterator[bytes]:
    """Pieces of at most ``size`` bytes: parts between separators are packed as long as they fit, and cut finer where one doesn't."""
    text = trimmed(text)
    if not text:
        return
    if len(text) <= size:
        yield text
        return
    if level == len(SEPARATORS):
        yield from _characters(text, size)
        return
    mark = SEPARATORS[level]
    stop = mark if mark == b"." else b""
    glue = mark + b" " if stop else mark
    packed = b""
    for part in filter(None, map(trimmed, text.split(mark))):
        if packed and len(packed) + len(glue) + len(part) <= size:
            packed += glue + part
        else:
            if packed:
                yield from pieces(packed + stop, size, level + 1)
            packed = part
    yield from pieces(packed, size, level + 1)


def spans(source: bytes, parts: list[bytes]) -> Iterator[tuple[int, int]]:
    """Byte span of each piece: the next match after the last span, else the first match at all, else where the last span ended."""
    at = 0
    for p in parts:
        found = source.find(p, at)
        if found < 0:
            found = source.find(p)
        start = found if found >= 0 else at
        at = min(start + len(p), len(source))
        yield start, at


def split(text: str | None, size: int = DEFAULT_SIZE) -> list[tuple[int, str, int, int]]:
    """(number, text, start, end) of each chunk of a document."""
    source = (text or "").encode()
    parts = list(pieces(source, size if size > 0 else DEFAULT_SIZE))
    return [(i, p.decode("utf-8", "replace"), a, b) for i, (p, (a, b)) in enumerate(zip(parts, spans(source, parts), strict=True))]


def chunks(docs: DataFrame, size: int = DEFAULT_SIZE, key: str = "id", text: str = "text") -> DataFrame:
    """``doc_id, chunk_id, text, start, end`` of all documents; blank texts have none."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(d, f"{d}-chunk-{i:03d}", t, a, b) for d, whole in zip(pdf["id"], pdf["text"], strict=True) for i, t, a, b in split(whole, size)]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_id", "text", "start", "end"])

    rows = docs.select(F.col(key).cast("string").alias("id"), F.col(text).alias("text"))
    return rows.mapInPandas(run, "doc_id string, chunk_id string, text string, start int, end int")


def register_udtf(spark, name: str = "split_text") -> None:
    """A table function for SQL: ``SELECT * FROM docs, LATERAL split_text(id, text, 500)``."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="chunk_id string, text string, start int, end int")
    class SplitText:
        def eval(self, key: str, text: str, size: int):
            for i, t, a, b in split(text, size):
                yield f"{key}-chunk-{i:03d}", t, a, b

    spark.udtf.register(name, SplitText)


_SKIPPED = {"script", "style", "noscript"}
_BREAKING = {"p", "div", "br", "tr", "li", "h1", "h2", "h3", "h4", "h5", "h6"}


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in _SKIPPED
        if tag == "br" and not self.hidden:
            self.out.append("\n")

    def handle_endtag(self, tag):
        if tag in _SKIPPED:
            self.hidden = max(0, self.hidden - 1)
        elif tag in _BREAKING and tag != "br" and not self.hidden:
            self.out.append("\n")

    def handle_data(self, data):
        if not self.hidden and (t := data.strip(_SPACE)):
            self.out.append(t + " ")


def html_text(html: str | None) -> str:
    """Visible text: a line break after each block, runs of blanks as one."""
    import re

    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    whole = "".join(reader.out).replace("\r", "")
    return re.sub(r"\n +", "\n", re.sub(r"[ \t]+", " ", whole)).removeprefix(" ") if whole else ""


def html_to_text(pages: DataFrame, html: str = "html", name: str = "text") -> DataFrame:
    """``pages`` with a column of visible text."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(html_text)

    return pages.withColumn(name, run(html))
