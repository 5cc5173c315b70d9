"""Source files to chunks by symbol, and the file filters of an index."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import strings as S

CHUNK_SIZE, OVERLAP, MOST_LINES = 1500, 200, 2000
_NAME, _JS_NAME = r"[A-Za-z_]\w*", r"[A-Za-z_$][\w$]*"
#: By language: what opens a section, and its kind.
SYMBOLS = {
    "go": [(rf"func\s+(?:\([^)]*\)\s*)?({_NAME})\s*\(", "function"), (rf"type\s+({_NAME})[ \t]", "type")],
    "javascript": [
        (rf"(?:export default |export )?(?:async )?function\s+({_JS_NAME})\s*\(", "function"),
        (rf"(?:export default |export )?class\s+({_JS_NAME})(?=[\s({{:]|$)", "class"),
        (rf"(?:export default |export )?(?:const|let|var)\s+({_JS_NAME})\s*=", "function"),
    ],
    "python": [(rf"def\s+({_NAME})\s*\(", "function"), (rf"class\s+({_NAME})(?=[\s({{:]|$)", "class")],
    "rust": [(rf"(?:pub )?fn\s+({_NAME})\s*\(", "function"), (rf"(?:pub )?(?:struct|enum|trait)\s+({_NAME})(?=[\s({{:]|$)", "type")],
}
SYMBOLS["typescript"] = SYMBOLS["javascript"]


def symbol(line: str, lang: str | None) -> tuple[str, str] | None:
    """Name and kind of the symbol that a line opens."""
    for pattern, kind in SYMBOLS.get(lang or "", []):
        if m := re.match(pattern, line.strip()):
            return m[1], kind
    return None


def _size(line: str) -> int:
    return len(line.encode()) + 1


def _long_line(line: str, size: int, overlap: int) -> Iterator[str]:
    """Slices of a line at character boundaries, of up to ``size`` bytes, each beginning ``overlap`` bytes before the last ends."""
    raw, a = line.strip().encode(), 0
    step = size - overlap if size > overlap else size
    back = lambda i: next(j for j in range(i, -1, -1) if j >= len(raw) or raw[j] & 0xC0 != 0x80)
    while a < len(raw):
        b = back(min(a + size, len(raw)))
        if b <= a:
            b = len(raw)
        if text := raw[a:b].decode().strip():
            yield text
        if b >= len(raw):
            return
        a = max(back(a + step), a + 1) if back(a + step) > a else b


def _packed(lines: list[str], size: int, overlap: int) -> Iterator[tuple[int, int, str]]:
    """(first line, last line, text), from 1: whole lines up to the size, the next chunk repeating about ``overlap`` bytes."""
    a = 0
    while a < len(lines):
        if _size(lines[a]) > size:
            yield from ((a + 1, a + 1, t) for t in _long_line(lines[a], size, overlap))
            a += 1
            continue
        b, total = a, 0
        while b < len(lines) and (b == a or total + _size(lines[b]) <= size):
            total += _size(lines[b])
            b += 1
        if text := "\n".join(lines[a:b]).strip():
            yield a + 1, b, text
        if b >= len(lines):
            return
        again, kept = 0, 0
        while overlap > 0 and again < b - a and kept < overlap:
            again += 1
            kept += _size(lines[b - again])
        a = b - again if b - again > a else b


def code_chunks(text: str, lang: str | None, size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> list[tuple[str, str, str, int, int]]:
    """(text, symbol, kind, first line, last line).

    With symbols, a section runs from one to the next, and what stands before the first is left out; without any, or
    in long files, lines are packed as they come.
    """
    lines = text.strip().replace("\r\n", "\n").split("\n")
    marks = [(i, *s) for i, line in enumerate(lines) if (s := symbol(line, lang))]
    if not marks or len(lines) > MOST_LINES:
        return [(t, "", "", a, b) for a, b, t in _packed(lines, size, overlap)]
    out = []
    for (a, name, kind), b in zip(marks, [m[0] for m in marks[1:]] + [len(lines)], strict=True):
        section = lines[a:b]
        if sum(map(_size, section)) <= size:
            if whole := "\n".join(section).strip():
                out.append((whole, name, kind, a + 1, b))
        else:
            out += [(t, name, kind, a + x, a + y) for x, y, t in _packed(section, size, overlap)]
    return out


def chunked(files: DataFrame, repo: str = "", size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> DataFrame:
    """``id, path, hash, language, symbol, kind, start_line, end_line, text, content`` of ``files`` (``path, language, hash, text``)."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(p, h, g, *c) for p, h, g, t in zip(pdf["path"], pdf["hash"], pdf["language"], pdf["text"], strict=True) for c in code_chunks(t or "", g, size, overlap)]
            yield pd.DataFrame(rows, columns=["path", "hash", "language", "text", "symbol", "kind", "start_line", "end_line"])

    rows = files.select("path", "hash", "language", "text").mapInPandas(run, "path string, hash string, language string, text string, symbol string, kind string, start_line int, end_line int")
    c = {n: F.col(n) for n in rows.columns}
    name = S.code_chunk_id(F.lit(repo), c["path"], c["start_line"], c["end_line"], c["hash"], c["text"])
    return rows.withColumn("id", name).withColumn("content", S.code_header(c["path"], c["language"], c["symbol"], c["start_line"], c["end_line"], c["text"]))
