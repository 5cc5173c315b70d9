"""String, id and path expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Languages by file extension.
LANGUAGES = {
    "go": ["go"], "javascript": ["js", "jsx", "mjs", "cjs"], "typescript": ["ts", "tsx"], "python": ["py"], "rust": ["rs"], "java": ["java"], "ruby": ["rb"], "php": ["php"],
    "c": ["c", "h"], "cpp": ["cc", "cpp", "cxx", "hpp"], "csharp": ["cs"], "swift": ["swift"], "kotlin": ["kt", "kts"], "markdown": ["md", "mdx"], "yaml": ["yaml", "yml"],
    "json": ["json"], "shell": ["sh", "bash", "zsh"],
}
BY_EXTENSION = {e: lang for lang, exts in LANGUAGES.items() for e in exts}


def base_name(path: Column | str) -> Column:
    return F.element_at(F.split(_col(path), "/"), -1)


def language(path: Column | str) -> Column:
    """By extension, else dockerfile by name, else the bare extension."""
    base = F.lower(base_name(path))
    ext = F.regexp_extract(base, r"\.([^.]*)$", 1)
    known = F.create_map(*(F.lit(x) for kv in BY_EXTENSION.items() for x in kv))
    return F.coalesce(F.get(F.array(known[ext]), F.lit(0)), F.when((base == "dockerfile") | base.startswith("dockerfile."), "dockerfile"), ext)


def glob_regex(pattern: str) -> str:
    """A path glob as a regular expression: ``**/`` any directories, ``**`` anything, ``*`` and ``?`` inside one name."""
    tokens = re.findall(r"\*\*/|\*\*|\*|\?|[^*?]+", pattern)
    forms = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    return "^" + "".join(forms.get(t) or re.sub(r"([^A-Za-z0-9_/ -])", r"\\\1", t) for t in tokens) + "$"


def matches_any(path: Column | str, patterns: list[str]) -> Column:
    """Whether a path matches one of the globs, as a whole, by its base name (patterns without a slash), or as ``dir/**``."""
    out = F.lit(False)
    for p in (p.strip().replace("\\", "/") for p in patterns):
        if not p:
            continue
        out = out | _col(path).rlike(glob_regex(p))
        if "/" not in p:
            out = out | base_name(path).rlike(glob_regex(p))
        if p.endswith("/**"):
            out = out | (_col(path) == p[:-3]) | _col(path).startswith(p[:-2])
    return out


def selected(path: Column | str, include: list[str], exclude: list[str]) -> Column:
    keep = matches_any(path, include) if include else F.lit(True)
    return keep & ~matches_any(path, exclude)


def secret_path(path: Column | str) -> Column:
    return F.lower(base_name(path)).rlike(r"^\.env$|^\.env\.|\.pem$|\.key$|credentials|secret")


def sanitised_token(text: Column | str) -> Column:
    """Slashes trimmed from the ends, and all but letters, digits and ``-_.`` as dashes."""
    return F.regexp_replace(F.regexp_replace(_col(text), "^/+|/+$", ""), "[^A-Za-z0-9._-]", "-")


def code_chunk_id(repo: Column, path: Column, start: Column, end: Column, file_hash: Column, text: Column) -> Column:
    whole = F.concat_ws("\u0000", repo, path, start.cast("string"), end.cast("string"), file_hash, text)
    name = F.right(sanitised_token(path), F.lit(80))
    return F.concat_ws("-", F.lit("code"), name, start.cast("string"), end.cast("string"), F.left(F.sha2(whole, 256), F.lit(16)))


def code_header(path: Column, lang: Column, symbol: Column, start: Column, end: Column, text: Column) -> Column:
    line = lambda name, v: F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"{name}: "), v, F.lit("\n"))).otherwise("")
    return F.concat(F.lit("path: "), path, F.lit("\n"), line("language", lang), line("symbol", symbol), F.format_string("lines: %d-%d\n\n", start, end), text)


def chunk_id(doc: Column | str, number: Column | str) -> Column:
    return F.format_string("%s-chunk-%03d", _col(doc), _col(number).cast("int"))


def page_id(document: Column | str, page: Column | str) -> Column:
    return F.format_string("%s-page-%d", _col(document), _col(page).cast("int"))


def timed_id(prefix: str, ms: Column | str, seed: Column | str, digits: int) -> Column:
    """``<prefix>_<13-digit milliseconds>_<hex>``: ids that sort by time."""
    return F.concat(F.lit(f"{prefix}_"), F.format_string("%013d", _col(ms).cast("long")), F.lit("_"), F.left(F.sha2(_col(seed).cast("string"), 256), F.lit(digits)))


def repo_id(remote_or_path: Column | str) -> Column:
    return F.left(F.sha2(_col(remote_or_path), 256), F.lit(16))


def kb_id_of_key(key: Column | str) -> Column:
    return F.concat(F.lit("code-"), F.regexp_replace(F.trim(_col(key)), "[^A-Za-z0-9._-]", "-"))


def safe_filename(name: Column | str) -> Column:
    """The base name without control characters, at most 255 bytes; null for a name with ``..`` or nothing left."""
    base = F.trim(F.regexp_replace(F.element_at(F.split(F.replace(_col(name), F.lit("\\"), F.lit("/")), "/"), -1), r"[\x00-\x1f\x7f]", ""))
    return F.when(~_col(name).contains("..") & (base != "") & (base != ".") & (F.octet_length(base) <= 255), base)


def content_type(declared: Column | str, name: Column | str) -> Column:
    """Lower-cased type without parameters; from the file's extension where none is declared."""
    given = F.lower(F.trim(F.get(F.split(F.coalesce(_col(declared), F.lit("")), ";"), F.lit(0))))
    ext = F.regexp_extract(F.lower(_col(name)), r"\.([^.]*)$", 1)
    guess = F.when(ext.isin("txt", "text", "log"), "text/plain").when(ext.isin("md", "markdown"), "text/markdown").when(ext == "pdf", "application/pdf").when(ext.isin("htm", "html"), "text/html").when(ext == "json", "application/json")
    return F.when(given != "", given).otherwise(F.coalesce(guess, F.lit("application/octet-stream")))


def content_bucket(c: Column | str) -> Column:
    c = _col(c)
    return F.when(c.startswith("text/"), "text").when(c.startswith("image/"), "image").when(c.startswith("audio/"), "audio").when(c.startswith("video/"), "video").when(c == "application/pdf", "pdf").otherwise("other")


def lines(text: Column | str) -> Column:
    """Trimmed lines that are not blank."""
    return F.filter(F.transform(F.split(F.replace(_col(text), F.lit("\r\n"), F.lit("\n")), "\n"), F.trim), lambda x: x != "")


def embeddable(text: Column | str) -> Column:
    return (F.octet_length(F.trim(_col(text))) >= 40) & _col(text).rlike("[A-Za-z]{4}")


def for_log(text: Column | str, limit: int = 100) -> Column:
    return F.when(F.length(_col(text)) > limit, F.concat(F.left(_col(text), F.lit(limit)), F.lit("..."))).otherwise(_col(text))


def page_token(value: Column | str) -> Column:
    """URL-safe base64 of a JSON position."""
    return F.translate(F.rtrim(F.base64(F.to_json(F.struct(_col(value).alias("after"))).cast("binary"))), "+/", "-_")


def page_position(token: Column | str) -> Column:
    return F.get_json_object(F.unbase64(F.translate(_col(token), "-_", "+/")).cast("string"), "$.after")


def binary_share(content: Column | str) -> Column:
    """Share of control bytes, from the hexadecimal form; 1 for content with a zero byte."""
    pairs = F.regexp_replace(F.hex(_col(content)), "(..)", "$1 ")
    n = F.greatest(F.octet_length(_col(content)), F.lit(1))
    return F.when(F.regexp_count(pairs, F.lit("00 ")) > 0, 1.0).otherwise(F.regexp_count(pairs, F.lit("(?:0[1-7BEF]|1[0-9A-F]) ")) / n)


def is_binary(content: Column | str) -> Column:
    """A zero byte, broken UTF-8, or over 30 % control bytes; a character cut off at the end of a sample doesn't count."""
    c = _col(content)
    whole = F.expr("null") if c is None else F.is_valid_utf8(c.cast("string"))
    cut = F.regexp_replace(F.right(F.hex(c), F.lit(8)), "^(?:(?:[0-7].)|(?:..))*?((?:[CDEF].)(?:[89AB].){0,2})$", "$1")
    tail = F.when(F.length(cut) < 8, F.length(cut) / 2).otherwise(0)
    head = F.unhex(F.left(F.hex(c), (F.octet_length(c) - tail).cast("int") * 2))
    valid = whole | ((F.octet_length(c) >= 8192) & F.is_valid_utf8(head.cast("string")))
    return (F.octet_length(c) > 0) & ((binary_share(c) > 0.30) | ~valid)
