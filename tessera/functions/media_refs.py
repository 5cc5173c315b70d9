"""Media references of a document row, as JSON text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import MEDIA_REFS


def encoded(refs: Column | str, ids: Column | str) -> Column:
    """Explicit references win, without their blob key; else one a non-empty id; null if there is none."""
    refs, ids = (F.col(c) if isinstance(c, str) else c for c in (refs, ids))
    explicit = F.transform(refs, lambda r: r.withField("blob_key", F.lit("")))
    plain = F.transform(F.filter(ids, lambda i: i.isNotNull() & (i != "")), lambda i: F.struct(i.alias("media_id")))
    return F.when(F.size(F.coalesce(refs, F.array())) > 0, F.to_json(explicit)).when(F.size(plain) > 0, F.to_json(plain))


def decoded(text: Column | str) -> Column:
    """References of an encoded column; null for null, empty, ``[]`` and text that is no JSON."""
    text = F.col(text) if isinstance(text, str) else text
    parsed = F.from_json(text, MEDIA_REFS)
    return F.when(F.coalesce(F.size(parsed), F.lit(0)) > 0, parsed)
