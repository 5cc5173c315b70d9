"""Bounded samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Bytes of the longest text that a classifier is fitted on; scoring knows no such bound.
TRAIN_BYTES = 200_000


def labelled(docs: DataFrame, labels: DataFrame, wanted: Column, limit: int, key: str = "doc_id", text: str = "text", max_bytes: int = TRAIN_BYTES) -> DataFrame:
    """``key, text`` and the columns of ``labels`` of up to ``limit`` labelled documents, picked by a hash of the key.

    ``wanted`` filters the labels.  Labels of a key without a document are dropped, and so are documents over
    ``max_bytes``; a key that stands in several rows of either table gives a row for each pair.
    """
    number = F.col(key) if labels.schema[key].dataType == StringType() else F.col(key).cast("long")
    picked = labels.where(wanted & F.col(key).isNotNull()).orderBy(F.xxhash64(number), key).limit(limit)
    texts = docs.select(key, text).where(F.octet_length(F.coalesce(F.col(text), F.lit(""))) <= max_bytes)
    return texts.join(F.broadcast(picked), key)  # at most ``limit`` rows
