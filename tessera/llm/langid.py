"""Language identification by prediction by partial matching.

For each language a tree of byte contexts up to ``order`` bytes long is counted
on training texts and then frozen.  A byte's probability is its share in the
longest context that has seen it; each longer context that has not charges its
escape probability (method C: distinct successors over occurrences plus
distinct successors), and below the empty context every byte is 1/256.  A
text's code length under a language is the sum over its bytes, contexts
starting afresh at its first byte; the language with the shortest code wins.

Scoring looks up whole (order + 1)-byte grams in one table of exact costs per
language, so a byte costs one probe; grams that no training text has fall back
through the shorter contexts.  Fitting uses a bounded number of labelled
documents of each language; scoring reads every whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkit as tk

ORDER = 4
#: Training documents of each language at most, and bytes of each of them where there are enough such.
TRAIN_DOCS, TRAIN_BYTES = 300, 20_000
UNKNOWN = "und"


def _grams(raw: np.ndarray, offsets: np.ndarray, width: int) -> np.ndarray:
    """The last ``width`` bytes at each byte, as integers; with fewer before it in its row, -1."""
    key = np.zeros(len(raw), dtype=np.int64)
    for j in range(width):
        key[j:] += raw[: len(raw) - j].astype(np.int64) << (8 * j)
    for a in range(width - 1):
        at = offsets[:-1] + a
        key[at[at < offsets[1:]]] = -1
    return key


class Probe:
    """Positions of keys in a sorted array: one hashed probe, then binary search for what that misses."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(8, int(np.ceil(np.log2(len(keys) + 1))) + 3)
        self.slot = np.full(1 << self.bits, -1, dtype=np.int32)
        self.slot[self._spot(keys)] = np.arange(len(keys), dtype=np.int32)
        self.lost = np.flatnonzero(self.slot[self._spot(keys)] != np.arange(len(keys)))

    def _spot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1, dtype=np.int32)
        at = self.slot[self._spot(keys)]
        miss = np.flatnonzero((at >= 0) & (self.keys[at] != keys))
        if len(miss):
            pos = np.minimum(np.searchsorted(self.keys, keys[miss]), len(self.keys) - 1)
            at[miss] = np.where(self.keys[pos] == keys[miss], pos, -1)
        return at


@dataclass
class Model:
    """Frozen statistics.  By order: sorted grams with a cost in bits per language, sorted contexts with an escape cost."""

    languages: list[str]
    order: int
    grams: list[np.ndarray]
    costs: list[np.ndarray]
    contexts: list[np.ndarray]
    escapes: list[np.ndarray]

    def probes(self) -> None:
        if not hasattr(self, "by_gram"):
            self.by_gram = [Probe(k) for k in self.grams]
            self.by_context = [Probe(k) for k in self.contexts]

    def _cost(self, keys: np.ndarray, order: int) -> np.ndarray:
        """Bits of the last byte of each gram after the ``order`` bytes before it, by language."""
        if order < 0:
            return np.full((len(keys), len(self.languages)), 8.0)
        at = self.by_gram[order].find(keys)
        out = self.costs[order][at]
        miss = np.flatnonzero(at < 0)
        if len(miss):
            rest = keys[miss]
            below = self._cost(rest & ((1 << (8 * order)) - 1), order - 1)
            context = self.by_context[order].find(rest >> 8)
            out[miss] = below + np.where(context[:, None] >= 0, self.escapes[order][context], 0.0)
        return out

    def bits(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of each row under each language."""
        self.probes()
        total = np.zeros((len(raw) + 1, len(self.languages)))
        done = np.zeros(len(raw), dtype=bool)
        each = np.zeros((len(raw), len(self.languages)))
        for order in range(self.order, -1, -1):
            keys = _grams(raw, offsets, order + 1)
            now = np.flatnonzero((keys >= 0) & ~done) if order < self.order else np.flatnonzero(keys >= 0)
            each[now] = self._cost(keys[now], order)
            done[now] = True
            if order == self.order and done.all():
                break
        np.cumsum(each, axis=0, out=total[1:])
        return total[offsets[1:]] - total[offsets[:-1]]


def fit(texts: dict[str, list[bytes]], order: int = ORDER) -> Model:
    """Count the contexts of each language and freeze their costs."""
    languages = sorted(texts)
    width = len(languages)
    counts: list[list[tuple[np.ndarray, np.ndarray]]] = []
    for lang in languages:
        raw = np.frombuffer(b"".join(texts[lang]), dtype=np.uint8)
        offsets = np.r_[0, np.cumsum([len(x) for x in texts[lang]])].astype(np.int64)
        counts.append([])
        for k in range(order + 1):
            keys = _grams(raw, offsets, k + 1)
            counts[-1].append(np.unique(keys[keys >= 0], return_counts=True))
    model = Model(languages, order, [], [], [], [])
    for k in range(order + 1):
        grams = np.unique(np.concatenate([c[k][0] for c in counts]) if counts else np.zeros(0, np.int64))
        contexts = np.unique(grams >> 8)
        escape = np.zeros((len(contexts) + 1, width))  # the last row answers index -1
        cost = np.zeros((len(grams) + 1, width))
        below = np.full((len(grams), width), 8.0)
        if k:
            low = np.searchsorted(model.grams[k - 1], grams & ((1 << (8 * k)) - 1))
            below = model.costs[k - 1][low]  # a gram's suffix was counted with it
        for j in range(width):
            keys, n = counts[j][k]
            if not len(keys):
                cost[:-1, j] = below[:, j]
                continue
            own, first, kinds = np.unique(keys >> 8, return_index=True, return_counts=True)
            total = np.add.reduceat(n, first) + kinds
            at = np.searchsorted(contexts, own)
            escape[at, j] = np.log2(total / kinds)
            of = np.searchsorted(contexts, grams >> 8)
            cost[:-1, j] = below[:, j] + escape[of, j]
            share = np.log2(np.repeat(total, kinds) / n)
            cost[np.searchsorted(grams, keys), j] = share
        model.grams.append(grams)
        model.costs.append(cost)
        model.contexts.append(contexts)
        model.escapes.append(escape)
    return model


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", docs: int = TRAIN_DOCS, size: int = TRAIN_BYTES, order: int = ORDER) -> Model:
    """Fit on up to ``docs`` whole documents of each language, picked by a hash of their keys.

    Rows without text or language and empty ones are not used for fitting, repeated rows count once.  Texts over ``size``
    bytes, shortest first, stand in where a language has too few others; all of a language's texts have ``docs * size``
    bytes at most, but it has one text at least.
    """
    rows = labelled.where(F.col(lang).isNotNull() & (F.octet_length(text) > 0)).select(
        F.xxhash64(F.col(key)).alias("h"), F.xxhash64(F.col(text)).alias("th"), F.col(lang).cast("string").alias("l"), F.octet_length(text).cast("long").alias("b"), F.col(text).alias("t")
    )
    longer = F.when(F.col("b") > size, F.col("b")).otherwise(0)
    turn = Window.partitionBy("l").orderBy("o", "h", "th")
    distinct = rows.groupBy("l", "h", "th").agg(F.min("b").alias("b")).withColumn("o", longer)
    first = distinct.withColumn("r", F.row_number().over(turn)).where(F.col("r") <= docs)
    picked = first.withColumn("sum", F.sum("b").over(turn.rowsBetween(Window.unboundedPreceding, 0))).where((F.col("r") == 1) | (F.col("sum") <= docs * size)).select("l", "h", "th")
    # At most ``docs`` rows of each language: a bounded side.
    got = rows.join(F.broadcast(picked), ["l", "h", "th"], "left_semi").groupBy("l", "h", "th").agg(F.min("t").alias("t")).select("l", F.col("t").cast("binary").alias("t")).collect()
    texts: dict[str, list[bytes]] = {}
    for row in sorted(got):
        texts.setdefault(row.l, []).append(bytes(row.t))
    return fit(texts, order)


def _scorer(shared):
    def run(batches):
        model = shared.value
        limit = max(1 << 14, tk.SLICE_BYTES * 4 // max(4, len(model.languages)))
        for batch in batches:
            for a, b, raw, offsets in tk.slices(batch.column("text"), limit):
                n = b - a
                bits = model.bits(raw, offsets) if model.languages else np.zeros((n, 0))
                letters = batch.column("letters").slice(a, n).to_numpy(zero_copy_only=False).astype(bool)
                if model.languages:
                    best = np.argmin(bits, axis=1)
                    least = bits[np.arange(n), best]
                    score = 1.0 / np.exp2(np.clip(least[:, None] - bits, -1000, 0)).sum(axis=1)
                    names = np.array(model.languages, dtype=object)[best]
                else:
                    least, score, names = np.zeros(n), np.zeros(n), np.full(n, UNKNOWN, dtype=object)
                names[~letters] = UNKNOWN
                rate = least / np.maximum(np.diff(offsets), 1)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(i).slice(a, n) for i in range(batch.num_columns - 1)), pa.array(names.tolist(), pa.string()), pa.array(np.where(letters, score, 0.0)), pa.array(rate)],
                    names=[*batch.schema.names[:-1], "lang_pred", "score", "bits_per_byte"],
                )

    return run


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """All columns of ``docs`` (but those it adds) and ``lang_pred, score, bits_per_byte``.

    ``score`` is the winner's posterior under equal priors.  Null texts, empty ones and ones without a letter are
    ``und`` with score 0.  Ties go to the first language in order.  Repeated rows are scored alike.
    """
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    own = [c for c in docs.columns if c not in ("lang_pred", "score", "bits_per_byte")]
    fields = [docs.schema[c] for c in own]
    schema = StructType([*(StructField(f.name, f.dataType, True) for f in fields), StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("bits_per_byte", DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    inner = [F.col(c).alias(f"c{i}") for i, c in enumerate(own)]
    named = docs.select(*inner, F.col(text).alias("text"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("letters"))

    def run(batches):
        score = _scorer(shared)
        for batch in batches:
            for out in score([batch.select([*batch.schema.names[:-2], "text", "letters"])]):
                cols = [i for i, c in enumerate(out.schema.names) if c != "text"]
                yield out.select(cols)

    raw = StructType([*(StructField(f"c{i}", f.dataType, True) for i, f in enumerate(fields)), *schema.fields[-3:]])
    return named.mapInArrow(run, raw).toDF(*schema.names)
