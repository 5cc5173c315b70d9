"""N-gram Jaccard self-join of documents by PartEnum signatures.

A document is its set of distinct word shingles.  Sets fall in size bands no
wider than the similarity threshold, so two similar sets lie in the same or in
neighbouring bands.  At a band's level the threshold bounds how many shingles
two sets can differ in, ``k``.  The hashed shingle domain is cut in ranges, and a
range in parts; a signature is the subset of a set in all parts of a range but
``inner``, for each choice of those.  At most ``bad = k // (inner + 1)`` ranges hold
more than ``inner`` differences, and in every other one some choice leaves out all
that differ: so of more than ``bad`` ranges similar sets share signatures in the
rest.  With ``inner`` 0, the default, a range is one signature: at
word-shingle sizes that gives the fewest for their selectivity.

Empty subsets are no signature as long as a set has more than ``bad`` ranges with
elements in more than ``inner`` parts, for in the surplus it is sure to share one
that is not empty; a set with fewer emits its empty subsets too, so no pair is lost.

Signatures travel as compressed sorted arrays, grouped by a hash range.  Small
groups give their pairs, which the number of signatures that similar sets are sure
to share, their sizes and then parity sketches (whose distance never exceeds
the true one) rule out unless they are similar, but for a few.  One candidate link a
document is verified on the exact sets first, then every one that still crosses
two components.  Groups of more than ``small_group`` sets matter only to sets
that have so many signatures in such groups that a similar set could share no
other; they are searched last, in bounded blocks, for links between components.
Exact copies are one class from the start.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import blobs
from . import textkit as tk
from .common import drop_table, release, shuffle_partitions, stored
from .components import components

WIDTH, PERCENT = 5, 75
#: Differences that a signature leaves room for inside a range, and the parts of a range.
INNER, PARTS = 0, 3
#: Ranges per possible difference.  More ranges are smaller signatures, fewer leave too little slack for empty ones.
SLACK = 1.4
SMALL_GROUP, BLOCK = 16, 2048
#: Signatures that a task holds before it sends them off, and about how many shingles give a hash range's signatures.
FLUSH, BUCKET = 1 << 19, 1 << 20
SET_BITS = 48


def bands(percent: int = PERCENT, top: int = 1 << 40) -> np.ndarray:
    """First size of each band; a set similar to the smallest of a band is at most as large as its largest."""
    out = [1]
    while out[-1] < top:
        out.append(out[-1] * 100 // percent + 1)
    return np.array(out, dtype=np.int64)


def differences(size_sum: int | np.ndarray, percent: int = PERCENT):
    """The most elements two sets of that total size may differ in."""
    return size_sum * (100 - percent) // (100 + percent)


def _levels(grams: np.ndarray, bounds: np.ndarray, percent: int, slack: float, inner: int, parts: int):
    """For a set's own level and the next: level, ``bad`` ranges and ranges of each set; row, range and part of each element; first elements of the filled ranges; how many ranges a set has in more than ``inner`` parts."""
    first = bands(percent)
    sizes = np.diff(bounds)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    high = grams >> np.uint64(32)
    for up in (0, 1):
        level = np.searchsorted(first, sizes, side="right") - 1 + up
        bad = differences(2 * (first[level + 1] - 1), percent) // (inner + 1)
        ranges = np.where(bad == 0, 1, np.ceil(bad * slack).astype(np.int64) + 1)
        spot = high * ranges[rows].astype(np.uint64)
        of, part = (spot >> np.uint64(32)).astype(np.int64), ((spot & np.uint64(0xFFFFFFFF)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        new = np.ones(len(rows), dtype=bool)
        new[1:] = (rows[1:] != rows[:-1]) | (of[1:] != of[:-1])
        at = np.flatnonzero(new)
        if inner:
            kinds = np.ones(len(rows), dtype=np.int64)
            kinds[1:] = new[1:] | (part[1:] != part[:-1])
            wide = (np.add.reduceat(kinds, at) if len(at) else kinds) > inner
        else:
            wide = np.ones(len(at), dtype=bool)
        yield level, bad, ranges, rows, of, part, at, np.bincount(rows[at[wide]], minlength=len(level))


def signatures(
    grams: np.ndarray, bounds: np.ndarray, percent: int = PERCENT, slack: float = SLACK, inner: int = INNER, parts: int = PARTS
) -> tuple[np.ndarray, np.ndarray]:
    """(signature, row) of each sorted set ``grams[bounds[i]:bounds[i+1]]``; the last bit of a signature is its level's."""
    if not len(grams):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    mixed = tk.mix(grams ^ np.uint64(0x5851F42D4C957F2D))
    got, of = [], []
    one = np.uint64(1)
    left_out = list(itertools.combinations(range(parts), inner))
    name = lambda p, choice, lv: tk.mix((p * len(left_out) + choice).astype(np.uint64) * np.uint64(131) + lv.astype(np.uint64) + np.uint64(1 << 60))
    for level, bad, ranges, rows, place, part, at, wide in _levels(grams, bounds, percent, slack, inner, parts):
        bit = level.astype(np.uint64) & one
        short = np.flatnonzero((np.diff(bounds) > 0) & (wide <= bad))
        for choice, out in enumerate(left_out):
            keep = ~np.isin(part, out) if out else None
            sums = np.add.reduceat(mixed if keep is None else np.where(keep, mixed, np.uint64(0)), at)
            full = at if keep is None else at[np.add.reduceat(keep.astype(np.int64), at) > 0]
            sums = sums if keep is None else sums[np.isin(at, full)]
            sig = tk.mix(sums + name(place[full], choice, level[rows[full]]))
            got.append((sig & ~one) | bit[rows[full]])
            of.append(rows[full])
            starts = np.searchsorted(rows[full], np.arange(len(level) + 1))
            for r in short:
                empty = np.setdiff1d(np.arange(ranges[r]), place[full[starts[r] : starts[r + 1]]])
                got.append((tk.mix(name(empty, choice, np.full(len(empty), level[r]))) & ~one) | bit[r])
                of.append(np.full(len(empty), r))
    return np.concatenate(got), np.concatenate(of)


def sure(grams: np.ndarray, bounds: np.ndarray, percent: int = PERCENT, slack: float = SLACK, inner: int = INNER, parts: int = PARTS) -> np.ndarray:
    """How many signatures a set shares at least with any similar one, [row, last bit of the level].

    A set that emits its empty subsets is sure of one only: the other set may not emit them.
    """
    out = np.zeros((len(bounds) - 1, 2), dtype=np.int64)
    for level, bad, *_, wide in _levels(grams, bounds, percent, slack, inner, parts):
        out[np.arange(len(out)), level & 1] = np.maximum(wide - bad, 1)
    return out


def sketch(grams: np.ndarray) -> np.ndarray:
    """Parity of the elements by hashed position as 64-bit words, two positions an element at least (eight in small sets); a power of two of bits."""
    bits = 128
    while bits < (8 if len(grams) <= 256 else 2) * len(grams):
        bits *= 2
    parity = np.bincount((tk.mix(grams + np.uint64(7)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").view(np.int64)


def folded(words: np.ndarray, size: int) -> np.ndarray:
    """A sketch as one of ``size`` words: halves are folded onto each other."""
    while len(words) > size:
        words = words[: len(words) // 2] ^ words[len(words) // 2 :]
    return words


def _similar_in_size(percent: int) -> Column:
    return F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent


def _may_match(percent: int) -> Column:
    """Whether sketches leave room for the similarity.  Those of sets similar in size are of one size or one is twice the other."""

    def halved(words: Column) -> Column:
        half = (F.size(words) / 2).cast("int")
        return F.zip_with(F.slice(words, F.lit(1), half), F.slice(words, half + 1, half), lambda x, y: x.bitwiseXOR(y))

    a, b = F.col("sketch_a"), F.col("sketch_b")
    fit = lambda x, y: F.when(F.size(x) == 2 * F.size(y), halved(x)).otherwise(x)
    far = F.aggregate(F.zip_with(fit(a, b), fit(b, a), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    room = F.floor((F.col("n_a") + F.col("n_b")) * (100 - percent) / (100 + percent))
    return (F.greatest(F.size(a), F.size(b)) > 2 * F.least(F.size(a), F.size(b))) | (far <= room)


def _sets(batches, width: int) -> Iterator[tuple[pa.RecordBatch, int, int, np.ndarray, np.ndarray]]:
    for batch in batches:
        for a, b, raw, offsets in tk.slices(batch.column("text")):
            word, first = tk.words(raw, offsets)
            yield batch, a, b, *tk.shingles(word, first, width)


def _class_ids(grams: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each whole set."""
    sums = np.zeros(len(grams) + 1, dtype=np.uint64)
    np.cumsum(tk.mix(grams + np.uint64(0x1234567)), out=sums[1:])
    return tk.mix(sums[bounds[1:]] - sums[bounds[:-1]] + tk.mix(np.diff(bounds).astype(np.uint64))).view(np.int64)


def _rows(width: int, percent: int, inner: int):
    def run(batches):
        for batch, a, b, grams, bounds in _sets(batches, width):
            sketches = [sketch(grams[bounds[i] : bounds[i + 1]]) for i in range(b - a)]
            sketches = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in sketches])], pa.int32()), pa.array(np.concatenate(sketches), pa.int64()))
            least = sure(grams, bounds, percent, inner=inner)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc").slice(a, b - a), pa.array(np.diff(bounds)), pa.array(_class_ids(grams, bounds)), sketches, pa.array(least[:, 0]), pa.array(least[:, 1])],
                names=["doc", "n", "cls", "sketch", "sure0", "sure1"],
            )

    return run


def _signature_blobs(width: int, percent: int, inner: int, buckets: int):
    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []
        seen: set[int] = set()

        def flush():
            sigs, cls = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(sigs)
            sigs, cls = sigs[order], cls[order]
            bucket = ((sigs >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            edges = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
            full = np.flatnonzero(np.diff(edges))
            out = []
            for i in full:
                names, at = np.unique(cls[edges[i] : edges[i + 1]], return_inverse=True)
                out.append((blobs.pack_sorted(sigs[edges[i] : edges[i + 1]]), blobs.pack(at.astype(np.uint32)), blobs.pack_sorted(names)))
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *(pa.array(x, pa.binary()) for x in zip(*out, strict=True))], names=["bucket", "sigs", "at", "names"])
            held.clear()
            seen.clear()

        for _, _, _, grams, bounds in _sets(batches, width):
            ids = _class_ids(grams, bounds)
            keep = np.array([not (i in seen or seen.add(i)) for i in ids.tolist()], dtype=bool)
            sigs, rows = signatures(grams, bounds, percent, inner=inner)
            fresh = keep[rows]
            held.append((sigs[fresh], ids[rows[fresh]]))
            if sum(len(x[0]) for x in held) >= FLUSH:
                yield from flush()
        if held and sum(len(x[0]) for x in held):
            yield from flush()

    return run


def _groups(small_group: int):
    """From the signatures of one hash range: pairs of small groups with how many they share, and members of large groups."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sigs = np.concatenate([blobs.unpack_sorted(x) for x in pdf["sigs"]])
        cls = np.concatenate([blobs.unpack_sorted(n, np.int64)[blobs.unpack(a, np.uint32)] for n, a in zip(pdf["names"], pdf["at"], strict=True)])
        order = np.lexsort((cls, sigs))
        sigs, cls = sigs[order], cls[order]
        new = np.ones(len(sigs), dtype=bool)
        new[1:] = (sigs[1:] != sigs[:-1]) | (cls[1:] != cls[:-1])
        sigs, cls = sigs[new], cls[new]
        start = np.flatnonzero(np.r_[True, sigs[1:] != sigs[:-1]])
        size = np.diff(np.r_[start, len(sigs)])
        keep = np.repeat((size > 1) & (size <= small_group), size)
        s, c = sigs[keep], cls[keep]
        left, right, bit = [], [], []
        for d in range(1, small_group):
            same = np.flatnonzero(s[d:] == s[:-d]) if len(s) > d else np.zeros(0, np.int64)
            if not len(same):
                break
            left.append(c[same])
            right.append(c[same + d])
            bit.append((s[same] & np.uint64(1)).astype(np.int64))
        a, b, e = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (left, right, bit))
        order = np.lexsort((e, b, a))
        a, b, e = a[order], b[order], e[order]
        new = np.ones(len(a), dtype=bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (e[1:] != e[:-1])
        shared = np.diff(np.r_[np.flatnonzero(new), len(a)]) if len(a) else np.zeros(0, np.int64)
        pairs = pd.DataFrame({"sig": np.zeros(new.sum(), np.int64), "bit": e[new].astype(np.int32), "a": a[new], "b": b[new], "shared": shared})
        hot = np.repeat(size > small_group, size)
        members = pd.DataFrame({"sig": sigs[hot].view(np.int64), "bit": (sigs[hot] & np.uint64(1)).astype(np.int32), "a": cls[hot], "b": 0, "shared": 0})
        return pd.concat([pairs, members], ignore_index=True)

    return run


#: 64-bit words of sketches compared at once.
AT_ONCE = 1 << 19


def _large(percent: int, every: bool):
    """Pairs of one block pair between two components that sketches can't rule out.

    ``every`` or few: all of them.  Else a spanning forest of them, the closest first, and ``task`` says that there are more.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n, cls, rep = (pdf[c].to_numpy() for c in ("n", "cls", "rep"))
        order = np.lexsort((cls, n))
        n, cls, rep, part = n[order], cls[order], rep[order], np.unique(pdf["part"], return_inverse=True)[1][order]
        sketches = pdf["sketch"].to_numpy()[order]
        size = min(map(len, sketches))
        m = np.array([folded(x, size) for x in sketches]).view(np.uint64)
        top = np.searchsorted(n, n * 100 // percent, side="right")
        found, a, rows = [], 0, max(1, AT_ONCE // (len(n) * m.shape[1]))
        while a < len(n) - 1:
            b = min(a + rows, len(n) - 1)
            i = np.repeat(np.arange(a, b), np.maximum(top[a:b] - np.arange(a, b) - 1, 0))
            j = np.concatenate([np.arange(x + 1, max(top[x], x + 1)) for x in range(a, b)])
            cross = part[i] != part[j]
            i, j = i[cross], j[cross]
            far = np.bitwise_count(m[i] ^ m[j]).sum(axis=1, dtype=np.int64)
            close = far <= differences(n[i] + n[j], percent)
            found.append((i[close], j[close], far[close] / (n[i] + n[j])[close]))
            a = b
        i, j, gap = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
        more = not every and len(i) > 2 * len(n)
        if more:
            root, kept = np.arange(part.max() + 1), []
            for at in np.argsort(gap, kind="stable").tolist():
                x, y = root[part[i[at]]], root[part[j[at]]]
                if x != y:
                    root[root == y] = x
                    kept.append(at)
            i, j = i[kept], j[kept]
        return pd.DataFrame({"a": cls[i], "b": cls[j], "rep_a": rep[i], "rep_b": rep[j], "task": np.full(len(i), pdf["task"].iloc[0] if more else 0)})

    return run


def _wanted_sets(width: int, bitmap):
    """Sets of the documents whose key is, or may be, wanted."""

    def run(batches):
        bits = bitmap.value
        for batch in batches:
            at = batch.column("spot").to_numpy()
            batch = batch.filter(pa.array((bits[at >> 3] >> (at & 7)) & 1, pa.uint8()).cast(pa.bool_()))
            for part, a, b, grams, bounds in _sets([batch], width):
                short = grams >> np.uint64(64 - SET_BITS)
                packed = [blobs.pack_sorted(short[bounds[i] : bounds[i + 1]]) for i in range(b - a)]
                yield pa.RecordBatch.from_arrays([part.column("doc").slice(a, b - a), pa.array(_class_ids(grams, bounds)), pa.array(packed, pa.binary())], names=["rep", "cls", "grams"])

    return run


def _verify(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            left, right = batch.column("g_a"), batch.column("g_b")
            for i in range(batch.num_rows):
                x, y = blobs.unpack_sorted(left[i].as_py()), blobs.unpack_sorted(right[i].as_py())
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


#: Bits of the filter that spares documents outside any candidate pair their second reading; a full filter only spares fewer.
FILTER_BITS = 1 << 23


def _sets_of(source: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``rep, grams``: the packed sets of the documents named in ``wanted``; only their sets are shuffled, no text."""
    spark = source.sparkSession
    wanted = stored(wanted, "wanted")
    spot = lambda name: F.pmod(F.xxhash64(name), F.lit(FILTER_BITS))
    # The filter has a fixed size, whatever the input.  Bucket numbers and positions count from 1.
    maps = wanted.select((spot("rep") + 1).alias("x")).groupBy(F.bitmap_bucket_number("x").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("x")).alias("m")).collect()
    bits = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for k, m in maps:
        bits[(k - 1) * 4096 : k * 4096] |= np.frombuffer(m, dtype=np.uint8)
    shared = spark.sparkContext.broadcast(bits)
    sets = source.where("doc is not null").withColumn("spot", spot("doc")).mapInArrow(_wanted_sets(width, shared), "rep long, cls long, grams binary")
    return stored(sets.join(wanted, ["rep", "cls"], "left_semi").groupBy("rep", "cls").agg(F.min("grams").alias("grams")), "sets")


def _in_blocks(members: DataFrame, block: int) -> DataFrame:
    """``task, cls``: members of each group of two and more, by pairs of blocks of at most ``block`` members."""
    place = F.row_number().over(Window.partitionBy("sig").orderBy("cls")) - 1
    sizes = members.groupBy("sig").agg(F.count("*").alias("size")).where("size > 1")
    placed = members.withColumn("at", F.floor(place / block)).join(sizes, "sig").withColumn("blocks", F.ceil(F.col("size") / block))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other")
    both = placed.select("sig", "cls", "at", other)
    return both.select(F.xxhash64("sig", F.least("at", "other"), F.greatest("at", "other")).alias("task"), "cls")


def near_duplicates(
    docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, percent: int = PERCENT, small_group: int = SMALL_GROUP, block: int = BLOCK, inner: int = INNER
) -> DataFrame:
    """``key, n_shingles, class_id, component_id`` of each row of ``docs``.

    Two rows link when their shingle sets have a Jaccard similarity of ``percent`` or more; ``component_id`` is
    the smallest key reachable by links, the row's own included.  Null and empty texts have an empty set, no
    class and are linked with nothing.  Rows with one key and several texts each take the component of their own
    text; a row without a key takes its class's component (null if no row of it has a key).  An empty
    table gives no rows.  Keys are integers, or text of integers.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).alias("text"))
    rows = stored(source.mapInArrow(_rows(width, percent, inner), "doc long, n long, cls long, sketch array<long>, sure0 long, sure1 long"), "shingle-rows")
    named = rows.where("n > 0 and doc is not null")
    buckets = max(2 * shuffle_partitions(spark), (named.agg(F.sum("n")).first()[0] or 0) // BUCKET)
    classes = named.groupBy("cls").agg(F.min(F.struct("doc", "n", "sketch", "sure0", "sure1")).alias("r")).select("cls", F.col("r.doc").alias("rep"), "r.n", "r.sketch", "r.sure0", "r.sure1")
    sent = source.where("doc is not null").mapInArrow(_signature_blobs(width, percent, inner, buckets), "bucket int, sigs binary, at binary, names binary")
    found = stored(sent.groupBy("bucket").applyInPandas(_groups(small_group), "sig long, bit int, a long, b long, shared long"), "candidates")
    # What a set shares with a similar one can't all be in large groups if it has fewer signatures there than they are sure to share.
    large = found.where("shared = 0")
    hot = large.groupBy("a").agg(F.count_if(F.col("bit") == 0).alias("hot0"), F.count_if(F.col("bit") == 1).alias("hot1")).withColumnRenamed("a", "cls")
    classes = classes.join(hot, "cls", "left").fillna(0, ["hot0", "hot1"])
    classes = stored(classes.select("cls", "rep", "n", "sketch", *((F.col(f"sure{i}") - F.col(f"hot{i}")).alias(f"need{i}") for i in (0, 1))), "shingle-classes")

    def side(x: str, *columns: str) -> DataFrame:
        return classes.select(F.col("cls").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in columns))

    # Numbers rule out most pairs; only the others meet their sketches.
    pairs = found.where("shared > 0").groupBy("a", "b").agg(*(F.sum(F.when(F.col("bit") == i, F.col("shared")).otherwise(0)).alias(f"shared{i}") for i in (0, 1)))
    enough = [(F.col(f"shared{i}") > 0) & (F.col(f"shared{i}") >= F.greatest(f"need{i}_a", f"need{i}_b")) for i in (0, 1)]
    numbers = ("n", "rep", "need0", "need1")
    pairs = pairs.join(side("a", *numbers), "a").join(side("b", *numbers), "b").where((enough[0] | enough[1]) & _similar_in_size(percent))
    own = classes.select(F.col("cls").alias("a"), "need0", "need1")
    members = large.join(own, "a").where(F.when(F.col("bit") == 0, F.col("need0")).otherwise(F.col("need1")) <= 0)
    members = stored(members.select("sig", F.col("a").alias("cls")), "members")
    leader = members.groupBy("sig").agg(F.min("cls").alias("a"))
    stars = members.join(leader, "sig").select("a", F.col("cls").alias("b")).where("a <> b").distinct()
    stars = stars.join(side("a", "n", "rep"), "a").join(side("b", "n", "rep"), "b").where(_similar_in_size(percent))
    wide, pair = ["a", "b", "rep_a", "rep_b", "n_a", "n_b"], "a long, b long, rep_a long, rep_b long"
    pairs = pairs.select(*wide).unionByName(stars.select(*wide)).join(side("b", "sketch"), "b").join(side("a", "sketch"), "a")
    pairs = stored(pairs.where(_may_match(percent)).select(*wide[:4]), "pairs")
    drop_table(spark, found)
    release(spark)

    def ends(some: DataFrame) -> DataFrame:
        return some.select(F.col("a").alias("cls"), F.col("rep_a").alias("rep")).union(some.select("b", "rep_b")).distinct()

    def verified(some: DataFrame, sets: DataFrame) -> DataFrame:
        """Links between representatives."""
        g_a, g_b = (sets.select(F.col("cls").alias(x), F.col("grams").alias(f"g_{x}")) for x in "ab")
        both = some.join(g_b, "b").join(g_a, "a").select(F.col("rep_a").alias("a"), F.col("rep_b").alias("b"), "g_a", "g_b")
        return stored(both.mapInArrow(_verify(percent), "a long, b long"), "edges")

    def joined(df: DataFrame, column: str, groups: DataFrame) -> DataFrame:
        """``df`` with the component of one of its columns."""
        named = groups.select(F.col("node").alias(column), F.col("component").alias(f"part_{column}"))
        return df.join(named, column, "left").withColumn(f"part_{column}", F.coalesce(f"part_{column}", column))

    # First one link a document, then all that still cross two components, then large groups in the same two steps.
    sets = _sets_of(source, ends(pairs), width)
    edges = verified(pairs.groupBy("b").agg(F.min(F.struct("a", "rep_a", "rep_b")).alias("x")).select("b", "x.*"), sets)
    group = stored(components(edges), "groups")
    crossing = joined(joined(pairs, "rep_a", group), "rep_b", group).where("part_rep_a <> part_rep_b").select("a", "b", "rep_a", "rep_b").distinct()
    more = verified(crossing, sets)
    if not more.isEmpty():
        edges = edges.unionByName(more)
        group = stored(components(edges), "groups")
    if not members.isEmpty():
        blocks = stored(_in_blocks(members, block), "members").join(classes.select("cls", "rep", "n", "sketch"), "cls")
        chosen = None
        for every in (False, True):
            inside = joined(blocks if chosen is None else blocks.join(chosen, "task", "left_semi"), "rep", group).withColumnRenamed("part_rep", "part")
            unsettled = inside.groupBy("task").agg(F.min("part").alias("x"), F.max("part").alias("y")).where("x <> y").select("task")
            inside = inside.join(unsettled, "task", "left_semi").select("task", "cls", "rep", "n", "sketch", "part")
            late = stored(inside.groupBy("task").applyInPandas(_large(percent, every), f"{pair}, task long"), "pairs")
            linked = late.drop("task").distinct()
            more = verified(linked, _sets_of(source, ends(linked), width))
            if not more.isEmpty():
                edges = edges.unionByName(more)
                group = stored(components(edges), "groups")
            chosen = late.where("task <> 0").select("task").distinct()
            if chosen.isEmpty():
                break
    named_group = classes.select("cls", "rep").join(group, classes["rep"] == group["node"], "left").select("cls", F.coalesce("component", "rep").alias("component_id"))
    out = rows.join(named_group, "cls", "left")
    kind = docs.schema[key].dataType
    return out.select(
        F.col("doc").cast(kind).alias(key),
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("cls")).alias("class_id"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc")).cast(kind).alias("component_id"),
    )
