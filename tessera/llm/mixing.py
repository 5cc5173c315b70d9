"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in a fixed pseudo-random order, are cut into blocks.
Block ``i`` (from 0) of a source with weight ``w`` gets the release time
``floor(i / w)`` and the deadline ``ceil((i + 1) / w)``, in slots of one block.
Earliest-deadline-first over released blocks then fills one slot after the
other, and every source stays less than one block away from its exact share of
every prefix of the schedule.

Weights are held as integer parts of ``SCALE``, so times are exact and no error
adds up: over the longest plan the held weight is less than 1/4000 of a block
away from the given one.  When a source runs out, the others go on from that
slot by their relative weights; those of weight 0 follow at the end.  No slot
is empty, and no row is dropped or repeated.

The plan is a fold over the blocks and has at most ``slots`` of them, and one
more a source: of larger tables the blocks are larger.  It goes to the rows as
one array a source, a few bytes a block.

Native: DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts that all weights together have.
SCALE = 1 << 32
#: Blocks of a plan at most (and one more a source), and how many of them a fold appends to one array at each of its levels.
SLOTS, CHUNK = 1 << 20, 100
#: Leading hexadecimal digits of the order key that split each source, so that no task ranks a whole source.
DIGITS = 3


def _order_key(key: str) -> Column:
    return F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))


def shares(totals: DataFrame, temperature: float, weights: dict[str, float] | None = None) -> DataFrame:
    """Parts of ``SCALE`` by source, their sum: ``src, n, share``.

    ``totals`` holds ``src, n``.  Without ``weights`` a source's weight is its
    size to the power ``temperature``; sources that ``weights`` does not name have 0.  If all have 0 they are equal.
    Largest remainders round the parts.
    """
    if weights is None:
        weight = F.pow(F.col("n").cast("double"), F.lit(float(temperature)))
    else:
        pairs = [x for k, v in sorted(weights.items()) for x in (F.lit(k), F.lit(float(v)))]
        weight = F.coalesce(F.create_map(*pairs)[F.col("src")], F.lit(0.0)) if pairs else F.lit(0.0)
    everything = Window.partitionBy(F.lit(0))
    total = F.sum("w").over(everything)
    exact = F.round(F.when(total > 0, F.col("w") / total).otherwise(1.0 / F.count("*").over(everything)) * SCALE, 6)
    first = totals.withColumn("w", weight).withColumn("exact", exact).withColumn("low", F.floor("exact"))
    left = F.lit(SCALE) - F.sum("low").over(everything)
    turn = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy((F.col("exact") - F.col("low")).desc(), "src"))
    return first.withColumn("left", left).withColumn("turn", turn).select("src", "n", (F.col("low") + F.when(F.col("turn") <= F.col("left"), 1).otherwise(0)).alias("share"))


def schedule(share: DataFrame, block_rows: int, slots: int = SLOTS) -> DataFrame:
    """The earliest-deadline-first schedule: ``src, rows, slots, releases, deadlines``, the rows of a block and the times of each block of the source.

    ``share`` holds one row per source, a list of the size of a configuration.
    """
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    sized = share.withColumn("rows", F.greatest(F.lit(block_rows).cast("long"), F.ceil(total / slots)))
    sized = sized.withColumn("blocks", F.ceil(F.col("n") / F.col("rows")))
    one = sized.agg(F.array_sort(F.collect_list(F.struct("src", "share", "blocks"))).alias("s"), F.sum("blocks").alias("length"), F.first("rows").alias("rows")).where("length > 0")
    div = lambda a, b: F.call_function("div", a, b)
    longs = lambda f: F.transform("s", f)
    total_of = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)

    def weights_of(done: Column) -> Column:
        """Weights of the sources with blocks left; of weight 0 only when there are no others."""
        left = longs(lambda x, i: F.when(F.get(done, i) < x["blocks"], x["share"]).otherwise(F.lit(0).cast("long")))
        ones = longs(lambda x, i: F.when(F.get(done, i) < x["blocks"], F.lit(1).cast("long")).otherwise(F.lit(0).cast("long")))
        return F.when(total_of(left) > 0, left).otherwise(ones)

    def step(acc: Column, t: Column) -> Column:
        def due(w: Column, k: Column) -> Column:
            done = F.get(acc["done"], k) - F.get(acc["base"], k)
            release = div(done * acc["whole"], w)
            deadline = div((done + 1) * acc["whole"] + w - 1, w)
            return F.when((w > 0) & (release <= t - acc["start"]), F.struct((acc["start"] + deadline).alias("deadline"), k.alias("k"), (acc["start"] + release).alias("release")))

        def placed(acc: Column, p: Column) -> Column:
            done = F.transform(acc["done"], lambda d, i: F.when(i == p["k"], d + 1).otherwise(d))
            out = F.get(F.col("s"), p["k"])["blocks"] == F.get(acc["done"], p["k"]) + 1
            ws = F.when(out, weights_of(done)).otherwise(acc["ws"])
            return F.struct(
                done.alias("done"),
                F.when(out, done).otherwise(acc["base"]).alias("base"),
                F.when(out, t + 1).otherwise(acc["start"]).alias("start"),
                ws.alias("ws"),
                F.when(out, total_of(ws)).otherwise(acc["whole"]).alias("whole"),
                F.concat(acc["order"], F.array(p["k"].cast("long"), p["release"], p["deadline"])).alias("order"),
            )

        # A fold over one value names it.
        return F.aggregate(F.array(F.array_min(F.transform(acc["ws"], due))), acc, placed)

    empty, none = F.expr("cast(array() as array<bigint>)"), F.expr("cast(array() as array<array<bigint>>)")
    zeros = longs(lambda _: F.lit(0).cast("long"))
    state = lambda acc, order: F.struct(*(acc[c].alias(c) for c in ("done", "base", "start", "ws", "whole")), order.alias("order"))

    def fold(now: Column, first: Column, depth: int) -> Column:
        """The state after ``CHUNK ** depth`` slots.  A step copies the array it appends to, so arrays are short and joined level by level."""
        if depth == 1:
            return F.aggregate(F.sequence(first, F.least(first + CHUNK, F.col("length")) - 1), now, step)
        last = F.col("length") if depth == 3 else F.least(first + CHUNK**depth, F.col("length"))
        joined = lambda acc, x: F.struct(state(x, empty).alias("now"), F.concat(acc["all"], F.array(x["order"])).alias("all"))
        return F.aggregate(
            F.sequence(first, last - 1, F.lit(CHUNK ** (depth - 1)).cast("long")),
            F.struct(now.alias("now"), none.alias("all")),
            lambda acc, at: F.aggregate(F.array(fold(acc["now"], at, depth - 1)), acc, joined),
            lambda acc: state(acc["now"], F.flatten(acc["all"])),
        )

    start = F.struct(zeros.alias("done"), zeros.alias("base"), F.lit(0).cast("long").alias("start"), weights_of(zeros).alias("ws"), total_of(weights_of(zeros)).alias("whole"), empty.alias("order"))
    slot = lambda xs, i: F.struct(F.get(xs, 3 * i).alias("k"), i.alias("slot"), F.get(xs, 3 * i + 1).alias("release"), F.get(xs, 3 * i + 2).alias("deadline"))
    listed = F.transform(F.array(fold(start, F.lit(0).cast("long"), 3)["order"]), lambda xs: F.transform(F.sequence(F.lit(0), F.col("length").cast("int") - 1), lambda i: slot(xs, i)))
    planned = one.select("s", "rows", F.explode(F.get(listed, F.lit(0))).alias("o"))
    plan = planned.groupBy("o.k").agg(F.first("s").alias("s"), F.first("rows").alias("rows"), F.array_sort(F.collect_list(F.struct("o.slot", "o.release", "o.deadline"))).alias("plan"))
    part = lambda name, kind: F.transform("plan", lambda x: x[name].cast(kind)).alias(f"{name}s")
    return plan.select(F.get("s", F.col("k").cast("int"))["src"].alias("src"), "rows", part("slot", "int"), part("release", "int"), part("deadline", "long"))


def mix(
    docs: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    block_rows: int = 64,
    temperature: float = 0.7,
    weights: dict[str, float] | None = None,
    slots: int = SLOTS,
) -> DataFrame:
    """All columns of ``docs`` (but those it adds) and ``mix_block, mix_release, mix_deadline, mix_slot, mix_position``.

    ``mix_position`` orders the mixture.  A null source is a source of its own, next to one named
    by empty text; a null key orders first and repeated rows follow one another.  An empty table gives no rows.
    Blocks have ``block_rows`` rows, or as many more as leave ``slots`` blocks in all.
    """
    added = ["mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_position"]
    docs = docs.drop(*added)
    src = F.coalesce(F.concat(F.lit("s:"), F.col(source).cast("string")), F.lit("n:"))
    named = docs.withColumn("__src", src).withColumn("__h", _order_key(key)).withColumn("__range", F.substring("__h", 1, DIGITS))
    tally = docs.select(src.alias("__src"), F.substring(_order_key(key), 1, DIGITS).alias("__range")).groupBy("__src", "__range").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("__src").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = tally.select("__src", "__range", before.alias("__before"))
    if weights is not None:
        weights = {f"s:{k}": v for k, v in weights.items()}
    plan = schedule(shares(tally.groupBy(F.col("__src").alias("src")).agg(F.sum("n").alias("n")), temperature, weights), block_rows, slots)
    inside = F.row_number().over(Window.partitionBy("__src", "__range").orderBy("__h", key)) - 1
    ranked = named.withColumn("__in", inside).join(ranges, ["__src", "__range"]).withColumn("__rank", F.col("__before") + F.col("__in"))
    # ``slots`` bounds the plan: a row per source with 16 bytes a block.
    rows = ranked.join(F.broadcast(plan.withColumnsRenamed({c: f"__{c}" for c in plan.columns})), "__src")
    block = F.floor(F.col("__rank") / F.col("__rows"))
    at = lambda name: F.get(name, block.cast("int")).cast("long")
    return rows.select(
        *[F.col(c) for c in docs.columns],
        block.alias("mix_block"),
        at("__releases").alias("mix_release"),
        at("__deadlines").alias("mix_deadline"),
        at("__slots").alias("mix_slot"),
        (at("__slots") * F.col("__rows") + F.col("__rank") % F.col("__rows")).alias("mix_position"),
    )
