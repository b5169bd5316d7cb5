"""Mixing sources to target weights by Pfair scheduling.

Every source is a stream of blocks of ``block_chars`` characters, in an order made by hashing
the ids. With weight w = q / Q, block i of a source may be placed from slot floor(i / w) on
(its release) and must be placed before slot ceil((i + 1) / w) (its deadline). In each slot the
released block with the earliest deadline goes next. After any number of slots a source that
has not run out is less than one block away from its exact share.

Weights are followed exactly (to 2 ** -60 of their total), over the whole schedule: the blocks
of all sources, one per ``block_chars``, are scheduled one after the other in the driver and
written in chunks. A source of weight 0 comes after all others. With ``frame``, weights are
rounded to whole multiples of 1 / Q instead, at least one: the schedule repeats every Q slots, only one
frame of Q slots is scheduled, and every block finds its slot from its number alone; the bound
then holds for the rounded weights. A source that has run out leaves its slots empty. Every
document appears once, in the block in which it starts.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.llm.common import materialize, ranked, shared_dir

BLOCK_CHARS = 32_768
FRAME = 1024  # slots of a frame, about; each source has at least one
POWER = 0.5  # default weights: a source's characters to this power
SCALE = 2**60  # exact weights are multiples of 1 / SCALE
CHUNK = 1_000_000  # blocks that the driver holds at a time; a schedule of one chunk is broadcast


def source_key(source: Column) -> Column:
    """A key that keeps NULL apart from every name."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("-"))


def target_weights(totals: DataFrame, weights: Mapping[str | None, float] | None = None, power: float = POWER) -> DataFrame:
    """``totals(key, chars)`` with each source's ``weight``.

    ``weights`` names a target weight per source; sources that it leaves out get their default
    weight (characters to the power) relative to the total of all defaults.
    """
    default = F.pow(F.col("chars").cast("double"), F.lit(power))
    weight = default / F.sum(default).over(Window.partitionBy(F.lit(1)))  # one row per source
    weight = F.coalesce(weight, F.lit(0.0))
    for source, value in (weights or {}).items():
        weight = F.when(F.col("key") == source_key(F.lit(source)), F.lit(float(value))).otherwise(weight)
    return totals.withColumn("weight", weight)


def quotas(totals: DataFrame, weights: Mapping[str | None, float] | None = None, frame: int = FRAME, power: float = POWER) -> DataFrame:
    """(key, quota): slots per frame, at least one, from ``totals(key, chars)``."""
    total = F.sum("weight").over(Window.partitionBy(F.lit(1)))
    share = F.coalesce(F.try_divide(F.col("weight"), total), F.lit(0.0))
    return target_weights(totals, weights, power).select("key", F.greatest(F.lit(1), F.floor(share * frame + 0.5)).cast("long").alias("quota"))


def schedule(weights: Sequence[float], blocks: Sequence[int]) -> Iterator[tuple[int, int, int]]:
    """(source, block, slot) of every block, by slot: the released block with the earliest deadline goes next.

    Without any positive weight all are equal.
    """
    usable = [w if w > 0 and math.isfinite(w) else 0.0 for w in weights]
    most = max(usable, default=0.0)
    usable = [w / most for w in usable] if most else [1.0] * len(usable)
    sum_ = math.fsum(usable)
    whole = [int(w / sum_ * SCALE) for w in usable]
    total, done, slot = sum(whole), [0] * len(whole), 0
    waiting = [(0, s) for s, w in enumerate(whole) if w and blocks[s]]  # by release
    ready: list[tuple[int, int]] = []  # by deadline
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            s = heapq.heappop(waiting)[1]
            heapq.heappush(ready, (-(-(done[s] + 1) * total // whole[s]), s))
        s = heapq.heappop(ready)[1]
        yield s, done[s], slot
        done[s] += 1
        slot += 1
        if done[s] < blocks[s]:
            heapq.heappush(waiting, (done[s] * total // whole[s], s))
    for s, w in enumerate(whole):
        if not w:
            for block in range(blocks[s]):
                yield s, block, slot
                slot += 1


def exact_slots(totals: DataFrame, weights: Mapping[str | None, float] | None, block_chars: int, power: float) -> DataFrame:
    """(key, block, slot) of every block."""
    sources = target_weights(totals, weights, power).orderBy("key").collect()  # one row per source
    spark = totals.sparkSession
    names = spark.createDataFrame(pa.table({"s": pa.array(range(len(sources)), pa.int32()), "key": pa.array([r.key for r in sources], pa.string())}))
    placed = schedule([r.weight for r in sources], [r.chars // block_chars + 1 for r in sources])
    path, n = shared_dir(spark, "schedule"), 0
    while not n or chunk.size:
        chunk = np.fromiter(itertools.islice(placed, CHUNK), np.dtype([("s", "i4"), ("block", "i8"), ("slot", "i8")]))
        spark.createDataFrame(pa.table({c: np.ascontiguousarray(chunk[c]) for c in chunk.dtype.names})).write.mode("append").parquet(path)
        n += max(1, chunk.size)
    slots = spark.read.schema("s int, block long, slot long").parquet(path).join(F.broadcast(names), "s").drop("s")
    return F.broadcast(slots) if n <= CHUNK + 1 else slots


def one_frame(quota: DataFrame) -> DataFrame:
    """(key, nth, slot, quota, frame): the slot of a source's nth block in a frame, earliest deadline first."""
    one = quota.agg(F.array_sort(F.collect_list(F.struct("key", "quota"))).alias("s"), F.sum("quota").alias("frame"))  # one entry per source
    one = one.select(F.col("s.key").alias("keys"), F.col("s.quota").alias("quotas"), "frame").where("frame > 0")
    n, frame, quotas_ = F.size("keys").cast("long"), F.col("frame"), F.col("quotas")

    def step(state: Column, slot: Column) -> Column:
        def urgency(done: Column, s: Column) -> Column:
            q = F.get(quotas_, s)
            release, deadline = F.floor(done * frame / q), F.ceil((done + 1) * frame / q)
            return F.when((done < q) & (release <= slot), deadline * n + s)

        pick = (F.array_min(F.transform(state["done"], urgency)) % n).cast("int")
        return F.struct(pick.alias("pick"), state["done"].alias("done"), state["picks"].alias("picks"))

    def advance(state: Column, slot: Column) -> Column:
        # One-element array: the choice is made once and then used twice.
        return F.transform(
            F.array(step(state, slot)),
            lambda x: F.struct(
                F.transform(x["done"], lambda done, s: done + (s == x["pick"]).cast("long")).alias("done"),
                F.concat(x["picks"], F.array(x["pick"])).alias("picks"),
            ),
        )[0]

    start = F.struct(F.transform("keys", lambda _: F.lit(0).cast("long")).alias("done"), F.array().cast("array<int>").alias("picks"))
    picks = F.aggregate(F.sequence(F.lit(0).cast("long"), frame - 1), start, advance, lambda state: state["picks"])
    slots = one.select("keys", "quotas", "frame", F.posexplode(picks).alias("slot", "s"))
    nth = F.row_number().over(Window.partitionBy("s").orderBy("slot")) - 1
    return slots.select(
        F.get("keys", F.col("s")).alias("key"), nth.cast("long").alias("nth"), F.col("slot").cast("long").alias("slot"), F.get("quotas", F.col("s")).alias("quota"), "frame"
    )


def _placed(docs: DataFrame, carried: list[str], weights: Mapping[str | None, float] | None, block_chars: int, frame: int | None, power: float) -> DataFrame:
    """The ``carried`` columns as a struct ``row``, with key, id, block, slot and start (characters of the source before the row)."""
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carried]).alias("row"), source_key(F.col("source")).alias("key"), F.col("doc_id").cast("long").alias("id"),
        F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("size"),
    ).withColumn("order", F.coalesce(F.md5(F.col("id").cast("string").cast("binary")), F.lit("")))
    totals = rows.groupBy("key").agg(F.sum("size").alias("chars"))
    # A source is cut by the first three digits of the order, so that a large one is spread.
    started = ranked(rows, ["key"], ["order", "id", "size"], "start", weight=F.col("size"), bucket=F.substring("order", 1, 3))
    if frame is None:
        blocked = started.withColumn("block", F.floor(F.col("start") / block_chars))
        return blocked.join(exact_slots(totals, weights, block_chars, power), ["key", "block"])
    frame_slots = materialize(one_frame(quotas(totals, weights, frame, power)), "frame")
    quota = F.broadcast(frame_slots.select("key", "quota", "frame").distinct())  # one row per source
    blocked = started.join(quota, "key").withColumn("block", F.floor(F.col("start") / block_chars))
    at = blocked.withColumn("nth", F.col("block") % F.col("quota")).join(F.broadcast(frame_slots.select("key", "nth", "slot")), ["key", "nth"])  # FRAME rows, about
    return at.withColumn("slot", F.floor(F.col("block") / F.col("quota")) * F.col("frame") + F.col("slot"))


def mix(
    docs: DataFrame, weights: Mapping[str | None, float] | None = None, block_chars: int = BLOCK_CHARS, frame: int | None = None, power: float = POWER
) -> DataFrame:
    """One row per input row: doc_id, source, block, slot, start. Read by (slot, start, doc_id) to get the mix.

    A NULL source is a source of its own; NULL and empty texts have no characters and go where
    the next document starts. Rows that agree in id and size are interchangeable. An empty
    table gives no rows; extra columns are ignored.
    """
    return _placed(docs, ["source"], weights, block_chars, frame, power).select(F.col("id").alias("doc_id"), F.col("row.source").alias("source"), "block", "slot", "start")


def mixed(
    docs: DataFrame, weights: Mapping[str | None, float] | None = None, block_chars: int = BLOCK_CHARS, frame: int | None = None, power: float = POWER
) -> DataFrame:
    """The rows of ``docs`` with their columns, dealt and sorted in the order of the mix."""
    placed = _placed(docs, docs.columns, weights, block_chars, frame, power)
    return placed.repartitionByRange("slot", "start", "id").sortWithinPartitions("slot", "start", "id").select("row.*")
