"""Mixing sources to target weights along a time-varying curriculum.

Targets: a token budget is shared out by weight; a target stops at `most` times its source's size and the excess is
shared again. Each source lays its documents out in hashed order, pass after pass, up to its target; its weight schedule,
integrated over training time, says which share of the target is due by then, and the inverse of that integral gives
the position of each document's copies. The mix is sorted by position, by range.

Results for odd input: a null or empty text has size 0 and is never taken; null sources are one source, the last;
a source without words has target 0; repeated rows count each by itself; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, numbered, renamed

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MOST = 2.0
#: Relative weight at equally spaced times, for each weight of the cycle: falling, level, rising.
SCHEDULES = ((1.5, 1.0, 0.5), (1.0, 1.0, 1.0), (0.5, 1.0, 1.5))
#: Documents of a source that one window task orders, about.
BUCKET = 4096


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """Adds `place` and `target` to source, source_size.

    Each round is one aggregation to two sums: what the sources at their limit hold, and the weight of the others.
    """
    cycle = F.array(*[F.lit(w) for w in weights])
    rows = numbered(totals, F.col("source").asc_nulls_last(), name="place")
    rows = cut(rows.withColumn("weight", F.get(cycle, (F.col("place") % len(weights)).cast("int"))).withColumn("limit", F.col("source_size") * most))
    share = budget * (rows.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, -1
    while True:
        at = F.col("limit") <= level * F.col("weight")
        held, free, n = rows.agg(F.sum(F.when(at, F.col("limit"))), F.sum(F.when(~at, F.col("weight"))), F.count_if(at)).first()
        if n == full or not free:
            break
        full, level = n, (share - (held or 0)) / free
    return rows.withColumn("target", F.least("limit", level * F.col("weight"))).drop("weight", "limit")


def due(share: Column, schedule: tuple[float, ...]) -> Column:
    """The training time from 0 to 1 at which a source has used this share of its target.

    The schedule is linear between its knots, so its integral is quadratic there and is inverted knot by knot.
    """
    step = 1 / (len(schedule) - 1)
    areas = [(a + b) / 2 * step for a, b in zip(schedule, schedule[1:])]
    total, done, out = sum(areas), 0.0, F.lit(1.0)
    pieces = []
    for k, (a, b, area) in enumerate(zip(schedule, schedule[1:], areas)):
        rest = share * total - done  # = a x + slope x^2 / 2
        slope = (b - a) / step
        x = rest / a if slope == 0 else 2 * rest / (a + F.sqrt(F.greatest(F.lit(0.0), a * a + 2 * slope * rest)))
        pieces.append(((done + area) / total, k * step + F.least(F.lit(step), F.greatest(F.lit(0.0), x))))
        done += area
    for upto, at in reversed(pieces):
        out = F.when(share <= upto, at).otherwise(out)
    return out


def mix(docs: DataFrame, keep: tuple[str, ...] = (), weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: float = MOST, schedules: tuple[tuple[float, ...], ...] = SCHEDULES, doc_id: str = "doc_id", text: str = "text", source: str = "source", sort: bool = True) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies, first_position, last_position, positions (of the copies) and the kept columns, by position.

    taken counts words: every source takes its target to the word, so that one document of it may be taken in part;
    copies counts that part as a whole where it is half or more.
    """
    rows = docs.select(
        docs[doc_id].alias("doc_id"),
        docs[source].alias("source"),
        size_of(docs[text]).alias("size"),
        F.xxhash64(docs[doc_id], docs[text]).alias("_hash"),
        *[docs[c].alias(f"_kept_{i}") for i, c in enumerate(keep)],
    )
    small = cut(rows.select("doc_id", "source", "size", "_hash"))
    n = small.count()
    bits = max(0, (n // BUCKET).bit_length())
    bucket = F.shiftrightunsigned("_hash", 64 - bits) if bits else F.lit(0).cast("long")
    # Null sources need a key of their own in the join.
    split = lambda frame: frame.withColumn("_bucket", bucket).withColumn("_none", F.col("source").isNull()).withColumn("_source", F.coalesce("source", F.lit("")))
    parts = cut(split(small).groupBy("_none", "_source", "_bucket").agg(F.sum("size").alias("_part")))
    totals = parts.groupBy("_none", "_source").agg(F.sum("_part").alias("source_size")).select(F.when(~F.col("_none"), F.col("_source")).alias("source"), "source_size")
    aims = targets(totals, weights, budget, most).select(F.col("source").isNull().alias("_none"), F.coalesce("source", F.lit("")).alias("_source"), "source_size", "target", "place")
    before = Window.partitionBy("_none", "_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("_start", F.coalesce(F.sum("_part").over(before), F.lit(0))).drop("_part").join(aims, ["_none", "_source"])
    keys = ["_none", "_source", "_bucket"]
    within = Window.partitionBy(*keys).orderBy("_hash", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = split(rows if keep else small).withColumn("_end", F.sum("size").over(within)).join(starts, keys)
    size, whole = F.col("size"), F.col("source_size")
    goal = F.floor("target")
    passes = F.when(whole > 0, F.floor(goal / whole)).otherwise(0)
    begin = F.col("_start") + F.col("_end") - size
    rest = goal - passes * whole
    more = F.greatest(F.lit(0), F.least(size, rest - begin))
    taken = passes * size + more
    copies = F.when(size > 0, passes + F.when(more * 2 >= size, 1).otherwise(0)).otherwise(0).cast("int")
    middle = begin + size / 2
    position = lambda k: F.when(taken > 0, schedule_of((middle + k * whole) / F.greatest(F.col("target"), F.lit(1.0))))

    def schedule_of(share: Column) -> Column:
        share = F.least(F.lit(1.0), share)
        out = due(share, schedules[-1])
        for i in range(len(schedules) - 1):
            out = F.when(F.col("place") % len(schedules) == i, due(share, schedules[i])).otherwise(out)
        return out

    out = placed.select(
        "doc_id", "size", F.col("source_size"), "target", taken.cast("long").alias("taken"), copies.alias("copies"),
        position(F.lit(0)).alias("first_position"),
        position(passes - F.when(more > 0, 0).otherwise(1)).alias("last_position"),
        F.when(copies > 0, F.transform(F.sequence(F.lit(0), copies - 1), position)).alias("positions"),
        *[F.col(f"_kept_{i}") for i in range(len(keep))],
    )
    return out.orderBy("first_position", "doc_id") if sort else out


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents, whole, each as often as the mix takes it, sorted by the positions of the copies."""
    inner, names = renamed(docs)
    taken = mix(inner, keep=tuple(names), sort=False, **options).where("copies > 0")
    copies = taken.select(*[f"_kept_{i}" for i in range(len(names))], "doc_id", F.explode("positions").alias("_position"))
    return copies.orderBy("_position", "doc_id").select(*[F.col(f"_kept_{i}").alias(c) for i, c in enumerate(docs.columns)])
