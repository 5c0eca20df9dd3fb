"""Exact quantiles by bracket selection: no shuffle of the values.

1. One scan sketches every group (``percentile_approx``, combined in the map
   tasks) and so brackets each wanted order statistic between two values.
2. A second scan counts, per group, the values below each bracket and keeps
   only the values inside, counted; everything else collapses into one row
   per group and task.  A bracket holds about 6 / ``accuracy`` of a large
   group, so the shuffle carries a fraction of a percent of the values.
3. The counts show whether each bracket holds its order statistics; where one
   does not (the sketch is approximate) it is opened to all values of the group
   and step 2 repeats.
4. Brackets that still hold more than ``most`` distinct values are divided
   into ``CHUNKS`` by value and all but the one or two chunks with the order
   statistics dropped, until they are small.  The running count over a bracket
   then gives the values at both ranks.

Columns and groups are all treated at once; a group that holds most of the
rows is combined in the map tasks like any other.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cache import hold

ACCURACY = 10_000
MOST = 1_000_000       # distinct values of one bracket that one task sorts
CHUNKS = 256
BROADCAST_GROUPS = 100_000
TINY, COARSE = 100, 0.05


def matched(left: DataFrame, right: DataFrame, keys: Sequence[str], small: bool) -> DataFrame:
    """Inner join on ``keys``, NULL and NaN being values like others (``__tw_n`` and ``i`` are never NULL)."""
    renamed = right.withColumnsRenamed({k: f"__tw_r_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, (F.col(k) == F.col(f"__tw_r_{k}") if k in ("__tw_n", "i") else F.col(k).eqNullSafe(F.col(f"__tw_r_{k}")) for k in keys))
    return left.join(F.broadcast(renamed) if small else renamed, same).drop(*(f"__tw_r_{k}" for k in keys))


def _brackets(long: DataFrame, keys: list[str], probs: list[float], accuracy: int) -> DataFrame:
    """Per group its size ``n``, and per quantile i the bracket ``low<i>``, ``high<i>``."""
    fine = 2 / accuracy
    around = [min(max(p + d, 0.0), 1.0) for p in probs for d in (-fine, fine, -COARSE, COARSE)]
    sketch = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("least"), F.max("v").alias("most"),
                                     F.percentile_approx("v", around, accuracy).alias("q"))

    def bound(i: int, high: int, outer: str) -> Column:
        return (F.when(F.col("n") < TINY, F.col(outer)).when(F.col("n") < 2 * accuracy, F.col("q")[4 * i + 2 + high])
                .otherwise(F.col("q")[4 * i + high]))

    return sketch.select(*keys, "n", *(c for i in range(len(probs)) for c in (
        bound(i, 0, "least").alias(f"low{i}"), bound(i, 1, "most").alias(f"high{i}"))))


def _ranks(n: Column, p: float) -> tuple[Column, Column, Column]:
    """The 0-based ranks around a quantile and the share of the way between them."""
    position = F.lit(p) * (n - 1)
    return F.floor(position).cast("long"), F.ceil(position).cast("long"), position - F.floor(position)


def _inside(i: int) -> Column:
    return (F.col("v") >= F.col(f"low{i}")) & (F.col("v") <= F.col(f"high{i}"))


def _counted(long: DataFrame, brackets: DataFrame, keys: list[str], probs: list[float], small: bool) -> DataFrame:
    """Values inside a bracket with their count, all others of a group as NULL, each with the values below every bracket."""
    kept = reduce(lambda a, b: a | b, (_inside(i) for i in range(len(probs))))
    return (matched(long, brackets.drop("n"), keys, small).groupBy(*keys, F.when(kept, F.col("v")).alias("v"))
            .agg(F.count(F.lit(1)).alias("times"), *(F.count_if(F.col("v") < F.col(f"low{i}")).alias(f"below{i}") for i in range(len(probs)))))


def exact_quantiles(long: DataFrame, keys: list[str], probs: Sequence[float], accuracy: int = ACCURACY, most: int = MOST,
                    broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """(keys..., i, value): the linear-interpolated quantile ``probs[i]`` of the non-null doubles ``v`` of each group of ``keys``."""
    spark, probs = long.sparkSession, [float(p) for p in probs]
    every = range(len(probs))
    brackets = _brackets(long, keys, probs, accuracy)
    rows = brackets.limit(broadcast_groups + 1).collect()  # a row per group; more groups than that stay on Spark
    small = len(rows) <= broadcast_groups
    brackets = spark.createDataFrame(rows, brackets.schema) if small else hold(brackets)
    while True:
        counted = hold(_counted(long, brackets, keys, probs, small))
        totals = hold(matched(counted, brackets, keys, small).groupBy(*keys, "n", *(f"{side}{i}" for i in every for side in ("low", "high"))).agg(
            *(F.sum(f"below{i}").alias(f"below{i}") for i in every),
            *(F.coalesce(F.sum(F.when(_inside(i), F.col("times"))), F.lit(0)).alias(f"in{i}") for i in every),
            *(F.count_if(_inside(i)).alias(f"distinct{i}") for i in every)))
        missed = []
        for i, p in enumerate(probs):
            first, last, _ = _ranks(F.col("n"), p)
            missed.append((first < F.col(f"below{i}")) | (last >= F.col(f"below{i}") + F.col(f"in{i}")))
        found = totals.agg(*(F.count_if(m).alias(f"m{i}") for i, m in enumerate(missed)),
                           F.max(F.greatest(F.lit(0), *(F.col(f"distinct{i}") for i in every))).alias("distinct")).first()
        if not any(found[f"m{i}"] for i in every):
            break
        opened = totals.select(*keys, "n", *(c for i, m in enumerate(missed) for c in (
            F.when(m, F.lit(float("-inf"))).otherwise(F.col(f"low{i}")).alias(f"low{i}"),
            F.when(m, F.lit(float("inf"))).otherwise(F.col(f"high{i}")).alias(f"high{i}"))))
        brackets = spark.createDataFrame(opened.collect(), opened.schema) if small else hold(opened)

    wanted = []
    for i, p in enumerate(probs):
        first, last, share = _ranks(F.col("n"), p)
        wanted.append(F.struct(F.lit(i).alias("i"), F.col(f"low{i}").alias("low"), F.col(f"high{i}").alias("high"),
                               (first - F.col(f"below{i}")).alias("first"), (last - F.col(f"below{i}")).alias("last"), share.alias("share")))
    targets = totals.select(*keys, F.explode(F.array(*wanted)).alias("t")).select(*keys, "t.*")
    values = (matched(counted.where("v is not null").select(*keys, "v", "times"), targets, keys, small)
              .where("v >= low and v <= high").drop("low", "high"))
    if found["distinct"] is not None and found["distinct"] > most:
        values = _narrowed(values, keys, most)
    running = values.withColumn("upto", F.sum("times").over(Window.partitionBy(*keys, "i").orderBy("v")))
    ends = running.groupBy(*keys, "i", "share").agg(F.min(F.when(F.col("upto") > F.col("first"), F.col("v"))).alias("a"),
                                                    F.min(F.when(F.col("upto") > F.col("last"), F.col("v"))).alias("b"))
    return ends.select(*keys, "i", (F.col("a") + F.col("share") * (F.col("b") - F.col("a"))).alias("value"))


def _narrowed(values: DataFrame, keys: list[str], most: int) -> DataFrame:
    """``values`` without chunks that hold neither rank, until no bracket has more than ``most`` values."""
    own = [*keys, "i"]
    marks = [k / CHUNKS for k in range(1, CHUNKS)]
    while True:
        cuts = values.groupBy(*own).agg(F.percentile_approx("v", marks, 10 * CHUNKS).alias("cuts"))
        dealt = hold(matched(values, cuts, own, False).withColumn("chunk", F.size(F.filter("cuts", lambda c: c < F.col("v")))).drop("cuts"))
        sums = dealt.groupBy(*own, "chunk", "first", "last").agg(F.sum("times").alias("held"), F.count(F.lit(1)).alias("distinct"))
        before = F.sum("held").over(Window.partitionBy(*own).orderBy("chunk")) - F.col("held")  # at most CHUNKS rows
        kept = hold(sums.withColumn("before", before).where("before <= last and before + held > first"))
        start = kept.groupBy(*own).agg(F.min("before").alias("start"), F.sum("distinct").alias("left"))
        left = start.agg(F.max("left")).first()[0]
        values = matched(matched(dealt, kept.select(*own, "chunk"), [*own, "chunk"], False), start.drop("left"), own, False)
        values = values.withColumns({"first": F.col("first") - F.col("start"), "last": F.col("last") - F.col("start")}).drop("start", "chunk")
        if left <= max(most, 2):
            return values
