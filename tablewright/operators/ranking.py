"""Distributed running ranks without a single-task window.

``Window.orderBy(x)`` with no partition, or ``Window.partitionBy(g)`` when
one group holds a third of the table, sends everything to one task.  The
operators here need exact ranks (exact quantiles, stratified splits, label
codes), so they share one skew-safe plan:

1. range-partition the rows on ``(group..., order...)`` -- a hot group is
   split over many partitions by its order key;
2. sort within partitions and keep a running sum of the weight in a
   vectorised ``mapInArrow`` pass that carries its state across Arrow
   batches (memory is one batch, not one group);
3. persist that result: the range bounds come from a random sample, so
   both later passes must read the same partitioning.  A persisted plan is
   built once; a lost block is recomputed through the same shuffle
   dependency (same bounds).  ``reliable=True`` writes it to the
   checkpoint directory instead and cuts the lineage;
4. aggregate one row per (group, partition) -- at most partitions + groups
   rows -- and turn it into per-partition offsets with a small window;
   when that table is small (checked) it is brought to the driver once and
   broadcast, otherwise it stays distributed and joins with a shuffle;
5. the global rank of a row is offset + local running sum.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir, shuffle_partitions
from .cache import hold, release

PID = "_pid"
WEIGHT = "_w"
GROUP_HASH = "_gh"
LOCAL_CUM = "_lcum"
OFFSET = "_off"
BLOCK_TOTAL = "_t"
CUM = "_cum"

# Offset tables up to this many rows are broadcast; larger ones are joined
# with a shuffle on (group, partition id), which stays skew free.
BROADCAST_ROW_LIMIT = 200_000


def _running_sums(batches):
    """Appends the running weight within each group of one sorted partition; all other columns pass through unchanged."""
    last, carry = None, 0
    for batch in batches:
        group = batch.column(GROUP_HASH).to_numpy(zero_copy_only=False)
        cum = np.cumsum(batch.column(WEIGHT).to_numpy(zero_copy_only=False), dtype=np.int64)
        if len(group):
            starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            before = np.r_[0, cum][starts]
            if group[0] == last:
                before[0] -= carry
            cum -= np.repeat(before, np.diff(np.r_[starts, len(group)]))
            last, carry = group[-1], cum[-1]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cum)], [*batch.schema.names, LOCAL_CUM])


@dataclass
class Ranked:
    """Rows with their global running weight, plus the per-block offsets."""

    rows: DataFrame      # input columns + _w, _pid, _cum (running weight, inclusive)
    blocks: DataFrame    # group cols, _pid, _off (weight before the block), _t (block weight)
    group_cols: list
    small_blocks: bool   # blocks were collected (size checked) and can be broadcast
    persisted: DataFrame | None = None

    def release(self) -> None:
        if self.persisted is not None:
            release(self.persisted)


def running_rank(df: DataFrame, order_cols: list[str], group_cols: list[str] | tuple = (),
                 weight: str | Column | None = None, num_partitions: int | None = None,
                 reliable: bool = False) -> Ranked:
    """Attach ``_cum``: running sum of ``weight`` (default 1) in
    ``order_cols`` order within each group, inclusive of the row.

    Rows tied on ``(group, order)`` get distinct consecutive ranks in an
    arbitrary order, so callers pass a total order or pre-aggregate ties.
    """
    spark = df.sparkSession
    group_cols = list(group_cols)
    n_parts = num_partitions or shuffle_partitions(spark)
    w = F.lit(1) if weight is None else (F.col(weight) if isinstance(weight, str) else weight)
    keys = group_cols + list(order_cols)
    # NULL and NaN are groups of their own, so null flags are part of the hash
    flags = [F.col(c).isNull() for c in group_cols]
    base = df.withColumn(WEIGHT, w.cast("long")) \
        .withColumn(GROUP_HASH, F.xxhash64(*group_cols, *flags) if group_cols else F.lit(0).cast("long"))
    ranged = (base.repartitionByRange(n_parts, *keys)
              .sortWithinPartitions(*keys)
              .withColumn(PID, F.spark_partition_id()))
    schema = T.StructType(ranged.schema.fields + [T.StructField(LOCAL_CUM, T.LongType(), False)])
    local = ranged.mapInArrow(_running_sums, schema).drop(GROUP_HASH)
    if reliable:
        ensure_checkpoint_dir(spark)
        local = local.checkpoint(eager=True)
        persisted = None
    else:
        local = hold(local)
        persisted = local
    part = local.groupBy(*group_cols, PID).agg(F.sum(WEIGHT).alias(BLOCK_TOTAL))
    win = Window.partitionBy(*group_cols).orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)
    blocks = part.withColumn(OFFSET, F.coalesce(F.sum(BLOCK_TOTAL).over(win), F.lit(0)))
    got = blocks.limit(BROADCAST_ROW_LIMIT + 1).collect()
    small = len(got) <= BROADCAST_ROW_LIMIT
    if small:
        blocks = spark.createDataFrame(got, blocks.schema)
    else:
        blocks = hold(blocks)
    right = blocks.select(*group_cols, PID, OFFSET)
    if small:
        right = F.broadcast(right)
    r = right.select(*[F.col(c).alias(f"_r{i}") for i, c in enumerate(group_cols)],
                     F.col(PID).alias("_rpid"), F.col(OFFSET))
    cond = local[PID] == r["_rpid"]
    for i, c in enumerate(group_cols):
        cond = cond & local[c].eqNullSafe(r[f"_r{i}"])
    rows = (local.join(r, cond, "inner")
            .withColumn(CUM, F.col(OFFSET) + F.col(LOCAL_CUM))
            .drop("_rpid", OFFSET, LOCAL_CUM, *[f"_r{i}" for i in range(len(group_cols))]))
    return Ranked(rows=rows, blocks=blocks, group_cols=group_cols, small_blocks=small, persisted=persisted)


def select_ranks(ranked: Ranked, targets: DataFrame, rank_col: str = "_r") -> DataFrame:
    """Rows holding given 0-based ranks.

    ``targets`` has the group columns and ``rank_col``; each target finds its
    block in the offsets table first, so the final join is on
    (group, partition id) and a hot group's blocks spread over many tasks.
    Output: target columns + the matching row's columns.
    """
    g = ranked.group_cols
    b = ranked.blocks.select(*[F.col(c).alias(f"_b{i}") for i, c in enumerate(g)],
                             F.col(PID).alias("_bpid"), OFFSET, BLOCK_TOTAL)
    if ranked.small_blocks:
        b = F.broadcast(b)
    cond = (targets[rank_col] >= b[OFFSET]) & (targets[rank_col] < b[OFFSET] + b[BLOCK_TOTAL])
    for i, c in enumerate(g):
        cond = cond & targets[c].eqNullSafe(b[f"_b{i}"])
    located = targets.join(b, cond, "inner").drop(*[f"_b{i}" for i in range(len(g))], OFFSET, BLOCK_TOTAL)
    rows = ranked.rows
    rcols = [c for c in rows.columns if c not in targets.columns or c in g]
    rr = rows.select(*[F.col(c).alias(f"_x_{c}") for c in rcols])
    if ranked.small_blocks:
        # targets derive from the small blocks table: a handful per group
        located = F.broadcast(located)
    cond = (rr[f"_x_{PID}"] == located["_bpid"]) \
        & (located[rank_col] >= rr[f"_x_{CUM}"] - rr[f"_x_{WEIGHT}"]) \
        & (located[rank_col] < rr[f"_x_{CUM}"])
    for c in g:
        cond = cond & rr[f"_x_{c}"].eqNullSafe(located[c])
    out = located.join(rr, cond, "inner").drop("_bpid")
    keep = [c for c in rcols if c not in g]
    return out.select(*targets.columns, *[F.col(f"_x_{c}").alias(c) for c in keep])
