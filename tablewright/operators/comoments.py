"""Means, variances and covariances of many columns in one scan.

Every Arrow batch becomes mergeable partials, matrices over all pairs (i, j) of
columns and over the rows in which both are present (pairwise complete):
``n``, the mean of i, its sum of squared deviations ``m2``, and the
co-moment ``c``.  Partials of a task are merged as they come, so a task holds
one set of matrices; what leaves it is one row per column i, and the rows of
one i are merged on Spark.  Merging shifts by the difference of the means
(the pairwise update of Chan, Golub and LeVeque), so large offsets cost no
digits.  The result has a row per column, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIELDS = ("n", "mean", "other_mean", "m2", "c")  # of i with every j, ``other_mean`` that of j
ROWS = 4096


def _partial(x: np.ndarray) -> np.ndarray:
    """The matrices of some rows (NaN: missing), stacked in the order of FIELDS."""
    present = ~np.isnan(x)
    held = present.astype(np.float64)
    center = np.where(present.any(axis=0), np.nan_to_num(x).sum(axis=0) / np.maximum(held.sum(axis=0), 1), 0)
    d = np.where(present, x - center, 0)
    n = held.T @ held
    total = d.T @ held  # of i where j is present
    safe = np.maximum(n, 1)
    shift = total / safe
    return np.stack([n, shift + center[:, None], shift.T + center[None, :], (d * d).T @ held - total * shift, d.T @ d - total * shift.T])


def _merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = a[0] + b[0]
    share = b[0] / np.maximum(n, 1)
    own, other = b[1] - a[1], b[2] - a[2]
    weight = a[0] * share
    new = np.stack([n, a[1] + own * share, a[2] + other * share, a[3] + b[3] + own * own * weight, a[4] + b[4] + own * other * weight])
    return np.where(a[0] == 0, b, np.where(b[0] == 0, a, new))


def comoments(df: DataFrame, values: Sequence[Column]) -> dict[str, np.ndarray]:
    """Matrices over all pairs of the given columns (doubles, NULL or NaN: missing), by the names of FIELDS."""
    k = len(values)
    schema = "i int, part binary"

    def rows(state: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()),
                                           pa.array([np.ascontiguousarray(state[:, i]).tobytes() for i in range(k)], pa.binary())], ["i", "part"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = np.zeros((len(FIELDS), k, k))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                state = _merged(state, _partial(np.stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in part.columns], axis=1)))
        if state[0].any():
            yield rows(state)

    def merge(table: pa.Table) -> pa.Table:
        state = np.zeros((len(FIELDS), k))
        for part in table.column("part"):
            state = _merged(state, np.frombuffer(part.as_py()).reshape(len(FIELDS), k))
        return pa.table([table.column("i").slice(0, 1), pa.array([state.tobytes()], pa.binary())], ["i", "part"])

    plain = df.select(*(F.nanvl(v.cast("double"), F.lit(None).cast("double")).alias(f"c{i}") for i, v in enumerate(values)))
    found = plain.mapInArrow(scan, schema).groupBy("i").applyInArrow(merge, schema).collect()  # a row per column
    out = np.zeros((len(FIELDS), k, k))
    for r in found:
        out[:, r["i"]] = np.frombuffer(r["part"]).reshape(len(FIELDS), k)
    return dict(zip(FIELDS, out))
