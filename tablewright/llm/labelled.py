"""Labelled rows for fitting classifiers: a bounded sample, never the held-out fold."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns labels from: crc32 of the id as text is divisible by 5; false without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


@dataclass
class Sample:
    """Texts (UTF-8), their labels, and weights that restore the share of each label among all labelled rows."""

    texts: list[bytes]
    labels: list[int]
    weights: list[float]


def sample(docs: DataFrame, labels: DataFrame, column: str, per_label: int) -> Sample:
    """At most ``per_label`` documents of label 0 and of label 1 outside the held-out fold, chosen by a hash of the id.

    Labels other than 0 and 1, null ids and null labels are left out; of
    repeated labels of one id the largest counts.
    """
    own = labels.select(labels["doc_id"].alias("doc_id"), labels[column].cast("int").alias("y"))
    own = (own.where("doc_id is not null and y in (0, 1)").where(~held_out(F.col("doc_id")))
           .groupBy("doc_id").agg(F.max("y").alias("y")))
    totals = {r["y"]: r["n"] for r in own.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = None
    for y in (0, 1):
        part = own.where(F.col("y") == y).orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(per_label)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = docs.select(docs["doc_id"].alias("doc_id"), F.coalesce(docs["text"].cast("string"), F.lit("")).cast("binary").alias("text"))
    # at most 2 * per_label ids, so the broadcast is bounded
    rows = texts.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).collect()
    rows.sort(key=lambda r: r["doc_id"])
    seen = {y: sum(r["y"] == y for r in rows) for y in (0, 1)}
    return Sample([bytes(r["text"]) for r in rows], [r["y"] for r in rows],
                  [totals[r["y"]] / seen[r["y"]] / max(sum(totals.values()), 1) * len(rows) for r in rows])
