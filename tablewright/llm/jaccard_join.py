"""Jaccard join of word n-gram sets by chosen paths.

A set follows a path by choosing some of its shingles: at a node (a path so
far) a shingle is chosen when a hash of node and shingle is low enough that a
set takes ``branch`` / threshold paths on average.  All sets use one hash, so
two sets of Jaccard similarity ``threshold`` take ``branch`` common paths on
average from each node.  Nodes with at most ``bucket`` sets are compared by
brute force; larger ones are split along further shingles.  Independent runs
are repeated until the expected recall at the threshold is at least
``recall`` (see ``runs_for``); similar sets above the threshold are found more
surely still.

At scale:

* Sets that are equal are one class and join once, so copies cost nothing.
* First only hashes of nodes move; sets travel to buckets of at least two
  sets, and buckets of the same sets are compared once.
* A bucket that is still large at the last level is compared exactly, in
  blocks against blocks over many tasks, so no link is dropped.
* A pair met in several buckets is reported by the first one both sets have,
  so links are distinct without a shuffle of duplicates.
* What leaves a bucket grows with its sets, not with its pairs: for each set
  its number of links, and a spanning forest of them.  ``links`` lists the
  pairs themselves, between the first documents of the classes only.

Shingles are ``n`` consecutive words (``[^\\x20\\x09-\\x0D]+``) as 48-bit hashes;
a text of fewer words has one shingle of all its words.  Null and empty texts
have no shingles, no links, and are a class of their own each.  Rows without
an id come after all others.  Repeated rows are one class.  Other columns are
ignored by the join and pass through ``keep_first``.  An empty table gives an
empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_HASHES, forgetting, ids_and_texts, order_id, reliable, whole_row
from .substring_dedup import mix, run_hashes

BRANCH = 1.5
BUCKET = 384
LEVELS = 4  # below a bucket that is too large at the first level: three more
ODD = np.uint64(0x9E3779B97F4A7C15)


def survival(branch: float, levels: int) -> float:
    """Chance that two sets just at the threshold share a node at a level: common paths branch like a Poisson process."""
    p = 1.0
    for _ in range(levels):
        p = 1 - math.exp(-branch * p)
    return p


def runs_for(recall: float, branch: float = BRANCH, levels: int = LEVELS) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(branch, levels)))


def shingles(text: bytes, n: int) -> np.ndarray:
    """Sorted distinct 48-bit hashes."""
    words = text.split()
    hashes = np.fromiter(map(WORD_HASHES.__getitem__, words), np.uint64, len(words))
    return np.unique(run_hashes(hashes, min(n, len(words)), 3) >> np.uint64(16)) if words else hashes


def children(tokens: np.ndarray, nodes: np.ndarray, threshold: float, branch: float) -> tuple[np.ndarray, np.ndarray]:
    """Nodes below each of ``nodes`` that the set goes to, and the index of the node above."""
    share = branch / (threshold * max(len(tokens), 1))
    limit = np.uint64(min(share, 1.0) * (2**64 - 2**12))
    with np.errstate(over="ignore"):
        spread = tokens * ODD
        above, chosen = np.nonzero(mix(spread[None, :] ^ nodes[:, None]) <= limit)
        return mix(spread[chosen] + nodes[above] * np.uint64(0xD6E8FEB86659FD93)), above


def roots(runs: int) -> np.ndarray:
    return np.random.default_rng(17).integers(1, 2**63, runs, dtype=np.uint64)


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def _packed(tokens: np.ndarray) -> bytes:
    return tokens.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view(np.uint64).ravel()


def _first_nodes(rows: DataFrame, n: int, threshold: float, runs: int, branch: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = roots(runs)
        for batch in batches:
            set_ids, nodes = [], []
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                tokens = shingles(text, n)
                if len(tokens):
                    set_ids.append(xxhash.xxh3_64_intdigest(tokens.tobytes()) - 2**63)
                    nodes.append(_signed(children(tokens, top, threshold, branch)[0]))
                else:
                    set_ids.append(None)
                    nodes.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(set_ids, pa.int64()),
                                              pa.array(nodes, pa.list_(pa.int64()))], ["id", "row_key", "set_id", "nodes"])

    return rows.select("id", "row_key", "text").mapInArrow(forgetting(run), "id bigint, row_key bigint, set_id bigint, nodes array<bigint>")


def _with_sets(rows: DataFrame, n: int) -> DataFrame:
    """Replaces ``text`` by the packed set ``tokens``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("text")
            packed = [_packed(shingles(t, n)) for t in batch.column(at).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(packed, pa.binary())],
                                             [*batch.schema.names[:at], "tokens"])

    return rows.mapInArrow(forgetting(run), "set_id bigint, id bigint, small array<bigint>, large array<bigint>, tokens binary")


def _deeper(sets: DataFrame, threshold: float, branch: float, levels: int) -> DataFrame:
    """All nodes below the large ones down to the last level: set_id, level, node, and the node above."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_sets, out_nodes, out_above, out_level = [], [], [], []
            for set_id, large, packed in zip(*(c.to_pylist() for c in batch.columns)):
                tokens, nodes = _unpacked(packed), np.array(large, np.int64).view(np.uint64)
                for level in range(2, levels + 1):
                    below, above = children(tokens, nodes, threshold, branch)
                    below, kept = np.unique(below, return_index=True)
                    out_sets += [set_id] * len(below)
                    out_level += [level] * len(below)
                    out_above += _signed(nodes[above[kept]]).tolist()
                    out_nodes += _signed(below).tolist()
                    nodes = below
            yield pa.RecordBatch.from_arrays(
                [pa.array(out_sets, pa.int64()), pa.array(out_level, pa.int32()), pa.array(out_nodes, pa.int64()),
                 pa.array(out_above, pa.int64())], ["set_id", "level", "node", "parent"])

    return (sets.where(F.size("large") > 0).select("set_id", "large", "tokens")
            .mapInArrow(run, "set_id bigint, level int, node bigint, parent bigint").distinct())


def _sized(nodes: DataFrame) -> DataFrame:
    """Nodes of at least two sets: node, n, and a signature of the sets."""
    return (nodes.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("set_id")).alias("members"))
            .where("n > 1"))


def _chosen(large: DataFrame, deep: DataFrame, bucket: int, levels: int) -> DataFrame:
    """Where each large bucket is compared: node, n.

    Comparing a node costs its rows times its blocks.  A node is opened only
    where its children cost less, so a bucket of mutually similar sets, which
    no shingle splits, is compared at once instead of again in every child.
    """
    cost = F.col("n") * F.ceil(F.col("n") / bucket)
    nodes = reliable(deep.groupBy("level", "parent", "node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
                     .withColumn("cost", cost))
    by_level = {k: nodes.where(F.col("level") == k).drop("level") for k in range(2, levels + 1)}
    by_level[1] = large.select(F.lit(None).cast("bigint").alias("parent"), "node", "n", cost.alias("cost"))
    best = {levels: by_level[levels].withColumns({"best": F.col("cost"), "opened": F.lit(False)})}
    for k in range(levels - 1, 0, -1):
        below = best[k + 1].groupBy("parent").agg(F.sum("best").alias("below")).withColumnRenamed("parent", "node")
        below_cost = F.coalesce("below", F.lit(0))  # only nodes of one set below: nothing to compare
        best[k] = reliable(by_level[k].join(below, "node", "left")
                           .withColumns({"best": F.least("cost", below_cost), "opened": (below_cost < F.col("cost")) & (F.col("n") > bucket)})
                           .select("parent", "node", "n", "best", "opened"))
    reached, chosen = best[1], None
    for k in range(1, levels + 1):
        here = reached.where("not opened").select("node", "n")
        chosen = here if chosen is None else chosen.unionByName(here)
        if k < levels:
            reached = best[k + 1].join(reached.where("opened").select(F.col("node").alias("parent")), "parent")
    return chosen


def _similarities(tokens: list[np.ndarray]) -> np.ndarray:
    """Jaccard similarities of all sets of a cell, from products of dense blocks of a bounded number of columns."""
    sizes = np.array([len(t) for t in tokens], np.float64)
    owner = np.repeat(np.arange(len(tokens)), sizes.astype(np.int64))
    _, column, count = np.unique(np.concatenate(tokens), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    column, owner = column[shared], owner[shared]
    common = np.zeros((len(tokens), len(tokens)), np.float32)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    rank = np.cumsum(np.r_[0, column[1:] != column[:-1]]) if len(column) else column
    for begin in range(0, int(rank[-1]) + 1 if len(rank) else 0, 4096):
        a, b = np.searchsorted(rank, (begin, begin + 4096))
        dense = np.zeros((len(tokens), 4096), np.float32)
        dense[owner[a:b], rank[a:b] - begin] = 1
        common += dense @ dense.T
    return common / (sizes[:, None] + sizes[None, :] - common)


def _compare(threshold: float, pairs: bool):
    """Brute force in one cell: rows of block a against rows of block b of a bucket."""
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pydict()
        node, cell_a, cell_b = rows["node"][0], rows["a"][0], rows["b"][0]
        similar = _similarities([_unpacked(t) for t in rows["tokens"]])
        block = np.array(rows["block"])
        if cell_a == cell_b:
            wanted = np.triu(np.ones(similar.shape, bool), 1)
        else:
            wanted = (block == cell_a)[:, None] & (block == cell_b)[None, :]
        leaves, set_id, ids = [set(x) for x in rows["leaves"]], rows["set_id"], rows["id"]
        n_links, linked, tree = [0] * len(ids), [[] for _ in ids], [[] for _ in ids]
        head = list(range(len(ids)))

        def find(i: int) -> int:
            while head[i] != i:
                head[i] = i = head[head[i]]
            return i

        for i, j in np.argwhere(wanted & (similar >= threshold - 1e-9)).tolist():
            if min(leaves[i] & leaves[j]) == node:
                n_links[i] += 1
                n_links[j] += 1
                if pairs:
                    linked[i].append({"other": set_id[j], "other_id": ids[j], "similarity": float(similar[i, j])})
                a, b = find(i), find(j)
                if a != b:
                    head[a] = b
                    tree[i].append(set_id[j])
        some = [i for i, n in enumerate(n_links) if n]
        return pa.table([pa.array([x[i] for i in some], t) for x, t in zip((set_id, ids, n_links, tree, linked), LINKED_TYPES)],
                        [f.split(" ")[0] for f in LINKED.split(", ")])
    return run


#: A set with its number of links in one cell, the edges of the cell's spanning forest that are written at this set, and
#: (only where pairs are asked for) its links, each at one of its two sets.
LINKED = "set_id bigint, id bigint, n_links bigint, tree array<bigint>, linked array<struct<other:bigint,other_id:bigint,similarity:double>>"
LINKED_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()),
                pa.list_(pa.struct([("other", pa.int64()), ("other_id", pa.int64()), ("similarity", pa.float64())])))


class Joined:
    """``classes``: id, row_key, set_id, rep (id, set_id of the first of the class).

    ``linked``: set_id, id of its first document, ``n_links`` (to be added up over all rows of a set), ``tree``: enough of
    the links to connect all that links connect, each at one of its sets, and ``linked``: each link at one of its sets.
    """

    def __init__(self, classes: DataFrame, linked: DataFrame, pairs: bool):
        self.classes, self.linked, self.pairs = classes, linked, pairs

    def counts(self) -> DataFrame:
        """set_id and n_links, for linked classes."""
        return self.linked.groupBy("set_id").agg(F.sum("n_links").alias("n_links"))

    def links(self) -> DataFrame:
        """One row per link between two classes: id_a, id_b (their first documents) and similarity."""
        if not self.pairs:
            raise ValueError("join the documents with pairs=True to list their links")
        pairs = self.linked.select(F.col("id").alias("id_a"), F.explode("linked").alias("o"))
        return pairs.select("id_a", F.col("o.other_id").alias("id_b"), F.col("o.similarity").alias("similarity"))


def join(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.995, branch: float = BRANCH,
         bucket: int = BUCKET, levels: int = LEVELS, pairs: bool = False) -> Joined:
    """All links between different sets of similarity ``threshold`` or more, each once (at the given expected recall).

    With ``pairs`` they can be listed, otherwise they are counted and connected."""
    rows = ids_and_texts(docs)
    rows = rows.select(order_id(F.col("doc_id")).alias("id"), F.xxhash64("text").alias("row_key"), "text")
    runs = runs_for(recall, branch, levels)
    first = reliable(_first_nodes(rows, n, threshold, runs, branch))
    reps = (first.where("set_id is not null").groupBy("set_id")
            .agg(F.min(F.struct("id", "row_key")).alias("rep"), F.first("nodes").alias("nodes")))
    nodes = reps.select("set_id", "rep", F.explode(F.array_distinct("nodes")).alias("node"))
    sized = _sized(nodes)
    # small buckets of the same sets are one; large ones are split further anyway
    once = (sized.where(F.col("n") <= bucket).groupBy("members", "n").agg(F.min("node").alias("node"))
            .unionByName(sized.where(F.col("n") > bucket).select("members", "n", "node")))
    large = F.col("n") > bucket
    wanted = (nodes.join(once.select("node", "n"), "node").groupBy("set_id")
              .agg(F.first("rep").alias("rep"), F.collect_list(F.when(~large, F.col("node"))).alias("small"),
                   F.collect_list(F.when(large, F.col("node"))).alias("large"))  # of one set
              .select("set_id", "rep.id", "rep.row_key", "small", "large"))
    # a repeated row is one set; its copies lie side by side after the join
    texts = rows.join(wanted, ["id", "row_key"]).dropDuplicates(["id", "row_key"]).select("set_id", "id", "small", "large", "text")
    sets = reliable(_with_sets(texts, n))
    deep = reliable(_deeper(sets, threshold, branch, levels))
    chosen = _chosen(sized.where(F.col("n") > bucket).select("node", "n"), deep, bucket, levels)
    tops = sets.select("set_id", F.explode("large").alias("node")).distinct()
    leaf = reliable(deep.select("set_id", "node").unionByName(tops).join(chosen, "node"))
    # buckets of the same sets are compared once
    same = leaf.groupBy("node").agg(F.bit_xor(F.xxhash64("set_id")).alias("members"), F.first("n").alias("n"))
    keep = same.groupBy("members", "n").agg(F.min("node").alias("node")).select("node")
    below = (leaf.join(keep, "node").groupBy("set_id")
             .agg(F.collect_list(F.struct("node", "n")).alias("below")))  # of one set
    none = F.array().cast("array<struct<node:bigint,n:bigint>>")
    leaves = F.concat(F.transform("small", lambda x: F.struct(x.alias("node"), F.lit(1).cast("bigint").alias("n"))),
                      F.coalesce("below", none))
    shipped = (sets.join(below, "set_id", "left").select("set_id", "id", "tokens", leaves.alias("all"))
               .where(F.size("all") > 0)
               .select("set_id", "id", "tokens", F.col("all.node").alias("leaves"), F.explode("all").alias("leaf")))
    blocks = F.ceil(F.col("leaf.n") / bucket).cast("int")
    block = F.pmod(F.xxhash64("set_id", "leaf.node"), blocks).cast("int")
    cells = (shipped.withColumn("blocks", blocks).withColumn("block", block)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select(F.col("leaf.node").alias("node"), F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"),
                     "block", "set_id", "id", "tokens", "leaves"))
    linked = reliable(cells.groupBy("node", "a", "b").applyInArrow(_compare(threshold, pairs), LINKED))
    classes = (first.select("id", "row_key", "set_id")
               .join(reps.select("set_id", F.struct(F.col("rep.id").alias("id"), "set_id").alias("rep")), "set_id", "left"))
    return Joined(classes, linked, pairs)


def groups(joined: Joined) -> DataFrame:
    """set_id and ``head`` (id, set_id of the first class of its group of linked classes), for linked classes.

    Each round takes the least head among the neighbours and then the head's
    own head, so paths shorten twofold and more; a round costs two joins over
    the links.
    """
    once = joined.linked.select("set_id", F.explode("tree").alias("other"))
    edges = reliable(once.unionByName(once.select(F.col("other").alias("set_id"), F.col("set_id").alias("other"))).distinct())
    reps = joined.classes.where("rep is not null").select("set_id", "rep").distinct()
    heads = reliable(edges.select("set_id").distinct().join(reps, "set_id").withColumnRenamed("rep", "head"))
    while True:
        near = (edges.join(heads.withColumnsRenamed({"set_id": "other", "head": "offered"}), "other")
                .groupBy("set_id").agg(F.min("offered").alias("offered")))
        step = heads.join(near, "set_id").select("set_id", F.least("head", "offered").alias("head"), F.col("head").alias("old"))
        jump = step.select(F.col("set_id").alias("via"), F.col("head").alias("farther"))
        new = reliable(step.withColumn("via", F.col("head.set_id")).join(jump, "via", "left")
                       .select("set_id", F.least("head", "farther").alias("head"), "old"))
        heads = new.select("set_id", "head")
        if not new.where("head <> old").limit(1).count():
            return heads


def join_documents(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.995) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (first document with the same shingles), n_links (other classes
    linked with this one), group_id (first document of its group of linked classes).  ``Joined.links`` lists the links."""
    joined = join(docs, n, threshold, recall)
    out = joined.classes.join(joined.counts(), "set_id", "left").join(groups(joined), "set_id", "left")
    mine = lambda c: F.when(c != 2**63 - 1, c)  # noqa: E731  rows without an id
    return out.select(mine(F.col("id")).alias("doc_id"), mine(F.coalesce("rep.id", "id")).alias("class_id"),
                      F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
                      mine(F.coalesce("head.id", "rep.id", "id")).alias("group_id"))


def keep_first(docs: DataFrame, n: int = 5, threshold: float = 0.8, recall: float = 0.995) -> DataFrame:
    """``docs`` with all its columns; of each group of equal or linked sets only the first document's rows stay.

    Rows without shingles stay.  Rows with one id and equal texts are the same document.
    """
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    keyed = docs.select(whole_row(docs), order_id(docs["doc_id"]).alias("id"),
                        F.xxhash64(text).alias("row_key"))
    joined = join(docs, n, threshold, recall)
    firsts = (joined.classes.where("rep is not null").groupBy("set_id").agg(F.min(F.struct("id", "row_key")).alias("first"))
              .join(groups(joined), "set_id", "left").where("head is null or head.set_id = set_id").select("first.*"))
    bare = joined.classes.where("set_id is null").select("id", "row_key").distinct()
    return keyed.join(firsts.unionByName(bare), ["id", "row_key"]).select("__tw_row.*")
