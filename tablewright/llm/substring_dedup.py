"""Substring dedup by De Bruijn compaction of repeated token k-mers.

Every window of ``k`` words is an edge between its first and its last k - 1
words.  An edge that starts in several documents is repeated; a path of
repeated edges that follow one another both here and in the earliest document
that holds them does not branch, and is compacted into one span (document,
start, number of windows) with its source coordinates (earliest document,
start there).  Words covered by a span are removed, and the earliest document
keeps its copy.

How it runs at scale:

* Edges are dealt into buckets by their minimizer (the least hash among the
  short runs of words inside the window).  Equal windows have equal minimizers,
  so they meet, and windows that follow one another mostly share theirs, so
  paths arrive in one piece.
* A task sorts the windows of a few million words at a time and sends each
  distinct edge once, with its earliest document; documents that repeat an
  edge already seen in that part are settled there.  A passage in a third of
  all documents is therefore one edge per part, not a hot key.
* Path pieces of different buckets are joined into spans by (document, end) =
  (document, start), and verified against the source coordinates: they stay
  one span only where the source goes on as well.

Windows are compared by 56 bits of their words' hash inside a bucket, and the
buckets (four per shuffle partition) grow with the input: with n windows of
which a bucket holds m, n * m / 2^57 pairs of different windows may be taken
for equal (0.0006 at 140 million windows).  Null and empty texts have no words; texts of under ``k`` words keep
all.  Rows without an id come after all others.  Rows with one id are one
document to others (never "smaller" than each other).  Other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD_HASHES, ids_and_texts, order_id, partitions

MINIMIZER_WORDS = 5
PART_WORDS = 1_500_000
HASH_BYTES = 7
PIECES = "id bigint, row_key bigint, start int, n int, src_id bigint, src_start int"


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))


def run_hashes(words: np.ndarray, length: int, seed: int) -> np.ndarray:
    """Hash of each run of ``length`` words: a sum with one random odd factor for each place."""
    factors = np.random.default_rng(seed).integers(0, 2**63, length, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    n = len(words) - length + 1
    total = np.zeros(max(n, 0), np.uint64)
    with np.errstate(over="ignore"):
        for j, f in enumerate(factors if n > 0 else ()):
            total += words[j:j + n] * f
    return mix(total)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive values."""
    span, out = 1, values
    while 2 * span <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return np.minimum(out[:len(out) - rest], out[rest:]) if rest else out


class _Part:
    """Windows of a few million words: the task's side of the dealing."""

    def __init__(self, k: int, buckets: int):
        self.k, self.buckets = k, buckets
        self.clear()

    def clear(self) -> None:
        self.ids, self.keys, self.words, self.total = [], [], [], 0

    def add(self, doc_id: int, row_key: int, text: bytes) -> None:
        words = text.split()
        if len(words) >= self.k:
            self.ids.append(doc_id)
            self.keys.append(row_key)
            self.words.append(np.fromiter(map(WORD_HASHES.__getitem__, words), np.uint64, len(words)))
            self.total += len(words)

    def deal(self) -> Iterator[pa.RecordBatch]:
        """One row per bucket: edges with their first place, and the pieces already settled in this part."""
        if not self.ids:
            return
        k, lengths = self.k, np.array([len(w) for w in self.words])
        starts = np.r_[0, np.cumsum(lengths)[:-1]]
        flat = np.concatenate(self.words)
        self.words = []
        edge = run_hashes(flat, k, 1)
        least = _least(run_hashes(flat, min(MINIMIZER_WORDS, k), 2), k - min(MINIMIZER_WORDS, k) + 1)
        doc = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        place = np.flatnonzero(doc[:len(edge)] == doc[k - 1:])  # windows inside one document
        edge, least, doc = edge[place], least[place], doc[place]
        bucket = (mix(least) % np.uint64(self.buckets)).astype(np.int32)
        ids, keys = np.array(self.ids, np.int64), np.array(self.keys, np.int64)
        # equal edges side by side, the earliest document (and place in it) first
        order = np.lexsort((place, ids[doc], edge))
        edge, sorted_doc, place, bucket = edge[order], doc[order], place[order], bucket[order]
        first = np.flatnonzero(np.r_[True, edge[1:] != edge[:-1]])
        leader = np.repeat(first, np.diff(np.r_[first, len(edge)]))
        sid = ids[sorted_doc]
        later = sid != sid[leader]
        settled = _pieces(sid[later], keys[sorted_doc[later]], (place - starts[sorted_doc])[later],
                          sid[leader][later], (place - starts[sorted_doc])[leader][later])
        keep = np.flatnonzero(~later)
        at = np.argsort(bucket[keep].astype(np.int64) << 33 | place[keep])
        keep = keep[at]
        edge, place, bucket = edge[keep], place[keep], bucket[keep]
        cuts = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(bucket)]
        pieces = len(settled[0])
        rows, n = [], max(len(cuts) - 1, 1)
        for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            docs, of = np.unique(sorted_doc[keep[a:b]], return_inverse=True)
            steps = np.diff(place[a:b], prepend=0).astype(np.int32)
            share = slice(pieces * i // n, pieces * (i + 1) // n)
            rows.append((int(bucket[a]), edge[a:b, None].view(np.uint8)[:, :HASH_BYTES].tobytes(), steps.view(np.uint8).reshape(-1, 4).T.tobytes(),
                         ids[docs].tobytes(), keys[docs].tobytes(), starts[docs].astype(np.int64).tobytes(),
                         b"".join(c[share].astype(np.int64).tobytes() for c in settled)))
        self.clear()
        columns = list(zip(*rows))
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])],
                                         [f.split(" ")[0] for f in DEALT.split(", ")])


DEALT = "bucket int, edges binary, steps binary, ids binary, keys binary, starts binary, settled binary"


def _pieces(ids, keys, places, src_ids, src_places) -> list[np.ndarray]:
    """Compacts windows that follow one another here and in the source: id, key, start, n, source id, source start."""
    order = np.lexsort((places, keys, ids))
    ids, keys, places, src_ids, src_places = (x[order] for x in (ids, keys, places, src_ids, src_places))
    if not len(ids):
        return [ids, keys, places, places, src_ids, src_places]
    goes_on = ((ids[1:] == ids[:-1]) & (keys[1:] == keys[:-1]) & (places[1:] == places[:-1] + 1)
               & (src_ids[1:] == src_ids[:-1]) & (src_places[1:] == src_places[:-1] + 1))
    at = np.flatnonzero(np.r_[True, ~goes_on])
    return [ids[at], keys[at], places[at], np.diff(np.r_[at, len(ids)]), src_ids[at], src_places[at]]


def _meet(table: pa.Table) -> pa.Table:
    """One bucket: pieces of repeated paths, from the edges that all parts sent."""
    edges, ids, keys, places, settled = [], [], [], [], []
    for row in table.to_pylist():
        packed = np.frombuffer(row["edges"], np.uint8).reshape(-1, HASH_BYTES)
        edge = np.pad(packed, ((0, 0), (0, 8 - HASH_BYTES))).view(np.uint64).ravel()
        place = np.cumsum(np.frombuffer(row["steps"], np.uint8).reshape(4, -1).T.copy().view(np.int32).ravel(), dtype=np.int64)
        start = np.frombuffer(row["starts"], np.int64)
        doc = np.searchsorted(start, place, "right") - 1
        edges.append(edge)
        ids.append(np.frombuffer(row["ids"], np.int64)[doc])
        keys.append(np.frombuffer(row["keys"], np.int64)[doc])
        places.append(place - start[doc])
        settled.append(np.frombuffer(row["settled"], np.int64).reshape(6, -1))
    edges, ids, keys, places = map(np.concatenate, (edges, ids, keys, places))
    order = np.lexsort((places, ids, edges))
    edges, ids, keys, places = edges[order], ids[order], keys[order], places[order]
    first = np.flatnonzero(np.r_[True, edges[1:] != edges[:-1]])
    leader = np.repeat(first, np.diff(np.r_[first, len(edges)]))
    later = ids != ids[leader]
    found = _pieces(ids[later], keys[later], places[later], ids[leader][later], places[leader][later])
    out = [np.concatenate([a, *(s[i] for s in settled)]) for i, a in enumerate(found)]
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32())
    return pa.table([pa.array(c).cast(t) for c, t in zip(out, types)], [f.split(" ")[0] for f in PIECES.split(", ")])


def _rows(docs: DataFrame) -> DataFrame:
    """id (orders the documents), row_key (of the text, so that rows with one id stay apart), doc_id and text."""
    rows = ids_and_texts(docs)
    return rows.select(order_id(F.col("doc_id")).alias("id"), F.xxhash64("text").alias("row_key"), "doc_id", "text")


def path_pieces(rows: DataFrame, k: int) -> DataFrame:
    buckets = 4 * partitions(rows.sparkSession)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = _Part(k, buckets)
        for batch in batches:
            for doc_id, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                         batch.column(2).cast(pa.binary()).to_pylist()):
                part.add(doc_id, key, text)
                if part.total >= PART_WORDS:
                    yield from part.deal()
        yield from part.deal()

    return rows.select("id", "row_key", "text").mapInArrow(deal, DEALT).groupBy("bucket").applyInArrow(_meet, PIECES)


def repeated_spans(docs: DataFrame, k: int = 13) -> DataFrame:
    """Maximal nonbranching repeated paths: id, row_key, start, n (windows), src_id, src_start."""
    return _compact(path_pieces(_rows(docs), k))


def _compact(pieces: DataFrame) -> DataFrame:
    """Joins pieces end to start; a document's pieces stand side by side, and no window sees more than one document's."""
    by = Window.partitionBy("id", "row_key").orderBy("start", "src_id")
    before = F.lag(F.struct("start", "n", "src_id", "src_start")).over(by)
    goes_on = ((F.col("b.start") + F.col("b.n") == F.col("start")) & (F.col("b.src_id") == F.col("src_id"))
               & (F.col("b.src_start") + F.col("b.n") == F.col("src_start")))
    path = F.sum(F.when(goes_on, 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, 0))
    return (pieces.withColumn("b", before).withColumn("path", path).groupBy("id", "row_key", "path")
            .agg(F.min("start").alias("start"), F.sum("n").cast("int").alias("n"), F.min("src_id").alias("src_id"),
                 F.min("src_start").alias("src_start")).drop("path"))


def _cut(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals, removed, kept = [], [], []
            for text, starts, lengths in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2), batch.column(3)):
                words = text.split()
                totals.append(len(words))
                if starts.is_valid and len(starts):
                    at, n = starts.values.to_numpy(), lengths.values.to_numpy()
                    cover = np.zeros(len(words) + 1, np.int32)
                    np.add.at(cover, at, 1)
                    np.add.at(cover, at + n + k - 1, -1)
                    free = np.cumsum(cover[:-1]) == 0
                    words = [w for w, stays in zip(words, free.tolist()) if stays]
                removed.append(totals[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()),
                                              pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_text"])
    return run


def substring_dedup(docs: DataFrame, k: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (the words that stay, joined by one space) of every row."""
    rows = _rows(docs)
    spans = (_compact(path_pieces(rows, k)).groupBy("id", "row_key")
             .agg(F.collect_list(F.struct("start", "n")).alias("spans")))  # of one document
    return (rows.join(spans, ["id", "row_key"], "left")
            .select("doc_id", "text", F.col("spans.start").alias("starts"), F.col("spans.n").alias("lengths"))
            .mapInArrow(_cut(k), "doc_id bigint, n_words bigint, n_removed bigint, kept_text string"))


def digests(docs: DataFrame, k: int = 13) -> DataFrame:
    out = substring_dedup(docs, k)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
