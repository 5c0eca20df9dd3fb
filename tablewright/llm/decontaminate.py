"""Benchmark decontamination by latent semantic retrieval.

1. The words of every text are hashed once and written; all later passes read
   the hashes.  Document frequencies over all documents give the IDF.
2. ``fit`` finds a latent basis by a distributed randomised SVD of TF-IDF
   passages: those of all benchmark items and of all documents.  One pass over
   the items turns a random test matrix towards them; one pass over everything
   multiplies each passage with it.  Partial products are summed by blocks of
   terms, and only the small factor reaches the driver (its size is fixed:
   terms x rank), where Nystroem's formula gives the leading directions.
3. Candidates come from two searches over every document.  Windows of 64 words
   (a step of 32), or of 32 words (a step of 16) for items of at most
   ``SHORT`` words, are projected and compared with the items by cosine:
   ``cosine`` or more is a candidate.  Exact runs of ``RUN`` words that stand
   in an item too, whatever the cosine, name the place where the item would lie.
4. A candidate is verified on the words: the longest common subsequence (LCS)
   of the item and the 128 words around the place.  It is a leak at
   an LCS of ``copied`` of the item's words, or at ``paraphrased`` if the
   answer (column ``answer`` of the benchmark) is found there as well, as a
   subsequence of ``copied`` of it.  An item without an answer is a leak at
   ``unanswered`` of its words, and ``answer_found`` is false for it.

The latent search alone finds at least 0.92 of copies in other text with up to
a quarter of their words replaced (2,000 items; figures in the README).  As the
basis has ``RANK`` directions whatever the number of items, the runs stand
behind it: of an item of more than five words in which at most a fifth of the
words is replaced, at least three in a row are left, so it is always a
candidate.  Where no three words in a row are left, the cosine alone decides.
Before the LCS, hashed marks of the words bound what a place and an item can
have in common; the bound is never too low, so nothing is lost.

Items are compared in blocks of ``ITEM_BLOCK`` or ``ITEM_BYTES``, so the
broadcast block is bounded whatever the benchmark's size.  Items longer than a passage are
searched in parts and a leak of one part counts.  Items of fewer than
``MIN_WORDS`` words say too little to be told from ordinary text by similarity:
they are leaks where all their words stand one after the other.

Words are compared in lower case without punctuation at their ends.  Null and
empty texts leak nothing.  Rows without an id are reported with a null id.
Repeated rows are judged alike.  Other columns are ignored by ``leaks`` and
pass through ``clean``.  Without documents or items nothing leaks.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, forgetting, order_id, whole_row, written
from .token_counts import slices

TERMS = 2**15
RANK = 128
OVERSAMPLE = 8
TASK_WORDS = 8_000_000  # words of a task of the fit, which sends terms x rank numbers
BLOCK = 16       # words whose vectors are summed first
PASSAGE = 4      # blocks of a passage
STEP = 2         # blocks between passages
SHORT_PASSAGE = 2  # blocks of a window that items of at most SHORT words are compared with
SHORT = 40
RUN = 3          # words of an exact run
MIX = np.uint64(0x9E3779B97F4A7C15)
ITEM_BLOCK = 4096
ITEM_BYTES = 8_000_000  # of the texts of a block
MARKS = 1024      # marks that the words of a passage set
REACH = BLOCK * (PASSAGE // 2 + STEP)  # words on either side of a place that are compared
MIN_WORDS = 8
TERM_BLOCKS = 256


PUNCTUATION = string.punctuation.encode()
NOTHING = np.uint64(xxhash.xxh3_64_intdigest(b""))


def words_of(text: bytes) -> np.ndarray:
    """Hashes of the words in lower case without punctuation at their ends, without those of which nothing is left.

    Lower case is taken of the whole text at once and each word is hashed where it stands: a table of
    known words would cost more than the hash, as most of its words are rare.
    """
    plain = text.lower() if text.isascii() else text.decode("utf-8", "replace").lower().encode()
    split = plain.split()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, map(bytes.strip, split, repeat(PUNCTUATION))), np.uint64, len(split))
    return hashes[hashes != NOTHING]


def _terms(words: np.ndarray) -> np.ndarray:
    return (words & np.uint64(TERMS - 1)).astype(np.int64)


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs.select(order_id(docs["doc_id"]).alias("id"), F.xxhash64(text).alias("row_key"), text.alias("text"))


def _binary(batch: pa.RecordBatch, name: str) -> list[bytes]:
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def hashed(rows: DataFrame) -> DataFrame:
    """id, row_key and the hashes of the words (8 bytes each) of every text, written once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for part in slices(_binary(batch, "text"), 2_000_000):
                words = pa.array([words_of(t).tobytes() for t in part], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(part)), batch.column(1).slice(at, len(part)), words],
                                                 ["id", "row_key", "words"])
                at += len(part)

    return written(rows.select("id", "row_key", "text").mapInArrow(forgetting(run), "id bigint, row_key bigint, words binary"))


def _words_in(batch: pa.RecordBatch) -> list[np.ndarray]:
    """The hashes of each text, as views of the batch."""
    return [np.frombuffer(w.as_buffer(), np.uint64) for w in batch.column(batch.schema.get_field_index("words"))]


def _block_rows(values: np.ndarray) -> pa.RecordBatch:
    """A terms x anything array as TERM_BLOCKS rows."""
    parts = np.split(values, TERM_BLOCKS)
    return pa.RecordBatch.from_arrays([pa.array(range(TERM_BLOCKS), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())],
                                      ["block", "part"])


def _sum_blocks(partial: DataFrame, dtype: type, out: type = np.float64) -> np.ndarray:
    """Sums partial arrays block by block on Spark; the result has a fixed size."""
    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(p.as_buffer(), dtype).astype(np.float64) for p in table.column("part"))
        return pa.table([pa.array([table.column("block")[0].as_py()], pa.int32()), pa.array([total.astype(out).tobytes()], pa.binary())],
                        ["block", "part"])

    rows = partial.groupBy("block").applyInArrow(add, "block int, part binary").collect()
    if not rows:
        return np.zeros(0)
    size = len(rows[0]["part"]) // np.dtype(out).itemsize
    total = np.empty(TERM_BLOCKS * size, out)
    while rows:  # each row goes as soon as it is copied
        block, part = rows.pop()
        total[block * size:(block + 1) * size] = np.frombuffer(part, out)
    return total


def term_weights(texts: DataFrame) -> tuple[np.ndarray, int, int, int]:
    """IDF of each hashed term over all documents of ``hashed``, and the number of documents, of their passages and of their words."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(TERMS, np.int64), np.zeros(3, np.int64)
        for batch in batches:
            for words in _words_in(batch):
                counts[np.unique(_terms(words))] += 1
                sums += 1, _n_passages(len(words)), len(words)
        if sums[0]:  # the sums have three places in each block
            split = np.concatenate([counts.reshape(TERM_BLOCKS, -1), np.tile(sums, (TERM_BLOCKS, 1))], axis=1)
            yield _block_rows(split.ravel())

    total = _sum_blocks(texts.select("words").mapInArrow(forgetting(count), "block int, part binary"), np.int64)
    if not len(total):
        return np.zeros(TERMS, np.float32), 0, 0, 0
    total = total.reshape(TERM_BLOCKS, -1)
    n, n_passages, n_words = (int(x) for x in total[0, -3:])
    return (1 + np.log((1 + n) / (1 + total[:, :-3].ravel()))).astype(np.float32), n, n_passages, n_words  # no term is without weight


class Basis:
    """TF-IDF weights and the latent basis: terms x rank."""

    def __init__(self, idf: np.ndarray, vectors: np.ndarray):
        #: a row per term, and one of zeros for places without a word
        self.weighted = np.zeros((TERMS + 1, vectors.shape[1]), np.float32)
        np.multiply(idf[:, None], vectors, out=self.weighted[:TERMS])

    def blocks(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sums of the word vectors of each block, the text and first word of each, and the number of blocks of each text."""
        lengths = np.array([len(t) for t in texts])
        n_blocks = -(-lengths // BLOCK)
        of_block = np.repeat(np.arange(len(texts)), n_blocks)
        first = np.r_[0, np.cumsum(n_blocks)][:-1]
        begin = (np.arange(len(of_block)) - first[of_block]) * BLOCK
        sums = np.zeros((len(of_block), self.weighted.shape[1]), np.float32)
        # every text filled up to whole blocks, so that the n-th words of all blocks are added at once
        place = np.arange(lengths.sum()) + np.repeat(first * BLOCK - np.r_[0, np.cumsum(lengths)][:-1], lengths)
        terms = np.full(len(of_block) * BLOCK, TERMS, np.int64)
        terms[place] = _terms(np.concatenate(texts)) if len(texts) else 0
        terms = np.ascontiguousarray(terms.reshape(-1, BLOCK).T)
        for a in range(0, len(sums), 1024):
            for nth in terms[:, a:a + 1024]:
                sums[a:a + 1024] += self.weighted[nth]
        return sums, of_block, begin, n_blocks

    def passages(self, blocks: tuple, size: int = PASSAGE, step: int = STEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unit vectors of all windows of ``size`` blocks, with the text and the first word of each."""
        sums, of_block, begin, n_blocks = blocks
        # every step-th block of a text begins a window, as long as words are left that no window before holds
        at = begin // BLOCK
        chosen = np.flatnonzero((at % step == 0) & ((at == 0) | (at + size - step < n_blocks[of_block])))
        total = sums[chosen]
        for s in range(1, size):
            more = np.flatnonzero(at[chosen] + s < n_blocks[of_block[chosen]])
            total[more] += sums[chosen[more] + s]
        total /= np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-12)
        return total, of_block[chosen], begin[chosen]


def _n_passages(n_words: int) -> int:
    """Passages that a text is cut into for the fit, none longer than 1.5 times the others."""
    return max(1, round(n_words / (BLOCK * PASSAGE))) if n_words else 0


def _sparse_rows(texts: list[np.ndarray], idf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Term ids and TF-IDF weights of every passage of some texts, as unit vectors."""
    lengths = np.array([len(t) for t in texts], np.int64)
    parts = np.array([_n_passages(n) for n in lengths.tolist()], np.int64)
    if not parts.sum():
        return
    at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    passage = np.repeat(np.cumsum(parts) - parts, lengths) + at * np.repeat(parts, lengths) // np.repeat(lengths, lengths)
    key, tf = np.unique(passage * TERMS + _terms(np.concatenate(texts)), return_counts=True)
    passage, ids = key // TERMS, key % TERMS
    w = tf * idf[ids].astype(np.float64)
    w = (w / np.sqrt(np.bincount(passage, w * w))[passage]).astype(np.float32)
    edges = np.r_[0, np.cumsum(np.bincount(passage))].tolist()
    for a, b in zip(edges, edges[1:]):
        yield ids[a:b], w[a:b]


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a^T b, added up in double precision a few rows at a time."""
    return sum(a[i:i + 2048].astype(np.float64).T @ b[i:i + 2048] for i in range(0, len(a), 2048))


def _times_in_place(m: np.ndarray, small: np.ndarray) -> np.ndarray:
    """``m @ small`` in the place of the first columns of ``m``, as the driver has no room for several such matrices."""
    small = small.astype(np.float32)
    for i in range(0, len(m), 2048):
        m[i:i + 2048, :small.shape[1]] = m[i:i + 2048] @ small
    return m[:, :small.shape[1]]


def _orthonormal(m: np.ndarray) -> np.ndarray:
    """Orthonormal columns that span those of ``m``, in its place, by way of its small Gram matrix; zeros where ``m`` has fewer directions."""
    values, vectors = np.linalg.eigh(_products(m, m))
    kept = values > 1e-12 * max(values[-1], 1e-300)
    return _times_in_place(m, vectors * np.where(kept, 1 / np.sqrt(np.where(kept, values, 1)), 0))


def _times(texts: DataFrame, idf, matrix: np.ndarray, items_weight: float, n_tasks: int) -> np.ndarray:
    """The sum over all passages a of a^T (a ``matrix``); ``texts``: words, and is_item for those of the given weight."""
    shared = texts.sparkSession.sparkContext.broadcast(matrix)
    width = matrix.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, out, seen = shared.value, np.zeros((TERMS, width), np.float32), False
        for batch in batches:
            is_item = batch.column(batch.schema.get_field_index("is_item")).to_numpy(zero_copy_only=False)
            at = 0
            for part in slices(_words_in(batch), 250_000):
                own = is_item[at:at + len(part)]
                at += len(part)
                for chosen, weight in ((own, items_weight), (~own, 1.0)):
                    for ids, w in _sparse_rows([part[i] for i in np.flatnonzero(chosen)], idf.value):
                        out[ids] += w[:, None] * (weight * (w @ m[ids]))
                        seen = True
        if seen:
            yield _block_rows(out)

    total = _sum_blocks(texts.coalesce(n_tasks).mapInArrow(forgetting(run), "block int, part binary"), np.float32, np.float32)
    shared.destroy()
    return total.reshape(TERMS, width) if len(total) else np.zeros((TERMS, width), np.float32)


def fit(docs: DataFrame, items: DataFrame, idf: np.ndarray, n_passages: int, n_words: int, n_items: int, rank: int = RANK) -> Basis:
    """Randomised SVD of the TF-IDF passages of all documents and items (both ``hashed``): right singular vectors."""
    sc = docs.sparkSession.sparkContext
    # items together weigh twice the documents, or the basis would not tell one item from another
    weight = 2.0 * max(n_passages, 1) / max(n_items, 1)
    n_tasks = max(sc.defaultParallelism, math.ceil(n_words / TASK_WORDS))
    idf_b = sc.broadcast(idf)
    own = items.select("words", F.lit(True).alias("is_item"))
    m = np.random.default_rng(5).standard_normal((TERMS, rank + OVERSAMPLE)).astype(np.float32)
    # towards the items; where they have fewer directions the random ones stay
    turned = _times(own, idf_b, m, 1.0, n_tasks)
    turned += m * np.float32(0.01 * max(np.linalg.norm(turned), 1e-6) / np.linalg.norm(m))
    m = _orthonormal(_orthonormal(turned))
    del turned
    forget()
    found = _times(docs.select("words", F.lit(False).alias("is_item")).unionByName(own), idf_b, m, weight, n_tasks)
    idf_b.destroy()
    # Nystroem: with Y = G M of the Gram matrix G, G is about Y (M^T Y)^-1 Y^T; a small shift keeps the inverse sound
    shift = np.float32(1e-6 * np.linalg.norm(found))
    found += shift * m
    core = _products(m, found)
    del m
    values, vectors = np.linalg.eigh((core + core.T) / 2)
    root = vectors / np.sqrt(np.maximum(values, max(float(shift), 1e-30)))
    values, vectors = np.linalg.eigh(root.T @ _products(found, found) @ root)
    kept = values > 1e-5 * max(values[-1], 1e-300)
    small = root @ (vectors * np.where(kept, 1 / np.sqrt(np.where(kept, values, 1)), 0))
    basis = Basis(idf, _times_in_place(found, small[:, ::-1][:, :rank]))
    del found
    forget()
    return basis


def _lcs(place: dict[int, int], m: int, words: list[int]) -> int:
    """Length of the longest common subsequence; ``place``: bit mask of the positions of each word among the m of one side."""
    full = (1 << m) - 1
    row = full
    for w in words:
        hit = place.get(w)
        if hit:
            u = row & hit
            row = (row + u | row - u) & full
    return m - row.bit_count()


def _places(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


class Runs:
    """Hashed runs of ``RUN`` words of items: where each stands, ready to be looked up for many texts at once."""

    def __init__(self, places: list[tuple[int, int, int]]):
        hashes = np.array([h for h, _, _ in places], np.uint64)
        order = np.argsort(hashes, kind="stable")
        self.keys, self.first, self.count = np.unique(hashes[order], return_index=True, return_counts=True)
        self.part = np.array([p for _, p, _ in places], np.int64)[order]
        self.at = np.array([i for _, _, i in places], np.int64)[order]
        bits = min(max(len(self.keys).bit_length() + 5, 12), 23)
        self.shift = np.uint64(64 - bits)
        self.seen = np.zeros(1 << bits, bool)  # most runs of a text end here
        self.seen[(self.keys >> self.shift).astype(np.int64)] = True

    def find(self, hashes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Where the hashes stand in items: index of the hash, part, place in the part; in bounded batches."""
        if not len(self.keys):
            return
        at = np.flatnonzero(self.seen[(hashes >> self.shift).astype(np.int64)])
        key = np.searchsorted(self.keys, hashes[at])
        same = self.keys[np.minimum(key, len(self.keys) - 1)] == hashes[at]
        at, key = at[same], key[same]
        total = np.cumsum(self.count[key])
        for batch in np.split(np.arange(len(at)), np.searchsorted(total, np.arange(1_000_000, total[-1], 1_000_000)) if len(at) else []):
            n = self.count[key[batch]]
            place = np.repeat(self.first[key[batch]] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            yield np.repeat(at[batch], n), self.part[place], self.at[place]


def _run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each ``n`` consecutive words."""
    size = max(0, len(words) - n + 1)
    out = np.zeros(size, np.uint64)
    for i in range(n):
        out = out * MIX + words[i:i + size]
    return out * MIX


class Items:
    """A block of items, in parts no longer than 1.5 passages, ready to be compared."""

    def __init__(self, rows: list[tuple], basis: Basis):
        self.item, self.words, self.answers = [], [], []
        size = BLOCK * PASSAGE
        for item_id, text, answer in rows:
            words = words_of((text or "").encode())
            if not len(words):
                continue
            own = words_of((answer or "").encode()).tolist()
            parts = max(1, round(len(words) / size))
            for part in np.array_split(words, parts):
                self.item.append(item_id)
                self.words.append(part)
                self.answers.append(own)
        self.vectors = np.zeros((len(self.words), basis.weighted.shape[1]), np.float32)
        for i, part in enumerate(self.words):
            v = basis.weighted[_terms(part)].sum(axis=0)
            self.vectors[i] = v / max(np.linalg.norm(v), 1e-12)
        self.lists = [w.tolist() for w in self.words]
        self.places = [_places(w) for w in self.lists]
        self.answer_places = [_places(a) for a in self.answers]
        lengths = np.array([len(w) for w in self.words], np.int64)
        self.runs = Runs([(h, i, k) for i, part in enumerate(self.words) if len(part) >= MIN_WORDS
                          for k, h in enumerate(_run_hashes(part, RUN).tolist())])
        #: words of a run -> the short items that begin with it
        self.short = {n: Runs([(int(_run_hashes(self.words[i][:n], n)[0]), i, 0) for i in np.flatnonzero((lengths < MIN_WORDS) & (np.minimum(lengths, RUN) == n))])
                      for n in range(1, RUN + 1)}
        self.middle = lengths // 2
        #: marks of the words of each part, filled up with one that no passage sets
        self.marks = np.full((len(self.words), max(map(len, self.words), default=0)), MARKS, np.int16)
        for i, part in enumerate(self.words):
            self.marks[i, :len(part)] = _marks(part)
        self.lengths = lengths
        #: blocks of a window -> the parts compared with windows of that size
        self.by_window = {n: np.flatnonzero((lengths >= MIN_WORDS) & ((lengths <= SHORT) == (n == SHORT_PASSAGE))) for n in (SHORT_PASSAGE, PASSAGE)}


def _marks(words: np.ndarray) -> np.ndarray:
    return (words >> np.uint64(20) & np.uint64(MARKS - 1)).astype(np.int16)


class Passages:
    """The words of some texts as marks, to tell which places cannot hold enough words of an item."""

    def __init__(self, words: np.ndarray, first: np.ndarray):
        self.marks, self.first = _marks(words), first

    def plausible(self, of: np.ndarray, middle: np.ndarray, part: np.ndarray, items: Items, least: np.ndarray) -> np.ndarray:
        """Where the words around a place set as many marks of a part's words as it must have in common; never less than the words themselves."""
        if not len(of):
            return np.zeros(0, bool)
        size = np.int64(self.first[-1] + 2 * REACH + 1)
        place, row = np.unique(of * size + middle, return_inverse=True)
        place_of, place_middle = place // size, place % size
        out = np.zeros(len(of), bool)
        order = np.argsort(row, kind="stable")
        edges = np.searchsorted(row[order], np.arange(0, len(place), 4096))
        for a, chosen in zip(range(0, len(place), 4096), np.split(order, edges[1:])):
            at = place_middle[a:a + 4096, None] + np.arange(-REACH, REACH)
            own = place_of[a:a + 4096, None]
            inside = (at >= 0) & (at < self.first[own + 1] - self.first[own])
            held = np.zeros((len(at), MARKS + 1), bool)
            held[np.nonzero(inside)[0], self.marks[(at + self.first[own])[inside]]] = True
            for b in range(0, len(chosen), 65_536):
                some = chosen[b:b + 65_536]
                common = held[row[some, None] - a, items.marks[part[some]]].sum(axis=1)
                out[some] = common >= least[part[some]] * items.lengths[part[some]]
        return out


def _candidates(texts: list[np.ndarray], basis: Basis, items: Items, cosine: float, least: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(text, middle, part) of places worth a comparison: similar windows, and runs of words that an item holds too.

    ``least``: share of its words that each part must have around the place.  A
    short item comes with the middle of the words equal to it.
    """
    lengths = np.array([len(t) for t in texts])
    first = np.r_[0, np.cumsum(lengths)]
    words = np.concatenate(texts)
    around = Passages(words, first)
    sums = None
    for n, parts in items.by_window.items():
        if len(parts):
            sums = sums or basis.blocks(texts)
            vectors, of, begin = basis.passages(sums, n, max(1, n // 2))
            query = items.vectors[parts].T
            for a in range(0, len(vectors), 8192):
                p, q = np.nonzero(vectors[a:a + 8192] @ query >= cosine)
                found = of[a + p], begin[a + p] + n * BLOCK // 2, parts[q]
                some = around.plausible(*found, items, least)
                yield from zip(*(x[some].tolist() for x in found))
    for at, part, place in items.runs.find(_run_hashes(words, RUN)):
        of = np.searchsorted(first, at, "right") - 1
        inside = at + RUN <= first[of + 1]
        middle = np.maximum((at - first[of] - place + items.middle[part] + BLOCK // 2) // BLOCK * BLOCK, 0)
        found = of[inside], middle[inside], part[inside]
        some = around.plausible(*found, items, least)
        yield from zip(*(x[some].tolist() for x in found))
    for n, runs in items.short.items():
        for at, part, _ in runs.find(_run_hashes(words, n)) if len(runs.keys) else ():
            of = np.searchsorted(first, at, "right") - 1
            for t, start, q in zip(of.tolist(), (at - first[of]).tolist(), part.tolist()):
                if texts[t][start:start + len(items.words[q])].tolist() == items.lists[q]:
                    yield t, start + int(items.middle[q]), q


def _search(words: list[np.ndarray], basis: Basis, items: Items, cosine: float, copied: float, paraphrased: float, unanswered: float
            ) -> Iterator[tuple[int, int, float, float, bool]]:
    """(text, item id, cosine, LCS share, answer found) of each leak, the best passage of each text and item."""
    some = [i for i, w in enumerate(words) if len(w)]
    if not some or not items.words:
        return
    best: dict[tuple[int, int], tuple[float, float, bool]] = {}
    needed = np.array([paraphrased if a else unanswered for a in items.answers])
    for t, middle, q in set(_candidates([words[i] for i in some], basis, items, cosine, needed)):
        text = words[some[t]]
        m, place = len(items.words[q]), items.places[q]
        passage = text[max(0, middle - REACH):middle + REACH].tolist()
        held = set(passage)
        answer = items.answers[q]
        least, sure = (paraphrased, copied) if answer else (unanswered, unanswered)
        if sum([w in held for w in items.lists[q]]) < least * m:
            continue
        passage = [w for w in passage if w in place or w in items.answer_places[q]]
        share = _lcs(place, m, passage) / m
        if share < least:
            continue
        found = bool(answer) and _lcs(items.answer_places[q], len(answer), passage) >= copied * len(answer)
        if share >= sure or found:
            half = BLOCK * (SHORT_PASSAGE if m <= SHORT else PASSAGE) // 2
            v = basis.weighted[_terms(text[max(0, middle - half):max(0, middle + half)])].sum(axis=0)
            similar = float(v @ items.vectors[q] / max(np.linalg.norm(v), 1e-12))
            key, new = (some[t], items.item[q]), (share, similar, found)
            best[key] = max(best.get(key, new), new)
    for (text, item), (share, c, found) in best.items():
        yield text, item, c, share, found


LEAKS = "id bigint, row_key bigint, item_id bigint, cosine double, lcs_share double, answer_found boolean"


def _leaks(rows: DataFrame, benchmark: DataFrame, cosine: float, copied: float, paraphrased: float, unanswered: float) -> DataFrame:
    spark = rows.sparkSession
    answer = benchmark["answer"] if "answer" in benchmark.columns else F.lit(None)
    items = benchmark.select(benchmark["item_id"].cast("bigint").alias("item_id"), benchmark["text"].cast("string").alias("text"),
                             answer.cast("string").alias("answer")).where("text is not null")
    n_items, n_bytes = items.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    none = spark.createDataFrame([], LEAKS)
    if not n_items:
        return none
    texts = hashed(rows)
    idf, n_docs, n_passages, n_words = term_weights(texts)
    if not n_docs:
        return none
    item_words = hashed(items.select(F.col("item_id").alias("id"), F.lit(0).cast("bigint").alias("row_key"), "text"))
    own = fit(texts, item_words, idf, n_passages, n_words, n_items)
    basis = spark.sparkContext.broadcast(own)
    blocks = math.ceil(max(n_items / ITEM_BLOCK, n_bytes / ITEM_BYTES))
    found = none
    for b in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()  # about ITEM_BLOCK rows, or ITEM_BYTES
        query = spark.sparkContext.broadcast(Items([tuple(r) for r in block], own))

        def run(batches: Iterator[pa.RecordBatch], query=query) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                at = 0
                for part in slices(_words_in(batch), 300_000):
                    out = [(ids[at + t], keys[at + t], *rest) for t, *rest in
                           _search(part, basis.value, query.value, cosine, copied, paraphrased, unanswered)]
                    at += len(part)
                    if out:
                        types = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.bool_())
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)],
                                                         [f.split(" ")[0] for f in LEAKS.split(", ")])

        found = found.unionByName(texts.mapInArrow(forgetting(run), LEAKS))
    return found


def leaks(docs: DataFrame, benchmark: DataFrame, cosine: float = 0.6, copied: float = 0.8, paraphrased: float = 0.6,
          unanswered: float = 0.65) -> DataFrame:
    """doc_id, item_id, cosine, lcs_share and answer_found of each document and item of which a passage is a leak."""
    found = _leaks(_rows(docs), benchmark, cosine, copied, paraphrased, unanswered)
    return found.select(F.when(F.col("id") != 2**63 - 1, F.col("id")).alias("doc_id"), "item_id", "cosine", "lcs_share", "answer_found")


def clean(docs: DataFrame, benchmark: DataFrame, cosine: float = 0.6, copied: float = 0.8, paraphrased: float = 0.6,
          unanswered: float = 0.65) -> DataFrame:
    """``docs`` with all its columns, without the documents that leak an item."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    keyed = docs.select(whole_row(docs), order_id(docs["doc_id"]).alias("id"),
                        F.xxhash64(text).alias("row_key"))
    found = _leaks(_rows(docs), benchmark, cosine, copied, paraphrased, unanswered).select("id", "row_key").distinct()
    return keyed.join(found, ["id", "row_key"], "left_anti").select("__tw_row.*")
