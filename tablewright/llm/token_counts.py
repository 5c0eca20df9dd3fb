"""Token counts by rank-synchronous array merging (byte-level BPE).

Distinct pre-tokens are held as one ragged numpy array of symbol ids.  In each
round every sequence applies its own lowest-rank pair, everywhere it occurs
from left to right, and all sequences do so at once; a sequence without a
known pair is done, and the symbols that survive are its token count.  A
token's merge always ranks after the merges that make its parts, so applying
all occurrences of the lowest pair together equals one merge at a time.

Null and empty texts have no bytes and no tokens.  Rows are counted one by
one; repeated rows and ids get equal counts; other columns are ignored.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ids_and_texts

# Fixed value that decides results: how the byte-level vocabulary splits text before the merges.
PRE_TOKEN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
             r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+")
NO_RANK = np.int32(2**31 - 1)


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(printable) else chr(next(spare)) for b in range(256)]


class PairRanks:
    """Merges as a hash table of pair keys: lookup of many pairs at once."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.width = np.int64(max(vocab.values()) + 1)
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        self.keys = left * self.width + right  # by rank
        self.slots = np.full(2**20 + len(merges) + 1, -1, np.int32)
        for rank, slot in enumerate(self._slot(self.keys).tolist()):
            while self.slots[slot] >= 0:
                slot += 1
            self.slots[slot] = rank
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int32)  # by rank
        self.of_byte = np.array([vocab[c] for c in byte_alphabet()], np.int32)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, or NO_RANK."""
        key = left.astype(np.int64) * self.width + right
        slot = self._slot(key)
        at = self.slots[slot]
        other = np.flatnonzero((at >= 0) & (self.keys[at] != key))
        while len(other):  # another pair's slot: look at the next one
            slot[other] += 1
            at[other] = self.slots[slot[other]]
            other = other[(at[other] >= 0) & (self.keys[at[other]] != key[other])]
        return np.where(at >= 0, at, NO_RANK)

    def count(self, words: list[bytes]) -> np.ndarray:
        """Tokens of each word."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        counts = lengths.copy()
        symbols = self.of_byte[np.frombuffer(b"".join(words), np.uint8)]
        sequence = np.repeat(np.arange(len(words)), lengths)
        chosen = lengths[sequence] > 1 if len(words) else np.zeros(0, bool)
        symbols, sequence = symbols[chosen], sequence[chosen]
        while len(symbols):
            starts = np.flatnonzero(np.r_[True, sequence[1:] != sequence[:-1]])
            rank = np.full(len(symbols), NO_RANK, np.int32)  # of the pair that begins here
            inside = np.flatnonzero(sequence[1:] == sequence[:-1])
            rank[inside] = self.rank(symbols[inside], symbols[inside + 1])
            lowest = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.r_[starts, len(symbols)]))
            merge = (rank == lowest) & (rank != NO_RANK)
            # in a run of overlapping pairs (x x x ...) every second one merges, from the left
            at = np.flatnonzero(merge)
            run = np.flatnonzero(np.r_[True, np.diff(at) != 1]) if len(at) else at
            place = np.arange(len(at)) - np.repeat(run, np.diff(np.r_[run, len(at)]))
            at = at[place % 2 == 0]
            symbols[at] = self.merged[rank[at]]
            keep = lowest != NO_RANK
            done = np.zeros(len(symbols), bool)
            done[at + 1] = True
            finished = sequence[starts[~keep[starts]]]
            ends = np.diff(np.r_[starts, len(symbols)])[~keep[starts]]
            counts[finished] = ends
            keep &= ~done
            symbols, sequence = symbols[keep], sequence[keep]
        return counts


class TokenCounter:
    """Counts tokens of texts; remembers up to ``remember`` distinct chunks."""

    def __init__(self, spec: str, remember: int = 400_000):
        data = json.loads(spec)
        self.ranks = PairRanks(data["model"]["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" "))
                                                        for m in data["model"]["merges"]])
        self.special = [t["content"] for t in data["added_tokens"]]
        self.at_special = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        self.pre_token = regex.compile(PRE_TOKEN)
        self.known: dict[str, int | None] = {}
        self.remember = remember

    def _split(self, text: str) -> tuple[list[str], int]:
        """Pre-tokens of any text, and how many special strings it holds."""
        parts = self.at_special.split(text)
        return [w for part in parts for w in self.pre_token.findall(part)], len(parts) - 1

    def _count(self, words: list[str]) -> list[int]:
        distinct = list(set(words))
        of = dict(zip(distinct, self.ranks.count([w.encode() for w in distinct]).tolist()))
        return [of[w] for w in words]

    def _learn(self, chunks: list[str]) -> None:
        """Counts of new chunks, each with one space before it; None for those that white space begins or ends."""
        self.known.update(dict.fromkeys(c for c in chunks if not c or c[0].isspace() or c[-1].isspace()))
        chunks = [c for c in chunks if c not in self.known]
        marked = [c for c in chunks if any(s in c for s in self.special)]
        for c in marked:
            words, extra = self._split(" " + c)
            self.known[c] = sum(self._count(words)) + extra
        chunks = [c for c in chunks if c not in self.known]
        if chunks:
            words = self.pre_token.findall(" " + " ".join(chunks))
            begins = [i for i, w in enumerate(words) if w[0] == " "]  # only a chunk's first pre-token has a space
            self.known.update(zip(chunks, np.add.reduceat(np.array(self._count(words), np.int64), begins).tolist()))

    def counts(self, texts: list[str]) -> list[int]:
        """Tokens of each text.

        A pre-token always begins at a space that stands alone between other
        characters, so texts are cut there, and a chunk (with the space before
        it) is split and merged only the first time it is seen.  Texts with
        other runs of white space at a cut are split as a whole.
        """
        chunks = [t.split(" ") for t in texts]
        fresh = list(set().union(*(c[1:] for c in chunks)) - self.known.keys())
        self._learn(fresh)
        known = self.known.__getitem__
        counts, whole = [], []
        for text, c in zip(texts, chunks):
            try:
                counts.append(sum(map(known, c[1:])))
                if c[0][-1:].isspace():
                    raise TypeError
                whole.append(c[0])
            except TypeError:  # a chunk that white space begins or ends
                del counts[len(whole):]
                counts.append(0)
                whole.append(text)
        split = [self._split(t) for t in whole]
        first = iter(self._count([w for words, _ in split for w in words]))
        counts = [n + extra + sum(itertools.islice(first, len(words))) for n, (words, extra) in zip(counts, split)]
        if len(self.known) > self.remember:
            for c in fresh:
                del self.known[c]
        return counts


_COUNTERS: dict[int, TokenCounter] = {}


def slices(texts: list[str], chars: int = 4_000_000) -> Iterator[list[str]]:
    """Consecutive texts of about ``chars`` characters, so that a batch of long texts stays small in memory."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= chars:
            yield part
            part, size = [], 0
    if part:
        yield part


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every row.

    The vocabulary file (a few MB, fixed) is read once on the driver and sent
    to the tasks; a Python worker keeps its table between tasks.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(spec.value)
        if key not in _COUNTERS:
            _COUNTERS[key] = TokenCounter(spec.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = [c for part in slices(texts) for c in _COUNTERS[key].counts(part)]
            n_bytes = pa.compute.binary_length(batch.column(1)).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes, pa.array(n, pa.int64())],
                                             ["doc_id", "n_bytes", "n_tokens"])

    rows = ids_and_texts(docs).mapInArrow(count, "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)
