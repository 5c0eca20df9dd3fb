"""Phrase collocations: frequent phrases that stand out against their parts.

Counting all n-grams of a corpus exactly would shuffle most of its text again
and again, nearly all of it n-grams that are rare.  So the phrases that matter
are found first, by Misra-Gries summaries, and only these are counted:

1. Tasks count the n-grams of each few megabytes of text as 48-bit hashes, and
   deal the counts to hash partitions.
2. Each hash partition merges its counts into one summary of at most
   ``capacity`` counters.  Where there are more, the count of the first one
   beyond is taken from all of them and the rest dropped, so no n-gram loses
   more than ``error``, the sum of what was taken, and that is at most
   mass / capacity.  With ``capacity`` above ``ROOM`` * mass / threshold the
   error stays under threshold / ``ROOM``; so every n-gram that occurs
   ``threshold`` times keeps a counter of at least threshold - error, and those
   with such a counter go on.  None is lost; a few too many cost time only.
3. Their hashes set two bits each in a bitmap of fixed size (2^``BITS`` bits),
   put together by blocks, which tasks use as a sieve.
4. A second pass counts the n-grams that pass the sieve exactly, by their text.
   A task sends its counts as one block for each hash partition, which adds
   them up.

A phrase cannot be more frequent than its parts.  So the steps 1 to 3 are
taken for single words, then for pairs of words that passed, then for longer
n-grams all of whose pairs passed.

Words, pieces and counts are those of ``phrases``.  A null text has no words
and a null language is ``und``; the language belongs to every n-gram.  Ids are
not looked at: repeated rows count as often as they stand.  Other columns are
ignored, an empty table has no phrases.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forgetting, partitions, written
from .token_counts import slices

LONGEST = 5
BITS = 26
BLOCKS = 64
ROOM = 4
SLICE = 6_000_000  # characters counted at a time
HELD = 400_000  # phrases that a task counts before it hands them on
KEY_BITS = 48
MIX = np.uint64(0x9E3779B97F4A7C15)
# Fixed values that decide results: upper case A-Z becomes lower case; phrases never cross the characters . , ; : ! ? U+000A to U+000D.
BORDER = b","
PLAIN = bytes.maketrans(string.ascii_uppercase.encode() + b".;:!?\x0a\x0b\x0c\x0d", string.ascii_lowercase.encode() + BORDER * 9)


class Numbers(dict):
    """word -> its number, in the order of first sight."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


class Words:
    """The words of some texts one after the other as numbers, with a border (number 0) behind every piece."""

    def __init__(self, texts: list[bytes], langs: list[str]):
        numbers = Numbers({BORDER: 0})
        parts = []
        for text in texts:
            # a border is no white space, and white space other than blanks and tabs is a border by now
            words = text.translate(PLAIN).replace(BORDER, b" , ").split()
            words.append(BORDER)
            parts.append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
        self.words = list(numbers)
        self.number = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        self.langs = sorted(set(langs))
        at = {lang: i for i, lang in enumerate(self.langs)}
        self.lang = np.repeat(np.array([at[lang] for lang in langs], np.int64), [len(p) for p in parts])
        word_hash = np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), np.uint64, len(self.words))
        lang_hash = np.array([xxhash.xxh3_64_intdigest(lang, 1) for lang in self.langs], np.uint64)
        self.hash = word_hash[self.number]
        self.lang_hash = lang_hash[self.lang]

    def grams(self, sieve: Sieve | None, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Per length the places where an n-gram begins whose words, and whose pairs of words, pass the sieve, and the hashes."""
        place = np.flatnonzero(self.number)
        rolled = self.hash[place]
        for n in range(1, longest + 1):
            key = (rolled ^ self.lang_hash[place] ^ np.uint64(n)) * MIX >> np.uint64(64 - KEY_BITS)
            yield n, place, key
            if n == longest:
                return
            if sieve is not None and n <= 2:
                passed = sieve.holds(key)
                place, rolled = place[passed], rolled[passed]
            if n == 1:
                good = np.zeros(len(self.number) + 1, bool)  # a word that can go on
                good[place] = True
            elif n == 2:
                good[:] = False  # from here on a pair that can go on, one word later
                good[place] = True
            follows = good[place + (1 if n == 1 else n - 1)]
            place, rolled = place[follows], rolled[follows]
            rolled = (rolled * MIX + np.uint64(n)) * MIX + self.hash[place + n]

    def __len__(self) -> int:
        return len(self.number)


class Sieve:
    """A bitmap of 2^BITS bits in which each n-gram has two."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    @staticmethod
    def places(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return (key >> np.uint64(KEY_BITS - BITS)).astype(np.int64), (key & np.uint64(2**BITS - 1)).astype(np.int64)

    def holds(self, key: np.ndarray) -> np.ndarray:
        a, b = self.places(key)
        test = lambda at: self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1
        return (test(a) & test(b)).astype(bool)


def _packed(keys: np.ndarray) -> bytes:
    return keys.view(np.uint8).reshape(-1, 8)[:, :KEY_BITS // 8].tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    keys = np.zeros((len(data) * 8 // KEY_BITS, 8), np.uint8)
    keys[:, :KEY_BITS // 8] = np.frombuffer(data, np.uint8).reshape(len(keys), -1)
    return keys.view(np.uint64).ravel()


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"),
                       F.coalesce(docs["lang"].cast("string"), F.lit("und")).alias("lang"))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
    for batch in batches:
        langs, at = batch.column(1).to_pylist(), 0
        for part in slices(batch.column(0).cast(pa.binary()).to_pylist(), SLICE):
            yield Words(part, langs[at:at + len(part)])
            at += len(part)


def merged(partial: Iterator[tuple[np.ndarray, np.ndarray]], capacity: int, gather: int = 1_000_000
           ) -> tuple[np.ndarray, np.ndarray, int]:
    """Misra-Gries summary of partial counts (keys, counts): keys, counts, and what each count may lack at most."""
    keys, counts, error = np.zeros(0, np.uint64), np.zeros(0, np.int64), 0

    def fold(more: list[tuple[np.ndarray, np.ndarray]]) -> None:
        nonlocal keys, counts, error
        keys, of = np.unique(np.concatenate([keys, *(k for k, _ in more)]), return_inverse=True)
        counts = np.bincount(of, np.concatenate([counts, *(c for _, c in more)]), len(keys)).astype(np.int64)
        if len(keys) > capacity:
            beyond = int(np.partition(counts, len(counts) - capacity - 1)[len(counts) - capacity - 1])
            left = counts > beyond
            keys, counts, error = keys[left], counts[left] - beyond, error + beyond

    waiting, size = [], 0
    for k, c in partial:
        waiting.append((k, c))
        size += len(k)
        if size >= gather:
            fold(waiting)
            waiting, size = [], 0
    if waiting:
        fold(waiting)
    return keys, counts, error


def sieve(rows: DataFrame, threshold: int, lengths: tuple[int, int], before: Sieve | None) -> Sieve:
    """The bitmap of all n-grams of the given lengths that occur ``threshold`` times, and few others; ``before`` holds the shorter."""
    spark = rows.sparkSession
    dealt = partitions(spark)
    known = spark.sparkContext.broadcast(before)
    least, longest = lengths

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for words in _words(batches):
            found = [key for n, _, key in words.grams(known.value, longest) if n >= least]
            keys, counts = np.unique(np.concatenate(found), return_counts=True)
            part = (keys % np.uint64(dealt)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            size = np.bincount(part, minlength=dealt)
            some, at = np.flatnonzero(size).tolist(), np.split(order, np.cumsum(size)[:-1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(some, pa.int32()), pa.array([int(counts[at[i]].sum()) for i in some], pa.int64()),
                 pa.array([_packed(keys[at[i]]) for i in some], pa.binary()),
                 pa.array([counts[at[i]].astype(np.uint32).tobytes() for i in some], pa.binary())], ["part", "mass", "keys", "counts"])

    def merge(partial: pa.Table) -> pa.Table:
        mass = pc.sum(partial.column("mass")).as_py()
        pairs = ((_unpacked(k.as_py()), np.frombuffer(c.as_py(), np.uint32).astype(np.int64))
                 for k, c in zip(partial.column("keys"), partial.column("counts")))
        keys, counts, error = merged(pairs, ROOM * mass // threshold + 1)
        bits = np.unique(np.concatenate(Sieve.places(keys[counts >= threshold - error])))
        block = bits * BLOCKS >> BITS
        some = np.unique(block)
        return pa.table([pa.array(some.tolist(), pa.int32()),
                         pa.array([(bits[block == b] & (2**BITS // BLOCKS - 1)).astype(np.uint32).tobytes() for b in some], pa.binary())],
                        ["block", "bits"])

    def together(found: pa.Table) -> pa.Table:
        bitmap = np.zeros(2**BITS // BLOCKS, np.uint8)
        for bits in found.column("bits"):
            bitmap[np.frombuffer(bits.as_py(), np.uint32)] = 1
        return pa.table([found.column("block").slice(0, 1), pa.array([np.packbits(bitmap, bitorder="little").tobytes()], pa.binary())],
                        ["block", "bits"])

    blocks = (rows.mapInArrow(forgetting(count), "part int, mass bigint, keys binary, counts binary")
              .groupBy("part").applyInArrow(merge, "block int, bits binary")
              .groupBy("block").applyInArrow(together, "block int, bits binary").collect())  # 2^BITS bits in all
    bits = np.zeros((BLOCKS, 2**BITS // BLOCKS // 8), np.uint8) if before is None else before.bits.reshape(BLOCKS, -1).copy()
    for r in blocks:
        bits[r["block"]] |= np.frombuffer(r["bits"], np.uint8)
    known.destroy()
    return Sieve(bits.ravel())


COUNTS = "lang string, n_words int, phrase string, f bigint"


def _block(counts: pa.Table) -> bytes:
    """Counts as bytes; sorted ones are the shorter, as neighbours have most of their words in common."""
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, counts.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_table(counts)
    return out.getvalue().to_pybytes()


def blocks(rows: DataFrame, known: Sieve, longest: int = LONGEST) -> DataFrame:
    """Exact counts of what passes the sieve in each task's texts, one block (part, data) for each hash partition of the phrases."""
    sieve_b = rows.sparkSession.sparkContext.broadcast(known)
    dealt = partitions(rows.sparkSession)

    def batch(found: dict[tuple[str, int], dict[str, int]]) -> pa.RecordBatch:
        sizes = [len(own) for own in found.values()]
        phrases = [phrase for own in found.values() for phrase in own]
        counts = pa.table([pa.array((xxhash.xxh3_64_intdigest(phrase) % dealt for phrase in phrases), pa.int32()),
                           pa.array([lang for (lang, _), size in zip(found, sizes) for _ in range(size)], pa.string()),
                           pa.array(np.repeat([n for _, n in found], sizes), pa.int32()),
                           pa.array(phrases, pa.string()),
                           pa.array([f for own in found.values() for f in own.values()], pa.int64())],
                          ["part", "lang", "n_words", "phrase", "f"])
        counts = counts.sort_by([(c, "ascending") for c in ("part", "lang", "phrase")])
        some, size = np.unique(counts.column("part").to_numpy(), return_counts=True)
        counts = counts.drop_columns("part")
        return pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int32()),
             pa.array([_block(counts.slice(at, n)) for at, n in zip((np.cumsum(size) - size).tolist(), size.tolist())], pa.binary())],
            ["part", "data"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, int], dict[str, int]] = {}
        for words in _words(batches):
            total = np.bincount(words.lang[words.number > 0], minlength=len(words.langs)).tolist()
            for lang, f in zip(words.langs, total):
                own = found.setdefault((lang, 0), {"": 0})
                own[""] += f
            same = np.zeros(len(words), np.int64)  # equal where the n-grams that begin there are, words and language
            for n, place, key in words.grams(sieve_b.value, longest):
                passed = sieve_b.value.holds(key)
                if n > 1:
                    passed &= same[place] >= 0
                place = place[passed]
                shorter = words.lang if n == 1 else same
                pair = shorter[place] * len(words.words) + words.number[place + n - 1]
                _, first, of, times = np.unique(pair, return_index=True, return_inverse=True, return_counts=True)
                same = np.full(len(words), -1, np.int64)
                same[place] = of
                dicts = [found.setdefault((lang, n), {}) for lang in words.langs]
                at = place[first]
                spelled = [words.words[i] for i in words.number[at[:, None] + np.arange(n)].ravel().tolist()]
                for i, (lang, f) in enumerate(zip(words.lang[at].tolist(), times.tolist())):
                    phrase = b" ".join(spelled[i * n:i * n + n]).decode()
                    dicts[lang][phrase] = dicts[lang].get(phrase, 0) + f
            if sum(map(len, found.values())) > HELD:
                yield batch(found)
                found = {}
        if found:
            yield batch(found)

    return rows.mapInArrow(forgetting(count), "part int, data binary")


def summed(found: list[pa.Table]) -> pa.Table:
    """One row for each language and phrase of some counts."""
    total = pa.concat_tables(found).group_by(["lang", "n_words", "phrase"], use_threads=False).aggregate([("f", "sum")])
    return total.rename_columns({"f_sum": "f"}).select(["lang", "n_words", "phrase", "f"])


def added(data: Iterator[bytes], gather: int = 1_000_000) -> pa.Table:
    """The sums of some blocks, of which about ``gather`` counts are held beside them."""
    held, size = [], 0
    for block in data:
        held.append(pa.ipc.open_stream(block).read_all())
        size += len(held[-1])
        if size >= gather:
            held, size = [summed(held)], 0
    return summed(held)


def counted(rows: DataFrame, known: Sieve, longest: int = LONGEST) -> DataFrame:
    """Exact counts (lang, n_words, phrase, f) of the n-grams that pass the sieve, and per language one row of 0 words: all words."""
    def add(found: pa.Table) -> pa.Table:
        return added(block.as_py() for block in found.column("data"))

    return blocks(rows, known, longest).groupBy("part").applyInArrow(add, COUNTS)


def frequent(docs: DataFrame, threshold: int = 100, longest: int = LONGEST) -> DataFrame:
    """Every n-gram of 1 to ``longest`` words with ``threshold`` occurrences or more: lang, n_words, phrase, f; n_words 0 is the total."""
    rows = _rows(docs)
    known = None
    for lengths in ((1, 1), (2, 2), (3, longest)):
        if lengths[0] <= longest:
            known = sieve(rows, threshold, (lengths[0], min(lengths[1], longest)), known)
    return counted(rows, known, longest).where((F.col("f") >= threshold) | (F.col("n_words") == 0))


def _slice_of(words: Column, at: Column, n: Column) -> Column:
    return F.array_join(F.slice(words, at, n), " ")


def phrases(docs: DataFrame, threshold: int = 100, longest: int = LONGEST, absorbed: int = 100) -> DataFrame:
    """Candidates with their weakest cut: lang, phrase, a, l, r, n, score, of those that no longer candidate absorbs.

    Texts are lower-cased (A-Z), split into pieces at ``. , ; : ! ?`` and line
    ends, and these into words at blanks and tabs.  A candidate is a phrase of
    2 to ``longest`` words with a = f(phrase) >= ``threshold``.  Cut after its
    first k words it has the score floor(1000 a n / (l r)), where n is the
    number of words of the language, and l, r the counts of the two parts.  The
    lowest score counts, of equal ones the one with the smallest k.  A
    candidate goes if it lies inside a longer one that is found in
    ``absorbed`` % of its occurrences.
    """
    counts = written(frequent(docs, threshold, longest))
    total = F.broadcast(counts.where("n_words = 0").select("lang", F.col("f").alias("n")))  # one row per language
    candidates = counts.where("n_words > 1").select("lang", "phrase", "n_words", F.col("f").alias("a"), F.split("phrase", " ").alias("w"))
    inside = (candidates.where("n_words > 2")
              .select("lang", "w", "n_words", F.col("a").alias("longer"), F.explode(F.expr("sequence(2, n_words - 1)")).alias("m"))
              .select("lang", "w", "longer", "m", F.explode(F.expr("sequence(1, n_words - m + 1)")).alias("at"))
              .groupBy("lang", _slice_of(F.col("w"), F.col("at"), F.col("m")).alias("phrase")).agg(F.max("longer").alias("longer")))
    kept = (candidates.join(inside, ["lang", "phrase"], "left")
            .where(F.col("longer").isNull() | (100 * F.col("longer") < absorbed * F.col("a"))))
    parts = counts.where("n_words > 0").select("lang", F.col("phrase").alias("part"), "f")
    cuts = (kept.select("lang", "phrase", "a", "w", "n_words", F.explode(F.expr("sequence(1, n_words - 1)")).alias("k"))
            .select("lang", "phrase", "a", "k", _slice_of(F.col("w"), F.lit(1), F.col("k")).alias("left"),
                    _slice_of(F.col("w"), F.col("k") + 1, F.col("n_words") - F.col("k")).alias("right"))
            .join(parts.withColumnsRenamed({"part": "left", "f": "l"}), ["lang", "left"])
            .join(parts.withColumnsRenamed({"part": "right", "f": "r"}), ["lang", "right"])
            .join(total, "lang"))
    whole = lambda c: F.col(c).cast("decimal(38,0)")
    scored = cuts.withColumn("over", F.lit(1000).cast("decimal(4,0)") * F.col("a").cast("decimal(16,0)") * F.col("n").cast("decimal(16,0)"))
    scored = scored.withColumn("under", F.col("l").cast("decimal(18,0)") * F.col("r").cast("decimal(18,0)"))
    scored = scored.withColumn("score", F.expr("over div under"))
    best = F.min(F.struct("score", "k", "l", "r")).alias("cut")
    return (scored.groupBy("lang", "phrase", "a", "n").agg(best)
            .select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score"))


def ranked(docs: DataFrame, top: int = 2000, threshold: int = 100, longest: int = LONGEST, absorbed: int = 100) -> DataFrame:
    """The first ``top`` phrases of each language by score, a (both descending) and phrase, with their rank."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return (phrases(docs, threshold, longest, absorbed).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
            .select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score"))
