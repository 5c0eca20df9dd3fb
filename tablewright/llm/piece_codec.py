"""SentencePiece (BPE) encoding that keeps source offsets, and decoding.

A text is normalised character by character.  Wherever an entry of the
vocabulary's compiled character map begins, the longest one is replaced; user
defined symbols stay as they are; white space becomes the mark U+2581.  Beside
the normalised text, the byte of the original at which each of its characters
begins is recorded, and where an n-gram of normalised characters becomes a
piece, these offsets give the piece's span in the original.  A character
without a piece becomes its bytes; the last of them carries the span.

Adjacent pieces join where they make a piece, the best score first, of equal
ones the leftmost.  No piece holds a mark behind another character (otherwise
texts are not cut at all), so a normalised text is cut before its runs of
marks, and a chunk is merged only the first time it is seen by a task.  What a
task has learned is bounded by ``REMEMBER`` characters and goes with the task.

Null and empty texts have no pieces and decode to the empty string.  Rows are
encoded one by one; repeated rows and ids get equal results; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import forgetting, ids_and_texts
from .token_counts import NO_RANK, PairRanks, slices

MARK = "▁"
UNKNOWN_TEXT = " ⁇ "  # fixed value: what the unknown id decodes to unless the vocabulary names another text
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
REMEMBER = 8_000_000
SLICE = 2_000_000
SHORT = 48


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or number()
            yield key >> 3, message[at:at + size]
            at += size


def character_map(compiled: bytes) -> dict[str, str]:
    """The entries of a compiled character map: a double-array trie of the sources, and the targets it points to."""
    if not compiled:
        return {}
    size = int.from_bytes(compiled[:4], "little")
    units = np.frombuffer(compiled[4:4 + size], "<u4").astype(np.int64)
    targets = compiled[4 + size:]
    labels = np.arange(1, 256)
    out = {}
    stack = [(0, b"")]
    while stack:
        at, source = stack.pop()
        unit = int(units[at])
        below = at ^ (unit >> 10) << ((unit & 0x200) >> 6)
        if unit >> 8 & 1:
            begin = int(units[below]) & 0x7FFFFFFF
            out[source.decode()] = targets[begin:targets.index(b"\0", begin)].decode()
        next_ = below ^ labels
        inside = next_ < len(units)
        for label in labels[inside][units[next_[inside]] & 0x800000FF == labels[inside]].tolist():
            stack.append((below ^ label, source + bytes([label])))
    return out


class Vocabulary:
    """What a model file says about normalising, merging and decoding."""

    def __init__(self, model: bytes):
        self.piece: list[str] = []
        self.kind: list[int] = []
        scores: list[float] = []
        norm, trainer = {}, {}
        for field, value in _fields(model):
            if field == 1:
                part = dict(_fields(value))
                self.piece.append(part.get(1, b"").decode())
                scores.append(struct.unpack("<f", part[2])[0] if 2 in part else 0.0)
                self.kind.append(part.get(3, NORMAL))
            elif field in (2, 3):
                (trainer if field == 2 else norm).update(_fields(value))
            elif field == 5 and dict(_fields(value)).get(2):
                raise ValueError("denormalisation is not supported")
        if trainer.get(3, 1) != 2:
            raise ValueError("not a BPE model")
        self.byte = {int(p[1:-1], 16): i for i, p in enumerate(self.piece) if self.kind[i] == BYTE}
        if trainer.get(24, 0) or UNUSED in self.kind or not norm.get(5, 1) or not trainer.get(35, 0) or len(self.byte) != 256:
            raise ValueError("white space as a suffix or unescaped, unused pieces, and no byte fallback are not supported")
        self.dummy_prefix, self.trim = bool(norm.get(3, 1)), bool(norm.get(4, 1))
        self.unknown_text = trainer[44].decode() if 44 in trainer else UNKNOWN_TEXT
        self.map = character_map(norm.get(2, b""))
        self.id = {p: i for i, p in enumerate(self.piece) if self.kind[i] in (NORMAL, USER)}
        self.byte_of = {i: b for b, i in self.byte.items()}
        rank = {s: r for r, s in enumerate(sorted({scores[i] for i in self.id.values()}, reverse=True))}
        self.rank = {p: rank[scores[i]] for p, i in self.id.items()}
        self.pairs = Pairs(self.id, self.rank)
        self.text = [p.replace(MARK, " ") for p in self.piece]
        self.names = list(map(str, range(len(self.piece))))
        users = sorted((p for p, i in self.id.items() if self.kind[i] == USER), key=len, reverse=True)
        self.special = {i for i, k in enumerate(self.kind) if k in (UNKNOWN, CONTROL)}
        self.users = re.compile("(" + "|".join(map(re.escape, users)) + ")") if users else None
        #: at these places something other than one character is taken
        self.longest: dict[str, int] = {}
        for source in [*self.map, *users]:
            self.longest[source[0]] = max(self.longest.get(source[0], 0), len(source))
        self.begins = re.compile("[" + "".join(map(re.escape, self.longest)) + "]") if self.longest else None
        self.is_user = set(users)
        inner = any(MARK in p.lstrip(MARK) for p in self.id) or bool(users)
        breaks = "".join(c for c in "\n\r\t" if not any(c in p and len(p) > 1 for p in self.id))
        other = f"[^{MARK}{breaks}]"
        self.chunk = re.compile("(?s).+" if inner else f"{MARK}+{other}*|{other}+" + (f"|[{breaks}]" if breaks else ""))

    def normalised(self, text: str) -> tuple[str, np.ndarray]:
        """The normalised text, and for each of its characters, and its end, the byte of the original where it begins."""
        out, at = [], []  # characters and where they begin, in characters of the original
        place = 0
        while place < len(text):
            found = self.begins.search(text, place) if self.begins else None
            end = found.start() if found else len(text)
            out.extend(text[place:end])
            at.extend(range(place, end))
            place = end
            if not found:
                break
            # of the sources that begin here the longest, and a user defined symbol before all others
            cut = [text[place:place + n] for n in range(min(self.longest[text[place]], len(text) - place), 0, -1)]
            source = next((s for s in cut if s in self.is_user), None) or next((s for s in cut if s in self.map), text[place])
            target = source if source in self.is_user else self.map.get(source, source)
            out.extend(target)
            at.extend([place] * len(target))
            place += len(source)
        last = [len(text)]
        if self.trim:  # no white space at the ends, single blanks between
            keep = [i for i, c in enumerate(out) if c != " " or i and out[i - 1] != " "]
            while keep and out[keep[-1]] in (" ", MARK):
                last = [at[keep.pop()]]
            out, at = [out[i] for i in keep], [at[i] for i in keep]
        if out and self.dummy_prefix:
            out, at = [" ", *out], [at[0], *at]
        byte = np.r_[0, np.cumsum(_utf8_lengths(text))]
        return "".join(out).replace(" ", MARK), byte[np.array([*at, *last], np.int64)]

    def merged(self, chunk: str) -> list[str]:
        """The pieces of a chunk, best score first, of equal ones the leftmost."""
        if self.users:
            return [p for i, part in enumerate(self.users.split(chunk)) if part for p in ([part] if i % 2 else self._merged(part))]
        return self._merged(chunk)

    def _merged(self, chunk: str) -> list[str]:
        parts, rank, none = list(chunk), self.rank.get, len(self.rank)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        waiting = [(r, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (r := rank(a + b, none)) < none]
        heapq.heapify(waiting)
        while waiting:
            _, i, a, b = heapq.heappop(waiting)
            j = after[i]
            if parts[i] != a or j >= len(parts) or parts[j] != b:
                continue  # one of the two has become part of another piece
            parts[i], parts[j] = a + b, ""
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < len(parts) and (r := rank(parts[x] + parts[y], none)) < none:
                    heapq.heappush(waiting, (r, x, parts[x], parts[y]))
        return [p for p in parts if p]

    def numbered(self, pieces: list[str]) -> tuple[list[int], list[int]]:
        """Ids of pieces, and how many normalised characters each one takes."""
        ids, sizes = [], []
        for p in pieces:
            known = self.id.get(p)
            if known is None:
                data = p.encode()
                ids += [self.byte[b] for b in data]
                sizes += [0] * (len(data) - 1) + [1]
            else:
                ids.append(known)
                sizes.append(len(p))
        return ids, sizes

    def pieces_text(self, ids: list[int]) -> str:
        """The text of ids as it stands within a decoded text, white space at its start included."""
        if self.byte_of.keys().isdisjoint(ids) and self.special.isdisjoint(ids):
            return "".join([self.text[i] for i in ids])
        out, data = [], bytearray()
        for i in [*ids, None]:
            if i in self.byte_of:
                data.append(self.byte_of[i])
                continue
            while data:  # what is no UTF-8 is replaced byte by byte
                try:
                    out.append(data.decode())
                    data.clear()
                except UnicodeDecodeError as e:
                    out.append(data[:e.start].decode() + "\ufffd")
                    del data[:e.start + 1]
            if i is not None:
                kind = self.kind[i]
                out.append("" if kind == CONTROL else self.unknown_text if kind == UNKNOWN else self.text[i])
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of ids, without the white space that encoding puts before a text."""
        at = 0
        while at < len(ids):
            piece = self.piece[ids[at]] if self.kind[ids[at]] in (NORMAL, USER) else ""
            if piece.startswith(MARK) and (self.trim or self.dummy_prefix):
                rest = self.text[ids[at]][1:]
                at += 1
                if not rest and self.trim:
                    continue
                return rest + self.pieces_text(ids[at:])
            if self.kind[ids[at]] != CONTROL:
                break
            at += 1
        return self.pieces_text(ids[at:])

    def decoded(self, text: str, ids: np.ndarray) -> str:
        """``decode(ids)`` of an encoded text, given ``pieces_text`` of its ids."""
        if self.trim and text[:2] == "  ":
            return self.decode(ids.tolist())
        return text[1:] if (self.trim or self.dummy_prefix) and text[:1] == " " else text


class Pairs(PairRanks):
    """All pairs of symbols that make a piece: lookup of many pairs, and merging of many sequences, at once."""

    def __init__(self, ids: dict[str, int], rank: dict[str, int]):
        self.unknown = max(ids.values()) + 1  # a character without a piece
        self.width = np.int64(self.unknown + 1)
        made = sorted((rank[p], ids[p[:i]], ids[p[i:]], ids[p]) for p in ids for i in range(1, len(p)) if p[:i] in ids and p[i:] in ids)
        self.order, left, right, self.merged = np.array(made or np.zeros((0, 4)), np.int64).T
        self.keys = left * self.width + right
        self.slots = np.full(2**20 + len(made) + 1, -1, np.int32)
        for at, slot in enumerate(self._slot(self.keys).tolist()):
            while self.slots[slot] >= 0:
                slot += 1
            self.slots[slot] = at
        self.character = {ord(p): i for p, i in ids.items() if len(p) == 1}
        self.size = np.ones(self.unknown + 1, np.int64)
        for p, i in ids.items():
            self.size[i] = len(p)
        #: whether a symbol takes part in no piece that is as good as itself, or better
        earliest = np.full(self.unknown + 1, len(rank), np.int64)
        np.minimum.at(earliest, left, self.order)
        np.minimum.at(earliest, right, self.order)
        self.plain = earliest[self.merged] > self.order

    def merge(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbols of all chunks one after the other, the first character of each, and the number of symbols of each chunk.

        Each round, every chunk applies its best pair: everywhere from left to
        right if that can make no pair as good, otherwise at its first place.
        """
        lengths = np.fromiter(map(len, chunks), np.int64, len(chunks))
        code = np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32)
        distinct, of = np.unique(code, return_inverse=True)
        symbols = np.array([self.character.get(c, self.unknown) for c in distinct.tolist()], np.int64)[of]
        sequence = np.repeat(np.arange(len(chunks)), lengths)
        done = []
        while len(symbols):
            first = np.r_[True, sequence[1:] != sequence[:-1]]
            at = np.flatnonzero(~first[1:])
            pair = np.full(len(symbols), NO_RANK, np.int64)  # of the symbol and the next one
            pair[at] = self.rank(symbols[at], symbols[at + 1])
            found = pair != NO_RANK
            rank = np.full(len(symbols), NO_RANK, np.int64)
            rank[found] = self.order[pair[found]]
            starts = np.flatnonzero(first)
            size = np.diff(np.r_[starts, len(symbols)])
            best = np.minimum.reduceat(rank, starts)
            over = np.repeat(best == NO_RANK, size)
            done.append((sequence[over], symbols[over], code[over]))
            here = np.flatnonzero(found & (rank == np.repeat(best, size)))
            leads = np.r_[True, sequence[here[1:]] != sequence[here[:-1]]] if len(here) else np.zeros(0, bool)
            here = here[self.plain[pair[here]] | leads]
            run = np.flatnonzero(np.r_[True, np.diff(here) != 1]) if len(here) else here
            place = np.arange(len(here)) - np.repeat(run, np.diff(np.r_[run, len(here)]))
            here = here[place % 2 == 0]  # of overlapping pairs every second one, from the left
            symbols[here] = self.merged[pair[here]]
            over[here + 1] = True
            symbols, sequence, code = symbols[~over], sequence[~over], code[~over]
        if not done:
            return np.zeros(0, np.int64), np.zeros(0, np.uint32), np.zeros(0, np.int64)
        sequence, symbols, code = (np.concatenate(c) for c in zip(*done))
        order = np.argsort(sequence, kind="stable")
        return symbols[order], code[order], np.bincount(sequence, minlength=len(chunks))


def _utf8_lengths(text: str) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF).astype(np.int64)


class Encoded:
    """Some texts encoded: ids one after the other, their spans, and per text its number of ids, their digits and the decoded text."""

    def __init__(self, ids, begin, end, count, joined, decoded):
        self.ids, self.begin, self.end, self.count, self.joined, self.decoded = ids, begin, end, count, joined, decoded


class Encoder:
    """Encodes texts with one vocabulary; remembers chunks of ``REMEMBER`` characters in all."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.joined: list[str] = []
        self.decoded: list[str] = []
        self.first = np.zeros(1, np.int64)  # where a chunk's ids begin in flat_ids
        self.flat_ids = np.zeros(0, np.int32)
        self.flat_sizes = np.zeros(0, np.int32)
        self.held = 0

    def _learn(self, chunks: set[str]) -> None:
        v = self.vocabulary
        odd = [c for c in chunks if len(c) > SHORT or v.users]
        short = list(chunks.difference(odd))
        symbols, code, counts = v.pairs.merge(short)
        sizes, bytes_at = v.pairs.size[symbols], np.flatnonzero(symbols == v.pairs.unknown)
        filled = bytes_at
        if len(bytes_at):  # characters without a piece become their bytes, the last of them takes the character
            data = [chr(c).encode() for c in code[bytes_at].tolist()]
            times = np.ones(len(symbols), np.int64)
            times[bytes_at] = list(map(len, data))
            ends = np.cumsum(times)
            counts = np.diff(np.r_[0, np.r_[0, ends][np.cumsum(counts)]])
            symbols, sizes = np.repeat(symbols, times), np.repeat(sizes, times)
            filled = np.flatnonzero(symbols == v.pairs.unknown)
            symbols[filled] = [v.byte[b] for d in data for b in d]
            sizes[filled] = 0
            sizes[ends[bytes_at] - 1] = 1
        ids, at = symbols.tolist(), 0
        names, texts = v.names, v.text
        simple = np.ones(len(short), bool)
        simple[np.searchsorted(np.cumsum(counts), filled, "right")] = False
        for chunk, n, whole in zip(short, counts.tolist(), simple.tolist()):
            own = ids[at:at + n]
            at += n
            self.number[chunk] = len(self.joined)
            self.joined.append(",".join([names[i] for i in own]))
            self.decoded.append("".join([texts[i] for i in own]) if whole else v.pieces_text(own))
        more_ids, more_sizes, more_counts = [], [], []
        for chunk in odd:
            own, size = v.numbered(v.merged(chunk))
            self.number[chunk] = len(self.joined)
            self.joined.append(",".join([names[i] for i in own]))
            self.decoded.append(v.pieces_text(own))
            more_ids += own
            more_sizes += size
            more_counts.append(len(own))
        self.held += sum(map(len, chunks))
        self.flat_ids = np.concatenate([self.flat_ids, symbols.astype(np.int32), np.array(more_ids, np.int32)])
        self.flat_sizes = np.concatenate([self.flat_sizes, sizes.astype(np.int32), np.array(more_sizes, np.int32)])
        counts = np.concatenate([counts, np.array(more_counts, np.int64)])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(counts)])

    def encode(self, texts: list[str]) -> Encoded:
        if self.held > REMEMBER:
            self._forget()
        v = self.vocabulary
        if v.begins is None and not v.trim:  # nothing but white space changes: offsets follow from the characters
            start = " " if v.dummy_prefix else ""
            normal = [(start + t).replace(" ", MARK) if t else "" for t in texts]
            sizes = _utf8_lengths("".join(texts))
            offsets, at = [], 0
            for t in texts:
                own = sizes[at:at + len(t)]
                offsets.append(np.concatenate([[0] * (bool(t) + bool(t and start)), np.cumsum(own)]) if t else np.zeros(1, np.int64))
                at += len(t)
        else:
            normal, offsets = zip(*map(v.normalised, texts)) if texts else ((), ())
        chunks = [v.chunk.findall(t) for t in normal]
        self._learn(set().union(*chunks) - self.number.keys())
        numbers = [list(map(self.number.__getitem__, c)) for c in chunks]
        flat = np.fromiter(itertools.chain.from_iterable(numbers), np.int64)
        size = self.first[flat + 1] - self.first[flat]
        ends = np.cumsum(size)
        at = np.repeat(self.first[flat] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)
        chunk_ends = np.cumsum([len(n) for n in numbers], dtype=np.int64)
        id_ends = np.r_[0, ends][chunk_ends]
        count = np.diff(np.r_[0, id_ends])
        # normalised characters before each piece, in all texts laid end to end, each with one place more for its end
        spread = self.flat_sizes[at].astype(np.int64)
        place = np.cumsum(spread) + np.repeat(np.arange(len(texts)), count)
        offset = np.concatenate(offsets) if len(texts) else np.zeros(0, np.int64)
        ids, joined, texts_of = self.flat_ids[at], self.joined.__getitem__, self.decoded.__getitem__
        decoded = [v.decoded("".join(map(texts_of, n)), ids[b - c:b]) for n, b, c in zip(numbers, id_ends.tolist(), count.tolist())]
        return Encoded(ids, offset[place - spread].astype(np.int64), offset[place].astype(np.int64), count,
                       [",".join(map(joined, n)) for n in numbers], decoded)


_VOCABULARIES: dict[bytes, Vocabulary] = {}


def _vocabulary(model: bytes) -> Vocabulary:
    """The tables of a model file; a Python worker keeps them between tasks."""
    key = hashlib.sha256(model).digest()
    if key not in _VOCABULARIES:
        _VOCABULARIES[key] = Vocabulary(model)
    return _VOCABULARIES[key]


def _model(df: DataFrame, path: str):
    """The model file (under a MB, fixed), read once on the driver and sent to the tasks."""
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def _encoded(batches: Iterator[pa.RecordBatch], model: bytes) -> Iterator[tuple[pa.Array, Encoded, list[str]]]:
    encoder = Encoder(_vocabulary(model))
    for batch in batches:
        at = 0
        for part in slices(batch.column(1).to_pylist(), SLICE):
            yield batch.column(0).slice(at, len(part)), encoder.encode(part), part
            at += len(part)


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ``ids``, and the spans ``begins`` and ``ends`` in bytes of the text, of every row."""
    model = _model(docs, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, e, _ in _encoded(batches, model.value):
            offsets = pa.array(np.r_[0, np.cumsum(e.count)], pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(c, t))
                     for c, t in ((e.ids, pa.int32()), (e.begin, pa.int64()), (e.end, pa.int64()))]
            yield pa.RecordBatch.from_arrays([doc_id, *lists], ["doc_id", "ids", "begins", "ends"])

    return ids_and_texts(docs).mapInArrow(forgetting(run), "doc_id bigint, ids array<int>, begins array<bigint>, ends array<bigint>")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and ``text`` of rows of doc_id and ``ids`` (null: empty)."""
    model = _model(encoded, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_vocabulary(model.value).decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(forgetting(run), "doc_id bigint, text string")


DIGESTS = "n_tokens bigint, ids_sha256 string, decoded_sha256 string, n_bytes bigint, covered_bytes bigint"


def digests(docs: DataFrame, model_path: str) -> DataFrame:
    """Every row's doc_id, n_tokens, the SHA-256 of its ids (joined by commas) and of its decoded text, bytes and bytes in spans."""
    model = _model(docs, model_path)
    names = ["doc_id", *(f.split(" ")[0] for f in DIGESTS.split(", "))]
    sha = lambda texts: pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc_id, e, texts in _encoded(batches, model.value):
            covered = np.r_[0, np.cumsum(e.end - e.begin)][np.r_[0, np.cumsum(e.count)]]
            yield pa.RecordBatch.from_arrays(
                [doc_id, pa.array(e.count, pa.int64()), sha(e.joined), sha(e.decoded),
                 pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(np.diff(covered), pa.int64())], names)

    return ids_and_texts(docs).mapInArrow(forgetting(run), "doc_id bigint, " + DIGESTS)
