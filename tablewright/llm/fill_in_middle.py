"""Fill-in-middle transformation by secondary-sort assembly.

A document is cut into units (lines).  Two cuts, drawn from a hash of the id,
divide the units into prefix, middle and suffix, and the output puts the
middle last, behind marks.  No document is rearranged in place:

1. Tasks emit pieces, runs of whole units of at most ``PIECE`` bytes (a longer
   unit is cut), keyed by the document and the piece's position in the output.
2. One shuffle by document, sorted by (document, output position), lets a
   second task stream the pieces of a document, in order, into the digest of
   the output.  It holds one piece and one digest at a time.
3. The marks met in that stream say which section each piece belongs to.
   Sorted anew by (document, section), within the same partitions and without
   another shuffle, the pieces stream into the digest of the restored text.

The sorts spill, so neither a long document nor a large partition has to fit
in memory.  A document's key is a digest of its id and text with one of
``COPY_GROUPS`` numbers that follow from the row's place in its partition, so
copies of one row spread over that many keys; copies that meet under one key
are streamed once and counted.  For the counts to hold when a lost task is run
again, the input must list its rows in the same order again (files and sorted
tables do).

Texts without units, with a mark of their own, or not drawn (``percent``) stay
plain.  A null text counts as empty, a null id as the empty string in the
draw.  Repeated rows give repeated results; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ids_and_texts

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = (PREFIX.encode(), MIDDLE.encode(), SUFFIX.encode())  # in the order of the sections in the text
ANY_MARK = re.compile(b"|".join(map(re.escape, MARKS)))
PIECE = 16_384
COPY_GROUPS = 1024
ORDERS = {"plain": (), "psm": (0, 2, 1), "spm": (2, 0, 1)}  # sections as the output lists them


@dataclass(frozen=True)
class Draw:
    """How documents are drawn: ``percent`` of them are rearranged, ``spm_percent`` of these begin with the suffix."""

    seed: int = 7
    percent: int = 100
    spm_percent: int = 50


def plan(doc_id: int | None, text: bytes, draw: Draw) -> tuple[int, str, int, int]:
    """Units of a text, its form, and the bytes before the middle and before the suffix."""
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10) + 1
    n = len(ends) + (bool(text) and not text.endswith(b"\n"))
    drawn = hashlib.sha256(f"{draw.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(drawn[i:i + 8], 16) for i in range(0, 32, 8))
    if not text or h3 % 100 >= draw.percent or ANY_MARK.search(text):
        return n, "plain", 0, 0
    after = lambda units: 0 if not units else len(text) if units > len(ends) else int(ends[units - 1])
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    return n, "spm" if h4 % 100 < draw.spm_percent else "psm", after(first), after(second)


def _cut(section: bytes) -> Iterator[bytes]:
    """The section in pieces of whole units, as many as fit in ``PIECE`` bytes."""
    at = 0
    while at < len(section):
        end = at + PIECE
        if end < len(section):
            end = section.rfind(b"\n", at, end) + 1 or end
        yield section[at:end]
        at = end


def _code_points(text: bytes) -> int:
    return int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))


HEAD = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint"
PIECES = f"key binary, place bigint, data binary, {HEAD}"
ORDERED = f"{PIECES}, copies bigint, output_sha256 string"
DIGESTS = f"{HEAD}, output_sha256 string, restored_sha256 string"


def _names(schema: str) -> list[str]:
    return [f.split(" ")[0] for f in schema.split(", ")]


ARROW = {"binary": pa.binary(), "bigint": pa.int64(), "string": pa.string()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = [ARROW[f.split(" ")[1]] for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], _names(schema))


def _batches(rows: Iterator[tuple], schema: str, bytes_at: int | None = None, most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Rows gathered into batches of bounded size."""
    out, size = [], 0
    for row in rows:
        out.append(row)
        size += 100 + (len(row[bytes_at] or b"") if bytes_at is not None else 0)
        if size >= most:
            yield _batch(out, schema)
            out, size = [], 0
    if out:
        yield _batch(out, schema)


def pieces(docs: DataFrame, draw: Draw = Draw()) -> DataFrame:
    """The pieces of every row: ``key``, ``place`` in the output, ``data``; place 0 holds the row's figures and no data."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        row = TaskContext.get().partitionId() * 31
        for batch in batches:
            for doc_id, data in zip(batch.column(0), batch.column(1).cast(pa.binary())):
                doc_id, text = doc_id.as_py(), data.as_py()
                row += 1
                key = hashlib.sha256(b"%r:%s" % (doc_id, text)).digest()[:16] + (row % COPY_GROUPS).to_bytes(2, "big")
                n, form, middle, suffix = plan(doc_id, text, draw)
                sections = (text[:middle], text[middle:suffix], text[suffix:])
                plain = form == "plain"
                yield (key, 0, None, doc_id, n, form, None if plain else _code_points(sections[0]),
                       None if plain else _code_points(sections[1]))
                place = 0
                for s in ORDERS[form] or (None,):
                    for data in ([MARKS[s]] if s is not None else []), _cut(text if s is None else sections[s]):
                        for piece in data:
                            place += 1
                            yield key, place, piece, None, None, None, None, None

    return ids_and_texts(docs).mapInArrow(lambda batches: _batches(cut(batches), PIECES, 2), PIECES)


def _rows(batches: Iterator[pa.RecordBatch], some: int = 256) -> Iterator[tuple]:
    """Rows of batches, turned into Python values a few at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, some):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, some).columns))


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, int]]:
    """Rows in sorted order, each place of a key once, with the number of copies that brought it."""
    before, copies = None, 0
    for row in _rows(batches):
        if before is not None and row[:2] == before[:2]:
            copies += 1
            continue
        if before is not None:
            yield before, copies
        before, copies = row, 1
    if before is not None:
        yield before, copies


def _in_output_order(rows: Iterator[tuple[tuple, int]]) -> Iterator[tuple]:
    """Digests the output of each document and passes its pieces on, placed by section as the marks say."""
    head = digest = None
    for row, copies in rows:
        key, place, data = row[:3]
        if place == 0:
            if head:
                yield *head, digest.hexdigest()
            head, digest, section, marked = (key, -1, None, *row[3:], copies), hashlib.sha256(), 0, row[5] != "plain"
            continue
        digest.update(data)
        if marked and data in MARKS:
            section = MARKS.index(data)
        else:
            yield key, section * 2**40 + place, data, None, None, None, None, None, None, None
    if head:
        yield *head, digest.hexdigest()


def _in_text_order(rows: Iterator[tuple]) -> Iterator[tuple]:
    """The figures of each document with the digest of its pieces in the order of the text, once for each copy."""
    head = digest = None
    for row in rows:
        if row[1] == -1:
            if head:
                yield from [(*head[3:8], head[9], digest.hexdigest())] * head[8]
            head, digest = row, hashlib.sha256()
        else:
            digest.update(row[2])
    if head:
        yield from [(*head[3:8], head[9], digest.hexdigest())] * head[8]


def digests(docs: DataFrame, draw: Draw = Draw()) -> DataFrame:
    """Per row: doc_id, n, form, prefix_chars, middle_chars, and the SHA-256 of its output and of the text restored from it."""
    sorted_out = pieces(docs, draw).repartition("key").sortWithinPartitions("key", "place")
    by_section = sorted_out.mapInArrow(lambda b: _batches(_in_output_order(_streamed(b)), ORDERED, 2), ORDERED)
    # the same partitions hold the same keys, so that a sort suffices
    restored = by_section.sortWithinPartitions("key", "place")
    return restored.mapInArrow(lambda b: _batches(_in_text_order(_rows(b)), DIGESTS), DIGESTS)


def transform(docs: DataFrame, draw: Draw = Draw()) -> DataFrame:
    """Per row: doc_id, n, form, prefix_chars, middle_chars and the text ``output``, assembled from its sorted pieces."""
    def assembled(rows: Iterator[tuple[tuple, int]]) -> Iterator[tuple]:
        head, parts, times = None, [], 0
        for row, copies in rows:
            if row[1] == 0:
                if head:
                    yield from [(*head, b"".join(parts).decode())] * times
                head, parts, times = row[3:], [], copies
            else:
                parts.append(row[2])
        if head:
            yield from [(*head, b"".join(parts).decode())] * times

    schema = HEAD + ", output string"
    return (pieces(docs, draw).repartition("key").sortWithinPartitions("key", "place")
            .mapInArrow(lambda b: _batches(assembled(_streamed(b)), schema), schema))


def restored_text(form: Column, output: Column) -> Column:
    """The text behind an output and its form, as an expression."""
    between = lambda a, b: F.substring_index(F.substring_index(output, b, 1), a, -1)
    last = F.substring_index(output, MIDDLE, -1)
    return (F.when(form == "psm", F.concat(between(PREFIX, SUFFIX), last, between(SUFFIX, MIDDLE)))
            .when(form == "spm", F.concat(between(PREFIX, MIDDLE), last, between(SUFFIX, PREFIX))).otherwise(output))
