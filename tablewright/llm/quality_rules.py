"""Quality rules with a bitmask ledger.

Every rule is evaluated once per document.  ``ledger`` keeps the measurements
and one bit per failed rule; a versioned ``Policy`` is a mask over these bits,
so verdicts of any policy and ablations ("how many more documents stay without
rule r") come from bitwise arithmetic on the ledger, without another look at
the texts.

Words are ``[^\\x20\\x09-\\x0D]+``.  A null or empty text has no words and fails
``few_words``.  Rows are judged one by one, so repeated rows and repeated ids
get equal verdicts; other columns of the input are ignored; an empty table
gives an empty ledger.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import forgetting, ids_and_texts, whole_row

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower",
            "n_marks")

SYMBOLS = b"#*$%&|<>"
MARKS = b"!?"
UPPER = bytes(range(ord("A"), ord("Z") + 1))
LOWER = bytes(range(ord("a"), ord("z") + 1))
CONTINUATION = bytes(range(0x80, 0xC0))  # UTF-8 bytes that do not begin a code point


@dataclass(frozen=True)
class Rule:
    """``failed`` is SQL over the measurements; ``bit`` never changes once released."""

    bit: int
    name: str
    failed: str


RULES = (
    Rule(0, "few_words", "n_words < 50"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "100 * n_symbols > 10 * n_words"),
    Rule(3, "upper_case", "n_upper > n_lower"),
    Rule(4, "exclamations", "100 * n_marks > 30 * n_words"),
    Rule(5, "duplicate_lines", "100 * n_dup_lines > 60 * n_lines"),
    Rule(6, "long_words", "word_chars > 40 * n_words"),
)


@dataclass(frozen=True)
class Policy:
    """A document is kept when it fails none of ``rules``."""

    version: str
    rules: tuple[str, ...]

    def mask(self, rules: tuple[Rule, ...] = RULES) -> int:
        bits = {r.name: 1 << r.bit for r in rules}
        return sum(bits[name] for name in self.rules)


BASE = Policy("base", ("few_words", "repeated_words"))
STANDARD = Policy("standard-1", tuple(r.name for r in RULES))


def _repeated_words(words: list[bytes]) -> int:
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    covered, end = 0, 0  # words before ``end`` are already counted
    for i, window in enumerate(windows):
        if counts[window] > 1:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


def measure(text: bytes) -> tuple[int, ...]:
    """The measurements of one UTF-8 text, in the order of MEASURES."""
    words = text.split()  # for bytes: runs of \\x20 and \\x09-\\x0D
    lines = [line for line in text.split(b"\n") if line.strip()]
    count = lambda chars: len(text) - len(text.translate(None, chars))
    return (len(words), len(b"".join(words).translate(None, CONTINUATION)), count(SYMBOLS), len(lines) - len(set(lines)),
            _repeated_words(words), len(lines), count(UPPER), count(LOWER), count(MARKS))


def _measure_batches(batches: Iterator[pa.RecordBatch], some: int = 512) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, some):
            batch = whole.slice(at, some)
            texts = batch.column(1) if batch.num_columns > 1 else pc.struct_field(batch.column(0), "text")
            columns = zip(*(measure(t or b"") for t in texts.cast(pa.binary()).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns)],
                                             ["__tw_row", *MEASURES])


def measured(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The measurements beside a struct ``__tw_row`` of the named columns, so that no names clash."""
    rows = docs.select(whole_row(docs, columns))
    if "text" not in columns or not isinstance(docs.schema["text"].dataType, T.StringType):
        rows = docs.select(whole_row(docs, columns), docs["text"].cast("string").alias("__tw_text"))
    schema = T.StructType([rows.schema["__tw_row"], *(T.StructField(m, T.LongType()) for m in MEASURES)])
    return rows.mapInArrow(forgetting(_measure_batches), schema)


def failure_bits(rules: tuple[Rule, ...] = RULES) -> Column:
    bits = F.lit(0).cast("bigint")
    for r in rules:
        bits = bits.bitwiseOR(F.when(F.expr(r.failed), F.lit(1 << r.bit)).otherwise(F.lit(0)).cast("bigint"))
    return bits


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the measurements and ``failure_bits`` of every row."""
    return measured(ids_and_texts(docs), ["doc_id"]).select("__tw_row.doc_id", *MEASURES,
                                                           failure_bits(rules).alias("failure_bits"))


def passes(policy: Policy, rules: tuple[Rule, ...] = RULES) -> Column:
    return F.col("failure_bits").bitwiseAND(F.lit(policy.mask(rules))) == 0


def ablations(rows: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per rule of ``policy``: documents that fail it, that fail only it, and that stay without it.

    The ledger is first counted by its masked bits (at most 2^rules patterns);
    every figure is then bitwise arithmetic on those patterns.
    """
    mask = policy.mask(rules)
    patterns = (rows.groupBy(F.col("failure_bits").bitwiseAND(F.lit(mask)).alias("pattern"))
                .agg(F.count(F.lit(1)).alias("n")))
    ruled = F.explode(F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(1 << r.bit).cast("bigint").alias("bit"))
                                for r in rules if r.name in policy.rules)))
    hit = F.col("pattern").bitwiseAND(F.col("bit")) != 0
    only = F.col("pattern") == F.col("bit")
    kept = F.col("pattern").bitwiseAND(F.lit(mask).bitwiseXOR(F.col("bit"))) == 0
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return (patterns.select("pattern", "n", ruled.alias("r")).select("pattern", "n", "r.*")
            .groupBy("rule").agg(total(hit).alias("n_failed"), total(only).alias("n_failed_only_this"),
                                 total(kept).alias("n_kept_without"), total(F.col("pattern") == 0).alias("n_kept")))


def kept_documents(docs: DataFrame, policy: Policy = STANDARD) -> DataFrame:
    """``docs`` with all its columns, without the rows the policy rejects."""
    return measured(docs, docs.columns).where(passes_measures(policy)).select("__tw_row.*")


def passes_measures(policy: Policy, rules: tuple[Rule, ...] = RULES) -> Column:
    return failure_bits(rules).bitwiseAND(F.lit(policy.mask(rules))) == 0
