"""Line dedup by a deletion-neighbourhood join; DataFrame operations only.

Lines without a word (``[^\\x20\\x09-\\x0D]+``) are layout and stay.  A line goes if
an earlier line, by (document, line number), has the same text, or lies within
one word edit (no word, or one word replaced, inserted or deleted) and both have
at least ``near_words`` words.  Lines are
judged on the input, so a line also goes when the earlier one goes itself.

1. Lines with equal texts: the first place of each distinct line.
2. Which distinct lines can have a neighbour at all: lines within one edit
   share their first or their last half word for word, so lines that share
   neither (with a line of a fitting length) are settled.
3. For the rest, all variants within the edit bound as hashed keys: the line
   without word i, and the line with a gap before word i.  The hash of what
   stands before and of what stands after comes from running sums over the
   words, so a line of n words costs n, not n^2.  Two lines that share a key
   are within one edit, and lines within one edit share one.
4. Per key the earliest line; the lines that share the key are joined with it
   and verified on the words themselves.

Keys are aggregated before they are joined and joins are plain equi-joins,
so Spark splits the rows of a hot key.

Null and empty texts have no lines.  Rows without an id come after all
others.  Repeated rows with one id and text are one document, and all lose the
same lines.  Other columns of the input pass through ``deduplicate``
unchanged.  An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import order_id, reliable, whole_row, written

NEAR_WORDS = 8
SIEVE = 2**20
SPACES = " \t\n\x0b\x0c\r"
PLACE = ["id", "row_key", "line_no"]


def _words(line: Column) -> Column:
    # a split at one plain character is several times faster than one at a pattern
    other = reduce(Column.__or__, (line.contains(c) for c in SPACES[1:]))
    split = F.when(other, F.split(line, r"[\x20\x09-\x0D]+")).otherwise(F.split(line, " "))
    return F.array_remove(split, "")


def _rows(docs: DataFrame) -> DataFrame:
    """id, row_key and text of each document, dealt by id once for all steps that need the texts."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs.select(order_id(docs["doc_id"]).alias("id"), F.xxhash64(text).alias("row_key"), text.alias("text"))


def _lines(rows: DataFrame) -> DataFrame:
    return (rows.select("id", "row_key", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
            .where(F.btrim("line", F.lit(SPACES)) != "")
            .withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(7), "line")}))


def _half_keys(near_words: int) -> Column:
    """Keys of which lines within one edit share at least one: a side, and that half of the shorter line's length."""
    n, words = F.size("words"), F.col("words")
    keys = []
    for shorter in (n - 1, n):
        half = F.floor(shorter / 2).cast("int")
        keys += [F.xxhash64(F.lit(0), F.slice(words, F.lit(1), half)), F.xxhash64(F.lit(1), F.slice(words, n - half + 1, half))]
    return F.when(n >= near_words, F.array_distinct(F.array(*keys)))


def _first_places(lines: DataFrame, *more: Column) -> DataFrame:
    """Each distinct line (two 64-bit hashes of its text) with its first place, and the first of ``more``."""
    return lines.groupBy("h1", "h2").agg(F.min(F.struct(*PLACE)).alias("first"), *more)


def _with_neighbours(firsts: DataFrame) -> DataFrame:
    """Places of the distinct lines that share a half with another one."""
    keyed = firsts.where(F.col("halves").isNotNull()).select("first", F.explode("halves").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    return keyed.join(shared, "key").select("first.*").distinct()


def _variants(lines: DataFrame) -> DataFrame:
    """place, key, and how it arose: ``at`` (1-based), ``gap`` (before word ``at``; else without it)."""
    n = F.size("words")
    words = (lines.select(*PLACE, n.alias("n"), F.posexplode("words").alias("i", "word"))
             # 40 bits each, so that sums over any line stay exact
             .withColumn("left", F.shiftrightunsigned(F.xxhash64("word", "i"), 24))
             .withColumn("right", F.shiftrightunsigned(F.xxhash64("word", F.col("n") - F.col("i"), F.lit(1)), 24)))
    by = Window.partitionBy(*PLACE)  # one line
    upto = by.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    sums = (words.withColumn("l", F.sum("left").over(upto)).withColumn("r", F.sum("right").over(upto))
            .withColumn("total", F.sum("right").over(by)))
    before, after = F.col("l") - F.col("left"), F.col("total") - F.col("r")
    at = F.col("i") + 1
    row = lambda gap, place, l, r: F.struct(F.xxhash64(place, l, r).alias("key"), place.alias("at"), F.lit(gap).alias("gap"))  # noqa: E731,E741
    out = F.array(row(False, at, before, after), row(True, at, before, after + F.col("right")))
    last = F.array(row(True, at + 1, F.col("l"), F.lit(0).cast("bigint")))
    return sums.select(*PLACE, F.explode(F.when(at == F.col("n"), F.concat(out, last)).otherwise(out)).alias("v")).select(*PLACE, "v.*")


def _residue(words: Column, at: Column, gap: Column) -> Column:
    """The words of a variant."""
    return F.when(gap, words).otherwise(F.concat(F.slice(words, F.lit(1), at - 1), F.slice(words, at + 1, F.size(words))))


def _near(candidates: DataFrame) -> DataFrame:
    """Places of the candidate lines that have an earlier one within one edit."""
    every = _variants(candidates)
    shared = every.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    variants = reliable(every.join(shared, "key"))  # few: keys of neighbours
    place = F.struct(*PLACE)
    earliest = variants.groupBy("key").agg(F.min(F.struct(*PLACE, "at", "gap")).alias("e"))
    pairs = (variants.join(earliest, "key").where(F.struct(*(F.col(f"e.{c}") for c in PLACE)) < place)
             .groupBy(*PLACE).agg(F.min(F.struct("e", "at", "gap")).alias("p"))
             .select(*PLACE, "p.e", "p.at", "p.gap"))
    mine = candidates.select(*PLACE, F.col("words").alias("mine"))
    theirs = candidates.select(F.struct(*PLACE).alias("e_place"), F.col("words").alias("theirs"))
    checked = (pairs.join(mine, PLACE).withColumn("e_place", F.struct(*(F.col(f"e.{c}") for c in PLACE)))
               .join(theirs, "e_place"))
    same = _residue(F.col("mine"), F.col("at"), F.col("gap")) == _residue(F.col("theirs"), F.col("e.at"), F.col("e.gap"))
    return checked.where(same).select(*PLACE)


def removed_lines(rows: DataFrame, near_words: int = NEAR_WORDS) -> DataFrame:
    """id, row_key and the sorted array ``gone`` of line numbers, for documents that lose lines."""
    lines = _lines(rows)
    place = F.struct(*(F.col(f"l.{c}") for c in PLACE))
    firsts = written(_first_places(lines.withColumn("words", _words(F.col("line"))).withColumn("keys", _half_keys(near_words)),
                                   F.first("keys").alias("halves")))
    copies = (lines.select(*PLACE, "h1", "h2").alias("l").join(firsts.select("h1", "h2", "first").alias("f"), ["h1", "h2"])
              .where(place != F.col("first")).select(*(F.col(f"l.{c}") for c in PLACE)))
    wanted = (_with_neighbours(firsts).groupBy("id", "row_key")
              .agg(F.collect_set("line_no").alias("wanted")))  # of one document
    wanted = reliable(wanted)
    # at most SIEVE numbers are broadcast; most documents without a wanted line then stay out of the shuffle
    sieve = F.pmod(F.xxhash64("id", "row_key"), F.lit(SIEVE)).cast("int").alias("sieve")
    some = rows.select("*", sieve).join(F.broadcast(wanted.select(sieve).distinct()), "sieve", "left_semi").drop("sieve")
    candidates = written(some.join(wanted, ["id", "row_key"]).dropDuplicates(["id", "row_key"])
                         .select("id", "row_key", "text", "wanted")
                         .select("id", "row_key", "wanted", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
                         .where(F.array_contains("wanted", F.col("line_no")))
                         .select(*PLACE, _words(F.col("line")).alias("words")))
    gone = copies.unionByName(_near(candidates))
    return gone.groupBy("id", "row_key").agg(F.array_sort(F.collect_set("line_no")).alias("gone"))


def _kept_text(text: Column, gone: Column) -> Column:
    """``gone`` is sorted; one pass over the lines, whatever their number."""
    run = lambda no, i: F.concat(F.array_repeat(F.lit(False), no - F.when(i == 0, -1).otherwise(F.get(gone, i - 1)) - 1),
                                 F.array(F.lit(True)))
    lines = F.zip_with(F.split(text, "\n"), F.flatten(F.transform(gone, run)), lambda line, goes: F.when(goes, None).otherwise(line))
    return F.when(gone.isNull(), text).otherwise(F.array_join(lines, "\n"))


def deduplicate(docs: DataFrame, near_words: int = NEAR_WORDS) -> DataFrame:
    """``docs`` with all its columns; ``text`` keeps the lines that stay, and null texts stay null."""
    names = docs.columns
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    keyed = docs.select(whole_row(docs), order_id(docs["doc_id"]).alias("id"),
                        F.xxhash64(text).alias("row_key"))
    kept = keyed.join(removed_lines(_rows(docs), near_words), ["id", "row_key"], "left")
    return kept.select(*((_kept_text(F.col("__tw_row.text"), F.col("gone")) if c == "text" else F.col(f"__tw_row.`{c}`")).alias(c)
                         for c in names))


def line_counts(docs: DataFrame, near_words: int = NEAR_WORDS) -> DataFrame:
    """doc_id, n_lines (with a word), n_removed and kept_text (null: empty) of every row."""
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    keyed = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), order_id(docs["doc_id"]).alias("id"),
                        F.xxhash64(text).alias("row_key"), text.alias("text"))
    n_lines = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D][^\n]*"))
    return (keyed.join(removed_lines(_rows(docs), near_words), ["id", "row_key"], "left")
            .select("doc_id", n_lines.cast("bigint").alias("n_lines"),
                    F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_removed"),
                    _kept_text(F.col("text"), F.col("gone")).alias("kept_text")))
