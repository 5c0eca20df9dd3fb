"""CSV source (A1): header row, null tokens, whole-column type inference.

Spark's CSV reader accepts a single ``nullValue`` and its ``inferSchema``
turns a column with ``NA`` and ``null`` into text.  The source therefore
reads text, maps every null token to NULL, and decides each column's type
in one aggregate over all rows (no sampling): bigint if every non-null
value is an integer of 64 bits, decimal(38,0) if every one is an integer of
at most 38 digits, double if every one is a number, boolean if every one is
true/false, else text.  A file whose quoted fields hold line breaks is read
record by record instead of line by line; whether it is one shows in its
lines, as a record that goes on begins with an odd number of quotes.  Dates stay text, as in the reference; type
fixing (``clean``) converts them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import NULL_TOKENS, NUMBER_PATTERN, named
from ..operators.stats import wide_agg

INTEGER_PATTERN = r"^[+-]?\d{1,38}$"
BOOLEAN_VALUES = ("true", "false")


def _nullify(c: Column, tokens) -> Column:
    t = F.trim(c)
    return F.when(c.isNull() | t.isin(list(tokens)), F.lit(None)).otherwise(c)


def breaks_in_quotes(spark: SparkSession, path: str, encoding: str = "UTF-8") -> bool:
    """Whether a line has an odd number of quotes, so that a quoted field goes on in the next line."""
    lines = spark.read.option("header", False).option("sep", "\u0001").option("quote", "").option("encoding", encoding).schema("line string").csv(path) \
        if encoding.upper().replace("-", "") != "UTF8" else spark.read.text(path).toDF("line")
    quotes = F.length("line") - F.length(F.replace(F.col("line"), F.lit('"'), F.lit("")))
    return not lines.where(quotes % 2 == 1).isEmpty()


def read_csv_text(spark: SparkSession, path: str, sep: str = ",", null_tokens=NULL_TOKENS,
                  encoding: str = "UTF-8", multi_line: bool | None = None) -> DataFrame:
    """All columns as text.  Quotes are doubled inside quoted fields; ``multi_line`` reads line breaks inside
    quotes, at the price that a file is not split between tasks (None: only where there are such line breaks)."""
    if multi_line is None:
        multi_line = breaks_in_quotes(spark, path, encoding)
    raw = (spark.read.option("header", True).option("sep", sep).option("encoding", encoding)
           .option("inferSchema", False).option("quote", '"').option("escape", '"').option("multiLine", multi_line).csv(path))
    return raw.select(*[_nullify(named(c), null_tokens).alias(c) for c in raw.columns])


def infer_types(df: DataFrame) -> dict[str, str]:
    """Column -> 'bigint' | 'decimal(38,0)' | 'double' | 'boolean' | 'string' from one aggregate."""
    aggs = []
    for i, c in enumerate(df.columns):
        t = F.trim(named(c))
        nn = named(c).isNotNull()
        whole = nn & t.rlike(INTEGER_PATTERN)
        aggs += [F.count(named(c)).alias(f"n{i}"),
                 F.count_if(whole).alias(f"i{i}"),
                 F.count_if(whole & t.try_cast("bigint").isNotNull()).alias(f"l{i}"),
                 F.count_if(nn & t.rlike(NUMBER_PATTERN)).alias(f"d{i}"),
                 F.count_if(nn & F.lower(t).isin(*BOOLEAN_VALUES)).alias(f"b{i}")]
    if not aggs:
        return {}
    row = wide_agg(df, aggs)
    out = {}
    for i, c in enumerate(df.columns):
        n = row[f"n{i}"]
        if n == 0:
            out[c] = "string"
        elif row[f"l{i}"] == n:
            out[c] = "bigint"
        elif row[f"i{i}"] == n:
            out[c] = "decimal(38,0)"
        elif row[f"d{i}"] == n:
            out[c] = "double"
        elif row[f"b{i}"] == n:
            out[c] = "boolean"
        else:
            out[c] = "string"
    return out


def apply_types(df: DataFrame, types: dict[str, str]) -> DataFrame:
    cols = []
    for c in df.columns:
        t = types.get(c, "string")
        v = F.trim(named(c))
        if t == "boolean":
            cols.append((F.lower(v) == "true").alias(c))
        elif t != "string":
            cols.append(v.cast(t).alias(c))
        else:
            cols.append(named(c))
    return df.select(*cols)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, sep: str = ",",
             null_tokens=NULL_TOKENS, infer: bool = True, encoding: str = "UTF-8", multi_line: bool | None = None) -> DataFrame:
    """A1: read a CSV file or folder into a typed DataFrame."""
    text = read_csv_text(spark, path, sep, null_tokens, encoding, multi_line)
    if schema is not None:
        st = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
        return text.select(*[F.trim(named(f.name)).cast(f.dataType).alias(f.name) for f in st.fields])
    if not infer:
        return text
    return apply_types(text, infer_types(text))
