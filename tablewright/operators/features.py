"""Feature preparation and data splits.

Schema-changing steps (one-hot levels, task type) take one small driver
action; the row work is a lazy projection.  Ranks for label codes come from
the skew-safe ``running_rank``.
"""

from __future__ import annotations

from pyspark.ml.feature import OneHotEncoder
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classes as C
from ..functions.columns import date_parts, fill, named
from . import stats
from .ranking import CUM, running_rank

# Regression when a numeric target has more distinct values than this.
MAX_CLASS_VALUES = 15
# Rows in which a continuous target is looked for before all its values are.
TASK_PROBE_ROWS = 10_000
# Hex digits of the key digest by which the stratified split counts a class
# (about a million prefixes); rows are ranked only within one prefix per class.
SPLIT_PREFIX_DIGITS = 5
# Label mappings up to this size are broadcast to the rows.
BROADCAST_LABELS = 100_000


def parse_feature_list(features) -> list[str] | None:
    """List, or comma-separated text, or None for "all but the target"."""
    if features is None:
        return None
    if isinstance(features, str):
        out = [f.strip() for f in features.split(",") if f.strip()]
        return out or None
    return list(features)


def select_features(df: DataFrame, target: str, features=None) -> list[str]:
    """Validated feature list."""
    if target not in df.columns:
        raise ValueError(f"target column {target!r} not found")
    feats = parse_feature_list(features)
    if feats is None:
        return [c for c in df.columns if c != target]
    C.check_columns(df, feats, "features")
    if target in feats:
        raise ValueError(f"target column {target!r} cannot be a feature")
    return feats


def category_levels(df: DataFrame, cols: list[str]) -> dict[str, list[str]]:
    """Sorted distinct non-null levels per column (one aggregate action)."""
    if not cols:
        return {}
    rows = stats.long_values(df, cols, value_type="string").distinct().collect()
    out = {c: [] for c in cols}
    for r in rows:
        out[r["column_name"]].append(r["v"])
    return {c: sorted(v) for c, v in out.items()}


def one_hot(df: DataFrame, cols: list[str], drop_first: bool = True,
            levels: dict[str, list[str]] | None = None) -> DataFrame:
    """0/1 double columns ``<col>_<level>``; the alphabetically first
    level is dropped; a missing value is all zeros."""
    levels = levels or category_levels(df, cols)
    out = []
    for c in df.columns:
        if c not in cols:
            out.append(F.col(c))
            continue
        lv = levels[c][1:] if drop_first else levels[c]
        out += [F.coalesce(F.col(c).cast("string") == F.lit(v), F.lit(False)).cast("double").alias(f"{c}_{v}")
                for v in lv]
    return df.select(*out)


def level_codes(df: DataFrame, cols: list[str]) -> tuple[DataFrame, dict[str, int]]:
    """(column_name, label, code) with codes 0.. in label order per column, and the number of levels per column.

    One scan for all columns; the levels are ranked where they are, only their numbers reach the driver."""
    levels = stats.long_values(df, cols, value_type="string").select("column_name", F.col("v").alias("label")).distinct()
    ranked = running_rank(levels, ["label"], ["column_name"]).rows
    codes = ranked.select("column_name", "label", (F.col(CUM) - 1).cast("int").alias("code"))
    sizes = {r["column_name"]: r["n"] for r in codes.groupBy("column_name").agg(F.count(F.lit(1)).alias("n")).collect()}
    return codes, {c: sizes.get(c, 0) for c in cols}


def one_hot_vectors(df: DataFrame, cols: list[str], out_cols: list[str] | None = None) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """E2 with any number of levels: (frame with one sparse vector per column, ``level_codes``, slots per column).

    Slot ``n - 1 - code`` belongs to the level of that code (so the encoder's ``dropLast`` drops the alphabetically
    first level); a missing value is all zeros.  A column without levels has one slot, always zero."""
    out_cols = out_cols or [f"{c}_vec" for c in cols]
    codes, sizes = level_codes(df, cols)
    x, slots, index = df, {}, [f"__tw_i{i}" for i in range(len(cols))]
    for c, idx in zip(cols, index):
        n = max(sizes[c], 2)  # a single level has no slot of its own: one slot that no row sets
        slots[c] = n - 1
        mine = codes.where(F.col("column_name") == c).select(
            F.col("label").alias("__tw_label"), (F.lit(n - 1) - F.col("code")).cast("double").alias(idx))
        right = F.broadcast(mine) if n <= BROADCAST_LABELS else mine   # else a shuffle join; AQE splits a hot level
        x = x.join(right, x["`" + c.replace("`", "``") + "`"].cast("string") == right["__tw_label"], "left").drop("__tw_label")
        # the number of categories is known, so the encoder needs no scan to find it
        x = x.withColumn(idx, F.coalesce(F.col(idx), F.lit(float(n - 1))).alias(
            idx, metadata={"ml_attr": {"type": "nominal", "name": idx, "num_vals": n}}))
    made = [f"__tw_o{i}" for i in range(len(cols))]
    x = OneHotEncoder(inputCols=index, outputCols=made, dropLast=True).fit(x).transform(x).drop(*index)
    kept = [named(c) for c in df.columns if c not in out_cols]
    return x.select(*kept, *(F.col(m).alias(o) for m, o in zip(made, out_cols))), codes, slots


def one_hot_vector(df: DataFrame, col: str, out_col: str | None = None) -> DataFrame:
    """``one_hot_vectors`` of one column, added to the frame."""
    return one_hot_vectors(df, [col], [out_col or f"{col}_vec"])[0]


def expand_dates(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Year, month, day, day of week (Monday 0) replace each datetime column."""
    cols = list(cols if cols is not None else C.datetime_columns(df))
    keep = [F.col(c) for c in df.columns if c not in cols]
    return df.select(*keep, *[p for c in cols for p in date_parts(F.col(c), c)])


def numeric_gate(df: DataFrame, cols: list[str]) -> None:
    """Every feature must be numeric (or a vector of numbers) after encoding."""
    bad = [c for c in cols if not (C.is_numeric(C.dtype_of(df, c)) or isinstance(C.dtype_of(df, c), VectorUDT))]
    if bad:
        raise ValueError(f"non-numeric columns remain after encoding: {', '.join(bad)}")


def encode_features(df: DataFrame, target: str, features=None, key: str | None = None) -> tuple[DataFrame, list[str], DataFrame | None, dict[str, int]]:
    """(frame with key?, target and numeric features, feature names, level codes, slots of the text features).

    Without a feature list every column but the target and the row key is a
    feature (the key is the row identity used for splitting).  A text column
    becomes one sparse vector of its 0/1 values under its own name, whatever
    its number of levels; the third result holds their ``level_codes``."""
    feats = select_features(df, target, features)
    if features is None and key:
        feats = [c for c in feats if c != key]
    keep = ([key] if key and key not in feats and key != target else [])
    x = df.select(*keep, target, *feats)
    cats = [c for c in feats if C.is_string(C.dtype_of(x, c))]
    dates = [c for c in feats if C.is_datetime(C.dtype_of(x, c))]
    codes, slots = None, {}
    if cats:
        x, codes, slots = one_hot_vectors(x, cats, cats)
        x = x.select(*keep, target, *feats)
    if dates:
        x = expand_dates(x, dates)
    # booleans become 0/1 (documented deviation, Q4)
    x = x.select(*[F.col(f.name).cast("double").alias(f.name) if C.is_boolean(f.dataType) and f.name != target
                   else F.col(f.name) for f in x.schema.fields])
    names = [c for c in x.columns if c not in keep and c != target]
    numeric_gate(x, names)
    return x, names, codes, slots


def median_impute(df: DataFrame, cols: list[str], fit_on: DataFrame | None = None,
                  method: str = "exact") -> tuple[DataFrame, dict]:
    """E5 / F2: fill missing values with per-column medians (of ``fit_on``,
    default the whole table, as the reference does before splitting)."""
    src = fit_on if fit_on is not None else df
    counts = {r["column_name"]: r["n_missing"] for r in stats.null_counts(df, cols).collect()} if cols else {}
    todo = [c for c in cols if counts.get(c, 0) > 0]
    if not todo:
        return df, {}
    med = {c: v[0] for c, v in stats.scalar_quantiles(src, todo, [0.5], method).items()}
    out = [fill(F.col(c), F.lit(med[c]), C.dtype_of(df, c)).alias(c) if c in med and med[c] is not None
           else F.col(c) for c in df.columns]
    return df.select(*out), med


def standard_scale(df: DataFrame, cols: list[str]) -> tuple[DataFrame, dict]:
    """(x - mean) / population std, 0 where std is 0; one aggregate."""
    row = stats.wide_agg(df, [e for c in cols for e in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))],
                         [2, 3] * len(cols))
    params = {c: (row[f"m_{c}"], row[f"s_{c}"]) for c in cols}
    out = []
    for c in df.columns:
        if c in params:
            m, s = params[c]
            out.append(F.coalesce((F.col(c) - F.lit(m)) / F.nullif(F.lit(s), F.lit(0.0)), F.lit(0.0)).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out), params


def detect_task(df: DataFrame, target: str, model_type: str = "auto") -> tuple[str, str | None, int]:
    """('regression' | 'classification', 'binary' | 'multiclass' | None, distinct values, counted up to 16).

    A continuous target mostly shows more than 15 values in its first rows, and then nothing else is read; all its
    values are looked through only where those rows hold fewer, and then no more than 16 are kept."""
    if model_type not in ("auto", "regression", "classification"):
        raise ValueError(f"invalid model_type {model_type!r}; choose auto, regression or classification")
    dt = C.dtype_of(df, target)
    present = df.select(named(target).alias("y")).where("y is not null")
    most = MAX_CLASS_VALUES + 1
    k = present.limit(TASK_PROBE_ROWS).distinct().limit(most).count()
    if k < most:
        k = present.distinct().limit(most).count()
    numeric = C.is_numeric(dt)
    if model_type == "auto":
        if numeric and k > MAX_CLASS_VALUES:
            return "regression", None, k
        if not (numeric or C.is_string(dt) or C.is_boolean(dt)) and k > MAX_CLASS_VALUES:
            raise ValueError(f"cannot determine the task for {target!r}")
        task = "classification"
    else:
        task = model_type
    if task == "classification":
        if k == 2:
            return task, "binary", k
        if k > 2:
            return task, "multiclass", k
        raise ValueError("target has only one distinct value; cannot train a model")
    return task, None, k


def label_codes(df: DataFrame, target: str) -> DataFrame:
    """(label, code) with codes 0.. in sorted label order.

    The distinct labels are ranked with the range-partitioned running rank,
    so even a very wide label set is never sorted in one task."""
    labels = df.select(F.col(target).alias("label")).where(F.col("label").isNotNull()).distinct()
    r = running_rank(labels, ["label"])
    return r.rows.select("label", (F.col(CUM) - 1).cast("int").alias("code"))


def encode_labels(df: DataFrame, target: str, out_col: str = "label") -> tuple[DataFrame, DataFrame]:
    """E8 applied: adds ``out_col`` (double code) next to the target."""
    codes = label_codes(df, target)
    n = codes.count()
    right = codes.withColumnRenamed("label", "_lbl")
    if n <= BROADCAST_LABELS:
        right = F.broadcast(right)
    j = df.join(right, df[target] == right["_lbl"], "left").drop("_lbl")
    return j.withColumn(out_col, F.col("code").cast("double")).drop("code"), codes


def split_hash(key: str | Column) -> Column:
    """E9 hash: first 32 bits of md5(key) as a number, modulo 10000."""
    k = F.col(key) if isinstance(key, str) else key
    return F.conv(F.substring(F.md5(k.cast("string")), 1, 8), 16, 10).cast("long") % 10000


def random_split(df: DataFrame, key: str, test_size: float = 0.2) -> DataFrame:
    """Adds boolean ``is_test``: deterministic in the key, independent
    of partitioning and executor loss."""
    return df.withColumn("is_test", split_hash(key) < int(round(test_size * 10000)))


def stratified_split(df: DataFrame, label: str, key: str, test_size: float = 0.2, few_classes: bool = False) -> DataFrame:
    """Per class, the ceil(test_size * n_class) rows first in
    (md5(key), key) order form the test set; rows with one key stay together.

    Two narrow passes over (label, key) find the last (digest, key) of each
    class's test rows: counts per class and digest prefix tell at which prefix
    a class reaches its share, and only the rows with that prefix are ranked.
    The table itself is read once and compares its keys with those bounds;
    ``few_classes``: they are broadcast, so the table is not dealt by class."""
    digest = F.md5(named(key).cast("string"))
    keys = df.select(named(label).alias("__tw_class"), named(key).alias("__tw_key"), digest.alias("__tw_digest")) \
        .withColumn("__tw_prefix", F.substring("__tw_digest", 1, SPLIT_PREFIX_DIGITS))
    counts = keys.groupBy("__tw_class", "__tw_prefix").agg(F.count(F.lit(1)).alias("n"))
    by_class = Window.partitionBy("__tw_class")
    upto = F.sum("n").over(by_class.orderBy("__tw_prefix").rowsBetween(Window.unboundedPreceding, 0))
    edges = counts.withColumn("upto", upto).withColumn("want", F.ceil(F.lit(test_size) * F.sum("n").over(by_class))) \
        .where((F.col("upto") >= F.col("want")) & (F.col("upto") - F.col("n") < F.col("want"))) \
        .select(F.col("__tw_class").alias("__tw_c"), F.col("__tw_prefix").alias("__tw_edge"),
                (F.col("want") - F.col("upto") + F.col("n")).alias("__tw_rest"))
    same = F.col("__tw_class").eqNullSafe(F.col("__tw_c"))
    rank = F.row_number().over(Window.partitionBy("__tw_class").orderBy("__tw_digest", "__tw_key"))
    last = keys.join(edges, same & (F.col("__tw_prefix") == F.col("__tw_edge"))) \
        .withColumn("__tw_rank", rank).where(F.col("__tw_rank") == F.col("__tw_rest")) \
        .select("__tw_c", F.struct(F.col("__tw_digest").alias("d"), F.col("__tw_key").alias("k")).alias("__tw_last"))
    place = F.struct(digest.alias("d"), named(key).alias("k"))
    joined = df.withColumn("__tw_place", place).join(F.broadcast(last) if few_classes else last, named(label).eqNullSafe(F.col("__tw_c")), "left")
    inside = F.coalesce(F.col("__tw_place") <= F.col("__tw_last"), F.lit(False))
    return joined.withColumn("is_test", inside).drop("__tw_place", "__tw_c", "__tw_last")
