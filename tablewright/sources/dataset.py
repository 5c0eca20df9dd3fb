"""The two versions of a table and the rows-level view helpers.

``Dataset`` is an immutable value: the original table, an optional cleaned
table and which of the two is active.  Operators read ``dataset.active``;
the profile is computed from the active table on demand, so it can never
be stale (the reference's A5 quirk cannot arise).
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import named, row_digest
from ..operators import profile as P

VIEWS = ("original", "cleaned")


@dataclass(frozen=True)
class Dataset:
    original: DataFrame
    cleaned: DataFrame | None = None
    view: str = "original"
    name: str = "data"

    def __post_init__(self):
        if self.view not in VIEWS:
            raise ValueError(f"view must be one of {VIEWS}")

    @property
    def active(self) -> DataFrame:
        """A4: cleaned if selected and present, else original."""
        if self.view == "cleaned" and self.cleaned is not None:
            return self.cleaned
        return self.original

    @property
    def active_view(self) -> str:
        return "cleaned" if self.view == "cleaned" and self.cleaned is not None else "original"

    def show_view(self, view: str) -> "Dataset":
        return replace(self, view=view)

    def with_cleaned(self, df: DataFrame) -> "Dataset":
        """Replace the cleaned table and switch to it."""
        return replace(self, cleaned=df, view="cleaned")

    def profile(self, **kw) -> P.Profile:
        """A5: profile of the active table."""
        return P.profile(self.active, **kw)

    def register(self, prefix: str | None = None) -> None:
        """Expose both versions and the active one as temporary views."""
        p = prefix or self.name
        self.original.createOrReplaceTempView(f"{p}_original")
        if self.cleaned is not None:
            self.cleaned.createOrReplaceTempView(f"{p}_cleaned")
        self.active.createOrReplaceTempView(p)


def head(df: DataFrame, n: int = 5, key: str | list[str] | None = None) -> DataFrame:
    """A2: first n rows in key order (rows have no order without a key)."""
    if not 1 <= n:
        raise ValueError("n must be positive")
    keys = [key] if isinstance(key, str) else list(key or df.columns)
    return df.orderBy(*keys).limit(n)


def tail(df: DataFrame, n: int = 5, key: str | list[str] | None = None) -> DataFrame:
    """A3: last n rows in key order, returned ascending."""
    keys = [key] if isinstance(key, str) else list(key or df.columns)
    return df.orderBy(*[F.col(k).desc() for k in keys]).limit(n).orderBy(*keys)


def compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """(side, n_rows): rows only before ('removed') and only after ('added'),
    as multisets; plus whether the schemas differ."""
    spark = before.sparkSession
    if before.schema != after.schema:
        nb, na = before.count(), after.count()
        return spark.createDataFrame([("removed", nb, True), ("added", na, True)],
                                     "side string, n_rows long, schema_changed boolean")
    # each side is read once and only row digests with a sign move: +1 before, -1 after
    signed = [df.select(*row_digest([named(c) for c in df.columns]), F.lit(sign).alias("__tw_n")) for df, sign in ((before, 1), (after, -1))]
    net = signed[0].unionByName(signed[1]).groupBy("__tw_h0", "__tw_h1").agg(F.sum("__tw_n").alias("n"))
    total = lambda c: F.coalesce(F.sum(F.greatest(c, F.lit(0))), F.lit(0)).cast("long")
    both = net.agg(total(F.col("n")).alias("removed"), total(-F.col("n")).alias("added"))
    return both.select(F.explode(F.array(*(F.struct(F.lit(side).alias("side"), F.col(side).alias("n_rows")) for side in ("removed", "added")))).alias("s")) \
        .select("s.side", "s.n_rows", F.lit(False).alias("schema_changed"))


def change_status(before: DataFrame | None, after: DataFrame | None) -> str:
    """G5: 'created' (no table before), 'changed' or 'unchanged'."""
    if after is None:
        return "unchanged"
    if before is None:
        return "created"
    rows = compare(before, after).collect()
    return "changed" if any(r["n_rows"] or r["schema_changed"] for r in rows) else "unchanged"
