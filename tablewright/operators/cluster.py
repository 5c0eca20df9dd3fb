"""Clustering (F1-F13): K-means with readable per-cluster summaries.

Scaling and imputation are single aggregates turned into literals; the
fit is Spark ML ``KMeans`` (k-means|| initialisation, distributed Lloyd
steps).  Assigning rows to known centres (F7) is a narrow projection: the
k distances are column expressions over literal centres, so no join or
pairing of rows is needed.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as X
from ..functions import classes as C
from . import features as FE
from . import stats
from .cache import hold, spread

SCALED = "_s_"
# Rows of a partition of the table that K-means reads in every step.
PARTITION_ROWS = 100_000


def cluster_features(df: DataFrame, features=None, exclude=()) -> list[str]:
    """named features must exist and be numeric; default all numeric."""
    feats = FE.parse_feature_list(features)
    if feats:
        C.check_columns(df, feats, "features")
        bad = [c for c in feats if not C.is_numeric(C.dtype_of(df, c))]
        if bad:
            raise ValueError(f"clustering needs numeric features; not numeric: {', '.join(bad)}")
    else:
        feats = [c for c in C.numeric_columns(df) if c not in exclude]
    if not feats:
        raise ValueError("no numeric columns available for clustering")
    return feats


def scaled_frame(df: DataFrame, feats: list[str], keep: list[str]) -> tuple[DataFrame, dict, dict]:
    """F2 + F3: keep columns, original features and ``_s_<f>`` scaled copies."""
    imputed, med = FE.median_impute(df.select(*keep, *feats), feats)
    base = imputed.select(*keep, *feats, *[F.col(c).cast("double").alias(SCALED + c) for c in feats])
    scaled, params = FE.standard_scale(base, [SCALED + c for c in feats])
    params = {c: params[SCALED + c] for c in feats}
    return scaled, params, med


def check_k(k: int, n_rows: int) -> None:
    """F4."""
    if k <= 1:
        raise ValueError("number of clusters must be greater than 1")
    if k >= n_rows:
        raise ValueError(f"number of clusters ({k}) must be below the number of rows ({n_rows})")


def squared_distance(feats: list[str], centre: list[float], prefix: str = SCALED):
    d = F.lit(0.0)
    for c, v in zip(feats, centre):
        diff = F.col(prefix + c) - F.lit(float(v))
        d = d + diff * diff
    return d


def assign(df: DataFrame, feats: list[str], centres: list[list[float]], prefix: str = SCALED) -> DataFrame:
    """nearest centre (ties to the lower index) and its squared distance."""
    cands = F.array(*[F.struct(squared_distance(feats, c, prefix).alias("d"), F.lit(j).alias("c"))
                      for j, c in enumerate(centres)])
    best = F.array_min(cands)
    return df.withColumn("_best", best).withColumn("cluster", F.col("_best.c")) \
        .withColumn("dist2", F.col("_best.d")).drop("_best")


def centres_original(centres: list[list[float]], feats: list[str], params: dict, spark) -> DataFrame:
    """F8: centres back in original units: c * std + mean (std 0 -> mean)."""
    rows = []
    for j, c in enumerate(centres):
        for f, v in zip(feats, c):
            m, s = params[f]
            rows.append((j, f, float(v) * (s or 0.0) + m))
    return spark.createDataFrame(rows, "cluster int, feature string, value double")


def cluster_sizes(assigned: DataFrame, k: int) -> DataFrame:
    """(cluster, size, percentage) with empty clusters kept."""
    spark = assigned.sparkSession
    counts = assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    total = F.sum("size").over(Window.partitionBy())  # k rows
    allk = spark.range(k).select(F.col("id").cast("int").alias("cluster"))
    j = allk.join(F.broadcast(counts) if k <= 100_000 else counts, "cluster", "left") \
        .select("cluster", F.coalesce("size", F.lit(0)).cast("long").alias("size"))
    return j.withColumn("percentage", X.round_half_even(F.col("size") / total * 100, 2))


def cluster_summary(assigned: DataFrame, feats: list[str], method: str = "exact") -> DataFrame:
    """describe of the original values per cluster:
    (cluster, column_name, count, mean, std, min, q25, q50, q75, max)."""
    m = stats.moments(assigned, feats, by=["cluster"])
    q = stats.quantile_table(assigned, feats, [0.25, 0.5, 0.75], by=["cluster"], method=method,
                             names=["q25", "q50", "q75"])
    return m.join(q, ["cluster", "column_name"], "left") \
        .select("cluster", "column_name", "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def inertia(assigned: DataFrame) -> DataFrame:
    """sum of squared distances to the assigned centres."""
    return assigned.agg(F.sum("dist2").alias("inertia"))


def join_labels(original: DataFrame, assigned: DataFrame, key: str) -> DataFrame:
    """labels back onto the original rows (equi-join on the row key)."""
    return original.join(assigned.select(key, "cluster"), key, "inner")


@dataclass
class ClusterResult:
    features: list
    params: dict
    medians: dict
    centres: list
    assignments: DataFrame      # key, original features, scaled features, cluster, dist2
    inertia: float
    k: int

    def sizes(self) -> DataFrame:
        return cluster_sizes(self.assignments, self.k)

    def summary(self) -> DataFrame:
        return cluster_summary(self.assignments, self.features)

    def centres_original(self) -> DataFrame:
        return centres_original(self.centres, self.features, self.params, self.assignments.sparkSession)

    def scatter(self) -> DataFrame:
        """first two features (original units) with the cluster label."""
        f = self.features[:2]
        return self.assignments.select(*self.assignments.columns[:1], *f, "cluster")


def kmeans(df: DataFrame, key: str, k: int = 3, features=None, n_init: int = 10, seed: int = 42,
           max_iter: int = 300, tol: float = 1e-4, exclude=(), parallelism: int = 4) -> ClusterResult:
    """K-means on standardised features, best of ``n_init`` seeds."""
    feats = cluster_features(df, features, exclude=(key, *exclude))
    scaled, params, med = scaled_frame(df, feats, [key])
    n_rows = df.count()
    check_k(k, n_rows)
    # each of the many steps is as long as its longest task
    scaled = hold(spread(scaled, n_rows, PARTITION_ROWS))
    # not persisted itself: K-means then keeps the points as objects, where it would else decode every row in every step
    vec = VectorAssembler(inputCols=[SCALED + c for c in feats], outputCol="_vec").transform(scaled).select("_vec")

    def fit(i: int):
        model = KMeans(k=k, featuresCol="_vec", initMode="k-means||", seed=seed + i, maxIter=max_iter,
                       tol=tol).fit(vec)
        return model.summary.trainingCost, i, model

    # the restarts are independent Spark jobs: submit them from a few driver
    # threads so small fits overlap; the choice is deterministic (cost, seed)
    with ThreadPoolExecutor(max_workers=max(1, min(parallelism, n_init))) as pool:
        fits = list(pool.map(fit, range(n_init)))
    cost, _, model = min(fits, key=lambda t: (t[0], t[1]))
    centres = [list(map(float, c)) for c in model.clusterCenters()]
    assigned = assign(scaled, feats, centres)
    return ClusterResult(feats, params, med, centres, assigned, float(cost), k)
