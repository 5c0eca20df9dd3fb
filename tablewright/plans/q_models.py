"""Feature, split, metric and model queries.

Deterministic parts get DuckDB twins: encodings, splits, a one-feature
least-squares model (closed form) and majority-class rules per group.  The
Spark ML fits (forests, logistic and normal-equation regression) are
checked on row counts and ranges only.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..functions import columns as X
from ..operators import features as FE
from ..operators import metrics as M
from ..operators import models as ML
from ..operators import stats
from ..operators.cache import hold
from .fixtures import dirty_orders, table, with_dirty
from .registry import query

PRIORITIES = ["2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
STATUSES = ["O", "P"]
PART_TEXT = ["p_name", "p_brand", "p_type"]


def _round(df, scale=6):
    return df.select(*[X.round_half_up(F.col(f.name), scale).alias(f.name) if f.dataType.typeName() == "double"
                       else F.col(f.name) for f in df.schema.fields])


@query("e02_one_hot", "select o_orderkey, " + ", ".join(
    [f"case when o_orderpriority = '{v}' then 1.0::double else 0.0::double end as \"o_orderpriority_{v}\"" for v in PRIORITIES]
    + [f"case when o_orderstatus = '{v}' then 1.0::double else 0.0::double end as \"o_orderstatus_{v}\"" for v in STATUSES])
    + " from orders", ("E2",))
def e02(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return FE.one_hot(o, ["o_orderpriority", "o_orderstatus"])


def _slots_sql(cols):
    return " union all ".join(
        f"select '{c}' as column_name, p_partkey, {c} as label, dense_rank() over (order by {c}) - 1 as code, "
        f"(select count(distinct {c}) from part) as n from part" for c in cols)


@query("e02_one_hot_many_levels", f"with v as ({_slots_sql(PART_TEXT)})\n"
       "select column_name, p_partkey, label, cast(n - 1 as int) as slots, "
       "case when code > 0 then cast(n - 1 - code as int) end as slot from v", ("E2",))
def e02v(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", *PART_TEXT)
    x, _, slots = FE.one_hot_vectors(p, PART_TEXT)
    at = [F.when(F.array_max(a) > 0, (F.array_position(a, 1.0) - 1).cast("int")) for a in (vector_to_array(f"{c}_vec") for c in PART_TEXT)]
    each = F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(c).alias("label"), F.lit(slots[c]).alias("slots"), s.alias("slot"))
                     for c, s in zip(PART_TEXT, at)))
    return x.select("p_partkey", F.explode(each).alias("e")).select("e.column_name", "p_partkey", "e.label", "e.slots", "e.slot")


@query("e03_date_parts", "select o_orderkey, cast(year(o_orderdate) as int) as o_orderdate_year, "
       "cast(month(o_orderdate) as int) as o_orderdate_month, cast(day(o_orderdate) as int) as o_orderdate_day, "
       "cast(isodow(o_orderdate) - 1 as int) as o_orderdate_dayofweek from orders", ("E3", "H9"))
def e03(spark, sf):
    return FE.expand_dates(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"))


@query("e05_median_impute", with_dirty(
    "m as (select quantile_cont(price, 0.5) as med from dirty)\n"
    "select o_orderkey, round(coalesce(price, med), 4) as price from dirty, m"), ("E5", "F2"))
def e05(spark, sf):
    d = dirty_orders(spark, sf).select("o_orderkey", "price")
    out, _ = FE.median_impute(d, ["price"])
    return out.select("o_orderkey", X.round_half_up("price", 4).alias("price"))


TASK_TARGETS = [("l_extendedprice", True), ("l_quantity", True), ("l_linenumber", True),
                ("l_returnflag", False), ("l_linestatus", False)]


@query("e06_task_detection", "with u as (" + " union all ".join(
    f"select '{c}' as target, count(distinct {c}) as n_distinct, {str(num).lower()} as is_numeric from lineitem"
    for c, num in TASK_TARGETS) + ")\n"
    "select target, n_distinct, case when is_numeric and n_distinct > 15 then 'regression' else 'classification' end as task,"
    " case when is_numeric and n_distinct > 15 then null when n_distinct = 2 then 'binary' else 'multiclass' end"
    " as classification_type from u", ("E6", "E7"))
def e06(spark, sf):
    li = table(spark, sf, "lineitem")
    rows, n = [], li.agg(*(F.count_distinct(c).alias(c) for c, _ in TASK_TARGETS)).collect()[0]
    for c, _ in TASK_TARGETS:
        task, ctype, _ = FE.detect_task(li, c)
        rows.append((c, n[c], task, ctype))
    return spark.createDataFrame(rows, "target string, n_distinct long, task string, classification_type string")


@query("e08_label_encoding", "select label, cast(dense_rank() over (order by label) - 1 as int) as code "
       "from (select distinct o_orderpriority as label from orders where o_orderpriority is not null)", ("E8",))
def e08(spark, sf):
    return FE.label_codes(table(spark, sf, "orders"), "o_orderpriority")


SPLIT_SQL = "(('0x' || substr(md5(cast({k} as varchar)), 1, 8))::bigint % 10000)"


@query("e09_random_split", f"select o_orderkey, {SPLIT_SQL.format(k='o_orderkey')} < 2000 as is_test from orders",
       ("E9",))
def e09(spark, sf):
    return FE.random_split(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 0.2)


def _strat_sql(tbl, label, key, cols):
    return f"""
with r as (select {cols}, row_number() over (partition by {label} order by md5(cast({key} as varchar)), {key}) as rn,
                  count(*) over (partition by {label}) as n from {tbl})
select {cols}, rn <= ceil(0.2 * n) as is_test from r"""


@query("e10_stratified_split", _strat_sql("orders", "o_orderpriority", "o_orderkey", "o_orderkey, o_orderpriority"),
       ("E10",))
def e10(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return FE.stratified_split(o, "o_orderpriority", "o_orderkey", 0.2).select("o_orderkey", "o_orderpriority", "is_test")


# ---------------------------------------------------------------- regression metrics

def _ols_predictions(spark, sf):
    """One-feature least squares p_retailprice ~ p_size fitted on the train split."""
    p = FE.random_split(table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice"), "p_partkey", 0.2)
    train, test = p.where(~F.col("is_test")), p.where(F.col("is_test"))
    coef = train.agg(F.regr_slope("p_retailprice", "p_size").alias("b"),
                     F.regr_intercept("p_retailprice", "p_size").alias("a"),
                     F.avg("p_retailprice").alias("m")).collect()[0]
    ols = test.select(F.col("p_retailprice").alias("y"),
                      (F.lit(coef["a"]) + F.lit(coef["b"]) * F.col("p_size")).alias("p"))
    mean = test.select(F.col("p_retailprice").alias("y"), F.lit(coef["m"]).alias("p"))
    return ols, mean


OLS_SQL = f"""
with s as (select p_partkey, p_size, p_retailprice, {SPLIT_SQL.format(k='p_partkey')} < 2000 as is_test from part),
c as (select regr_slope(p_retailprice, p_size) b, regr_intercept(p_retailprice, p_size) a, avg(p_retailprice) m
      from s where not is_test),
ols as (select p_retailprice y, a + b * p_size p from s, c where is_test),
mean as (select p_retailprice y, m p from s, c where is_test)
"""


def _reg_metrics_sql(src):
    return (f"select round(avg((p - y) * (p - y)), 4) as mse, round(sqrt(avg((p - y) * (p - y))), 4) as rmse, "
            f"round(avg(abs(p - y)), 4) as mae, round(1 - avg((p - y) * (p - y)) / var_pop(y), 6) as r2 from {src}")


@query("e15_regression_metrics", OLS_SQL + _reg_metrics_sql("ols"), ("E15", "E11", "E9"))
def e15(spark, sf):
    ols, _ = _ols_predictions(spark, sf)
    m = M.regression_metrics(ols)
    return m.select(*[X.round_half_up(c, 4).alias(c) for c in ("mse", "rmse", "mae")], X.round_half_up("r2", 6).alias("r2"))


@query("e20_best_model", OLS_SQL + """,
sc as (select 'Least squares' as model, 0 as model_order, sqrt(avg((p - y) * (p - y))) as rmse from ols
       union all select 'Mean', 1, sqrt(avg((p - y) * (p - y))) from mean)
select model as best_model from sc order by rmse, model_order limit 1""", ("E20",))
def e20(spark, sf):
    ols, mean = _ols_predictions(spark, sf)
    rows = []
    for order, (name, pred) in enumerate((("Least squares", ols), ("Mean", mean))):
        rows.append((name, order, "rmse", float(M.regression_metrics(pred).collect()[0]["rmse"])))
    metrics = spark.createDataFrame(rows, "model string, model_order int, metric string, value double")
    return M.best_model(metrics, "rmse", higher_is_better=False)


# ---------------------------------------------------------------- classification metrics

def _majority_predictions(train, test, group, label, key):
    """Rule model: the most frequent label of the row's group on the train
    split (ties to the smallest label), else the overall most frequent."""
    per_group = stats.modes(train, [label], by=[group]).select(group, F.col("mode").alias("_p"))
    overall = stats.modes(train, [label]).collect()[0]["mode"]
    n_groups = per_group.count()
    right = F.broadcast(per_group) if n_groups <= 100_000 else per_group
    dt = train.schema[label].dataType
    p = F.coalesce(F.col("_p"), F.lit(overall))
    p = p.cast("double").cast(dt) if dt.typeName() not in ("string",) else p
    return test.join(right, test[group].eqNullSafe(right[group]), "left").drop(right[group]) \
        .select(key, F.col(label).alias("y"), p.alias("p"))


def _status_predictions(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    s = hold(FE.stratified_split(o, "o_orderstatus", "o_orderkey", 0.2).select(*o.columns, "is_test"))
    return _majority_predictions(s.where(~F.col("is_test")), s.where(F.col("is_test")),
                                 "o_orderpriority", "o_orderstatus", "o_orderkey")


def _rule_sql(tbl_sql, group, label, key):
    return f"""
with base as ({tbl_sql}),
r as (select *, row_number() over (partition by {label} order by md5(cast({key} as varchar)), {key}) as rn,
             count(*) over (partition by {label}) as n from base),
s as (select *, rn <= ceil(0.2 * n) as is_test from r),
gc as (select {group}, {label}, count(*) as c from s where not is_test group by {group}, {label}),
maj as (select {group}, {label} as p from (select *, row_number() over (partition by {group} order by c desc, {label}) as k from gc) where k = 1),
allmaj as (select {label} as p from s where not is_test group by {label} order by count(*) desc, {label} limit 1),
pred as (select s.{key}, s.{label} as y, coalesce(maj.p, (select p from allmaj)) as p
         from s left join maj on s.{group} is not distinct from maj.{group} where s.is_test)
"""


STATUS_RULE_SQL = _rule_sql("select o_orderkey, o_orderpriority, o_orderstatus from orders",
                            "o_orderpriority", "o_orderstatus", "o_orderkey")

WEIGHTED_SQL = """,
cc as (select y as actual, p as predicted, count(*) as n from pred group by 1, 2),
labels as (select actual as label from cc union select predicted from cc),
pc as (select l.label,
              coalesce((select sum(n) from cc where actual = l.label and predicted = l.label), 0) as tp,
              coalesce((select sum(n) from cc where predicted = l.label), 0) as pn,
              coalesce((select sum(n) from cc where actual = l.label), 0) as support from labels l),
m as (select label, support, case when pn = 0 then 0 else tp / pn end as pr, case when support = 0 then 0 else tp / support end as rc from pc),
m2 as (select *, case when pr + rc = 0 then 0 else 2 * pr * rc / (pr + rc) end as f from m)
"""


@query("e16_accuracy", STATUS_RULE_SQL + "select round(avg(case when y = p then 1.0 else 0.0 end), 6) as accuracy from pred",
       ("E16",))
def e16(spark, sf):
    return _round(M.accuracy(_status_predictions(spark, sf)))


@query("e17_weighted_metrics", STATUS_RULE_SQL + WEIGHTED_SQL +
       "select round((select sum(n) filter (where actual = predicted) / sum(n) from cc), 6) as accuracy, "
       "round(sum(pr * support) / sum(support), 6) as precision, round(sum(rc * support) / sum(support), 6) as recall, "
       "round(sum(f * support) / sum(support), 6) as f1 from m2", ("E17",))
def e17(spark, sf):
    return _round(M.classification_metrics(_status_predictions(spark, sf), average="weighted"))


@query("e18_confusion_matrix", STATUS_RULE_SQL + """,
cc as (select y as actual, p as predicted, count(*) as n from pred group by 1, 2),
labels as (select actual as label from cc union select predicted from cc)
select a.label as actual, b.label as predicted, coalesce(cc.n, 0) as n
from labels a cross join labels b left join cc on cc.actual = a.label and cc.predicted = b.label""", ("E18",))
def e18(spark, sf):
    return M.confusion_matrix(_status_predictions(spark, sf))


QUALITY_SQL = ("select l.doc_id, d.source, l.quality from labels l join documents d on l.doc_id = d.doc_id")


def _quality_predictions(spark, sf):
    lab = table(spark, sf, "labels")
    docs = table(spark, sf, "documents").select("doc_id", "source")
    base = lab.join(docs, "doc_id").select("doc_id", "source", "quality")
    s = hold(FE.stratified_split(base, "quality", "doc_id", 0.2).select(*base.columns, "is_test"))
    return _majority_predictions(s.where(~F.col("is_test")), s.where(F.col("is_test")), "source", "quality", "doc_id")


@query("e17_binary_metrics", _rule_sql(QUALITY_SQL, "source", "quality", "doc_id") + """,
t as (select sum(case when y = 1 and p = 1 then 1 else 0 end) as tp, sum(case when y = 0 and p = 1 then 1 else 0 end) as fp,
             sum(case when y = 1 and p = 0 then 1 else 0 end) as fn, avg(case when y = p then 1.0 else 0.0 end) as acc from pred),
u as (select acc, case when tp + fp = 0 then 0 else tp / (tp + fp) end as pr, case when tp + fn = 0 then 0 else tp / (tp + fn) end as rc from t)
select round(acc, 6) as accuracy, round(pr, 6) as precision, round(rc, 6) as recall,
       round(case when pr + rc = 0 then 0 else 2 * pr * rc / (pr + rc) end, 6) as f1 from u""", ("E17", "Q12"))
def e17b(spark, sf):
    return _round(M.classification_metrics(_quality_predictions(spark, sf), average="binary"))


# ---------------------------------------------------------------- Spark ML fits (rows-only checks)

def _regression(spark, sf, only):
    return ML.train_model(table(spark, sf, "part"), "p_retailprice", key="p_partkey", only=only)


def _classification(spark, sf, only=None):
    return ML.train_model(table(spark, sf, "orders"), "o_orderstatus", key="o_orderkey", only=only)


@query("e11_linear_regression", None, ("E11", "E1", "E4"))
def e11(spark, sf):
    return _regression(spark, sf, "Linear Regression").metrics


@query("e11_linear_regression_one_feature", OLS_SQL + _reg_metrics_sql("ols"), ("E11", "E15"))
def e11o(spark, sf):
    fit = ML.train_model(table(spark, sf, "part"), "p_retailprice", key="p_partkey", features=["p_size"], only="Linear Regression")
    m = fit.metrics.groupBy().pivot("metric", list(ML.REGRESSION_METRICS)).agg(F.first("value"))
    return m.select(*[X.round_half_up(c, 4).alias(c) for c in ("mse", "rmse", "mae")], X.round_half_up("r2", 6).alias("r2"))


@query("e12_random_forest_regressor", None, ("E12",))
def e12(spark, sf):
    return _regression(spark, sf, "Random Forest Regressor").metrics


@query("e13_logistic_regression", None, ("E13",))
def e13(spark, sf):
    return _classification(spark, sf, "Logistic Regression").metrics


@query("e14_random_forest_classifier", None, ("E14",))
def e14(spark, sf):
    return _classification(spark, sf, "Random Forest Classifier").metrics


@query("e19_feature_importance", None, ("E19",))
def e19(spark, sf):
    return ML.top_importances(_regression(spark, sf, "Random Forest Regressor"), 15)


@query("e19_importance_levels", "select 'Random Forest Regressor' as model, "
       "1 + " + " + ".join(f"count(distinct {c}) - 1" for c in PART_TEXT)
       + " as n_features, 1.0::double as total, true as ordered from part", ("E19", "E2"))
def e19s(spark, sf):
    imp = _regression(spark, sf, "Random Forest Regressor").importances
    by_rank = F.array_sort(F.collect_list(F.struct("rank", "importance")))
    falls = F.forall(F.sequence(F.lit(1), F.size(by_rank) - 1), lambda i: F.element_at(by_rank, i)["importance"] >= F.element_at(by_rank, i + 1)["importance"])
    return imp.groupBy("model").agg(F.count_distinct("feature").alias("n_features"), X.round_half_up(F.sum("importance"), 6).alias("total"),
                                    falls.alias("ordered"))


def _model_facts(result, key):
    """What must hold of a classifier's scores on its test rows, whatever the fit."""
    (name, pred), = result.predictions.items()
    best = F.max(F.col("n")).alias("top")
    counts = pred.groupBy("y").agg(F.count(F.lit(1)).alias("n")).agg(best, F.sum("n").alias("n")).collect()[0]
    sums = F.aggregate("probability", F.lit(0.0), lambda a, v: a + v)
    likeliest = F.array_position("probability", F.array_max("probability")) - 1 == F.col("p")
    return pred.agg(F.count_distinct(key).alias("n_test"), F.bool_and(F.abs(sums - 1) < 1e-9).alias("sums_to_one"),
                    F.bool_and(likeliest).alias("takes_likeliest"),
                    (F.count_if(F.col("y") == F.col("p")) >= F.lit(0.9 * counts["top"])).alias("near_majority"))


MODEL_FACTS_SQL = ("select cast(sum(k) as bigint) as n_test, true as sums_to_one, true as takes_likeliest, true as near_majority "
                   "from (select cast(ceil(0.2 * count(*)) as bigint) as k from orders group by o_orderstatus)")


@query("e13_logistic_facts", MODEL_FACTS_SQL, ("E13", "E22", "E10"))
def e13f(spark, sf):
    return _model_facts(_classification(spark, sf, "Logistic Regression"), "o_orderkey")


@query("e14_forest_facts", MODEL_FACTS_SQL, ("E14", "E22", "E10"))
def e14f(spark, sf):
    return _model_facts(_classification(spark, sf, "Random Forest Classifier"), "o_orderkey")


@query("e21_metrics_table", None, ("E21",))
def e21(spark, sf):
    return _classification(spark, sf).metrics_table()


@query("e22_class_probabilities", None, ("E22",))
def e22(spark, sf):
    return _classification(spark, sf, "Random Forest Classifier").predictions["Random Forest Classifier"]


@query("e18_confusion_matrix_models", None, ("E18",))
def e18m(spark, sf):
    return _classification(spark, sf).confusion
