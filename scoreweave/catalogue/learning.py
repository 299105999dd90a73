"""Learners on the registered datasets, with full numbers of trees and rounds and trees QUERY_DEPTH deep."""

from __future__ import annotations

from pyspark.sql import functions as F

from scoreweave.catalogue import register
from scoreweave.catalogue.common import cells_sql, r, raw_sql, rounded, shared_prepared, shared_split, SPLIT_SQL
from scoreweave.learners.base import class_weight
from scoreweave.learners.custom import Unfittable
from scoreweave.learners.roster import roster
from scoreweave.operators import knn
from scoreweave.operators.profile import class_moments
from scoreweave.plans.scores import fit_and_predict, performance
from scoreweave.sources.registry import ALL, REGRESSION

#: `roster` itself grows trees as deep as MLlib can; 100 trees of that depth take minutes a dataset here.
QUERY_DEPTH = 10

_NEAREST = """pairs AS (SELECT q.row_id AS qid, t.row_id AS rid, t.label, list_distance(q.features, t.features) AS d
    FROM held q, train t),
  near AS (SELECT qid, unnest(min({'d': d, 'rid': rid, 'label': label}, 5)) AS z FROM pairs GROUP BY qid)"""


def _split_ctes(name):
    return f"""{raw_sql(name)}, {SPLIT_SQL},
  train AS (SELECT row_id, label, features FROM raw JOIN parted USING (dataset_name, row_id) WHERE split = 'train'),
  held AS (SELECT row_id, label, features FROM raw JOIN parted USING (dataset_name, row_id) WHERE split <> 'train')"""


def _neighbours(spark, folder, name):
    rows = shared_split(spark, folder, name)
    return knn.knn_join(rows.filter("split <> 'train'"), rows.filter("split = 'train'"), 5)


@register(f"""
    WITH {_split_ctes('emb_class')}, {_NEAREST},
    votes AS (SELECT qid, z.label AS label, count(*) AS n, max(z.d) AS far FROM near GROUP BY qid, z.label),
    best AS (SELECT qid, label, n, row_number() OVER (PARTITION BY qid ORDER BY n DESC, label) AS k,
      max(far) OVER (PARTITION BY qid) AS reach FROM votes)
    SELECT qid, label AS prediction, {r('n / 5.0::DOUBLE', 6)} AS share, {r('reach', 6)} AS reach FROM best WHERE k = 1""")
def knn_exact_classify(spark, folder):
    found = _neighbours(spark, folder, "emb_class")
    reach = found.groupBy("qid").agg(F.max("distance").alias("reach"))
    out = knn.vote(found, 10).select("qid", "prediction", F.array_max("probability").alias("share"))
    return rounded(out.join(reach, "qid"), 6, "share", "reach")


@register(f"""
    WITH {_split_ctes('emb_class')}, {_NEAREST},
    votes AS (SELECT qid, z.label AS label, count(*) AS n FROM near GROUP BY qid, z.label)
    SELECT qid AS row_id, label AS prediction, {r('n / 5.0::DOUBLE', 6)} AS share FROM votes
    QUALIFY row_number() OVER (PARTITION BY qid ORDER BY n DESC, label) = 1""")
def fit_knn_predictions(spark, folder):
    """The roster's nearest-neighbour learner, row by row."""
    rows = shared_split(spark, folder, "emb_class").select("split", "row_id", "features", "label")
    model = roster("multiclass")["K-Nearest Neighbors"].fit(rows.filter("split = 'train'"))
    out = model.predict(rows.filter("split <> 'train'"))
    return rounded(out.select("row_id", "prediction", F.array_max("probability").alias("share")), 6, "share")


@register(f"""
    WITH {_split_ctes('order_total')}, {_NEAREST}
    SELECT qid, {r('avg(z.label)', 4)} AS prediction FROM near GROUP BY qid""")
def knn_exact_regress(spark, folder):
    """On whole-number features: distances tie often and must be broken alike."""
    return rounded(knn.average(_neighbours(spark, folder, "order_total")), 4)


@register(f"""
    WITH {cells_sql('line_status', 'return_flag', 'doc_quality', 'order_status', 'emb_class')}
    SELECT dataset_name, label, feature, count(*) AS n, {r('avg(value)', 6)} AS mean, {r('var_pop(value)', 6)} AS variance
    FROM cells WHERE split = 'train' GROUP BY dataset_name, label, feature""")
def gaussian_nb(spark, folder):
    names = [s.name for s in ALL if s.task != REGRESSION]
    train = shared_prepared(spark, folder, *names, ids=False).filter("split = 'train'")
    return rounded(class_moments(train, ["dataset_name"]), 6, "mean", "variance")


def _fit(dataset, task, *names):
    def query(spark, folder):
        learners = roster(task, depth=QUERY_DEPTH)
        table = shared_prepared(spark, folder, dataset)
        fitted = fit_and_predict(table, dataset, {n: learners[n] for n in names})
        if fitted.failures:
            raise RuntimeError(str(fitted.failures))
        return rounded(performance(fitted, task), 6)

    return query


def _register_fit(key, dataset, task, *names):
    query = _fit(dataset, task, *names)
    query.__name__ = key
    register()(query)


_register_fit("fit_logreg", "line_status", "binary", "Logistic Regression")
_register_fit("fit_logreg_multiclass", "order_status", "multiclass", "Logistic Regression")
_register_fit("fit_rf", "order_status", "multiclass", "Random Forest")
_register_fit("fit_rf_regress", "line_price", "regression", "Random Forest Regressor")
_register_fit("fit_tree", "line_status", "binary", "Decision Tree")
_register_fit("fit_tree_regress", "order_total", "regression", "Decision Tree Regressor")
_register_fit("fit_knn", "order_status", "multiclass", "K-Nearest Neighbors")
_register_fit("fit_knn_regress", "event_value", "regression", "K-Nearest Neighbors Regressor")
_register_fit("fit_bagging", "return_flag", "multiclass", "Bagging Classifier")
_register_fit("fit_bagging_regress", "order_total", "regression", "Bagging Regressor")
_register_fit("fit_gbt", "doc_quality", "binary", "XGBoost")
_register_fit("fit_gbt_regress", "event_value", "regression", "XGBoost Regressor")
_register_fit("fit_linreg", "line_price", "regression", "Linear Regression")
_register_fit("fit_vote", "doc_quality", "binary", "Voting Classifier")
_register_fit("fit_vote_regress", "order_total", "regression", "Voting Regressor")
_register_fit("fit_stack", "doc_quality", "binary", "Stacking Classifier")
_register_fit("fit_stack_regress", "event_value", "regression", "Stacking Regressor")
_register_fit("fit_adaboost", "order_status", "multiclass", "AdaBoost Classifier")
_register_fit("fit_adaboost_regress", "order_total", "regression", "AdaBoost Regressor")
_register_fit("fit_svr", "event_value", "regression", "SVR")


@register(f"""
    WITH {cells_sql('doc_quality')},
    fit AS (SELECT label, feature, avg(value) AS m, var_pop(value) AS v FROM cells WHERE split = 'train' GROUP BY ALL),
    lift AS (SELECT 1e-9::DOUBLE * max(v) AS e FROM (SELECT var_pop(value) AS v FROM cells WHERE split = 'train' GROUP BY feature)),
    prior AS (SELECT label, ln(count(*) / sum(count(*)) OVER ()) AS p FROM (SELECT DISTINCT row_id, label FROM cells WHERE split = 'train') GROUP BY label),
    logs AS (SELECT c.dataset_name, c.split, c.row_id, c.label, f.label AS k,
        any_value(p) - 0.5::DOUBLE * sum(ln(2 * pi() * (v + e)) + pow(value - m, 2) / (v + e)) AS s
      FROM cells c JOIN fit f USING (feature) JOIN lift ON true JOIN prior q ON q.label = f.label WHERE split <> 'train' GROUP BY ALL),
    predictions AS (SELECT dataset_name, split, 'Naive Bayes' AS model_name, label, CAST(arg_max(k, s) AS INTEGER) AS prediction,
        1 / (1 + exp(max(CASE WHEN k = 0 THEN s END) - max(CASE WHEN k = 1 THEN s END))) AS score FROM logs GROUP BY dataset_name, split, row_id, label),
    counted AS (SELECT dataset_name, split, model_name, avg(CASE WHEN label = prediction THEN 1.0::DOUBLE ELSE 0 END) AS accuracy,
      coalesce(2 * sum(CASE WHEN label = 1 AND prediction = 1 THEN 1 ELSE 0 END) / nullif(sum(label) + sum(prediction), 0)::DOUBLE, 0) AS f1_score
      FROM predictions GROUP BY ALL),
    tally AS (SELECT dataset_name, split, model_name, score, sum(label) AS p, sum(1 - label) AS q FROM predictions GROUP BY ALL),
    run AS (SELECT *, coalesce(sum(q) OVER (PARTITION BY split ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM tally),
    area AS (SELECT dataset_name, split, model_name, sum(p * (below + q / 2)) / nullif(sum(p) * sum(q), 0) AS auc_roc FROM run GROUP BY ALL)
    SELECT dataset_name, split, model_name, {r('accuracy', 6)} AS accuracy, {r('f1_score', 6)} AS f1_score, {r('auc_roc', 4)} AS auc_roc
    FROM counted JOIN area USING (dataset_name, split, model_name)""")
def fit_naive_bayes(spark, folder):
    scored = _fit("doc_quality", "binary", "Naive Bayes")(spark, folder)
    return rounded(scored, 6, "accuracy", "f1_score", auc_roc=4)


def _train_rows(spark, folder, dataset):
    return shared_prepared(spark, folder, dataset).filter("split = 'train'").select("row_id", "features", "label")


def _moments_with(rows, error):
    """Mean of error, and of error times each feature."""
    cells = rows.withColumn("_e", error).select("_e", F.posexplode(F.concat(F.array(F.lit(1.0)), "features")).alias("at", "x"))
    return cells.groupBy("at").agg(F.avg(F.col("_e") * F.col("x")).alias("slope"))


@register(f"""
    WITH {cells_sql('line_price')} SELECT CAST(0 AS INTEGER) AS at, 0.0::DOUBLE AS slope
    UNION ALL SELECT DISTINCT feature + 1, 0.0::DOUBLE FROM cells""")
def fit_linreg_normal_equations(spark, folder):
    """What is left of the label after the fit goes with no feature, and its mean is 0."""
    train = _train_rows(spark, folder, "line_price")
    fitted = roster("regression")["Linear Regression"].fit(train).predict(train)
    spread = train.agg(F.stddev_pop("label")).first()[0]
    return rounded(_moments_with(fitted, (F.col("label") - F.col("prediction")) / F.lit(spread)), 6)


@register(f"""
    WITH {cells_sql('line_status')} SELECT CAST(0 AS INTEGER) AS at, 0.0::DOUBLE AS slope
    UNION ALL SELECT DISTINCT feature + 1, 0.0::DOUBLE FROM cells""")
def fit_logreg_gradient(spark, folder):
    """The slope of the weighted, penalised likelihood is 0 in every coefficient."""
    train = _train_rows(spark, folder, "line_status")
    model = roster("binary")["Logistic Regression"].fit(train)
    weight = class_weight(train, "balanced")
    fitted = model.predict(train).withColumn("_w", weight)
    slopes = _moments_with(fitted, F.col("_w") * (F.get("probability", F.lit(1)) - F.col("label")))
    total, n = train.agg(F.sum(weight), F.count("*")).first()
    inner = model.model
    # The penalty 1 / (C n) of a mean loss, C = 1; the intercept has none.
    penalty = [0.0, *[float(c) * inner.getRegParam() for c in inner.coefficients]]
    pull = F.element_at(F.array(*[F.lit(p) for p in penalty]), F.col("at") + 1)
    return rounded(slopes.withColumn("slope", F.col("slope") * n / total + pull), 4)


@register("""
    SELECT 'doc_quality' AS dataset_name, 'Decision Tree' AS model_name, 'ok' AS status, '' AS reason, CAST(2 AS BIGINT) AS n_scores
    UNION ALL SELECT 'doc_quality', 'Broken', 'failed', 'ValueError: not trainable', NULL""")
def learner_failure(spark, folder):
    """A learner that cannot be trained is reported and skipped; its neighbour still scores."""
    learners = {"Decision Tree": roster("binary", depth=4)["Decision Tree"], "Broken": Unfittable()}
    fitted = fit_and_predict(shared_prepared(spark, folder, "doc_quality"), "doc_quality", learners)
    scored = performance(fitted, "binary").groupBy("dataset_name", "model_name").agg(F.count("*").alias("n_scores"))
    return fitted.status(spark).join(scored, ["dataset_name", "model_name"], "left")
