"""Classifier training and evaluation on Spark ML.

Fits are actions; everything around them (splits, metrics, importances) stays
lazy. A feature table is checkpointed once before it is fitted repeatedly.
"""

from __future__ import annotations

from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark.ml import Pipeline
from pyspark.ml.classification import (
    DecisionTreeClassifier, GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes,
)
from pyspark.ml.feature import Imputer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GeneralizedLinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayline.operators import evaluate, knn, ranks
from wayline.operators.forests import forests
from wayline.operators.permute import shuffled_partners
from wayline.operators.split import folds, split, with_class_weights
from wayline.session import materialize, materialize_spread

PARALLEL_FITS = 5


def impute_scale_logistic(features: list[str], n_rows: int, impute: str = "median", weighted: bool = True, max_iter: int = 2000,
                          family: str = "auto") -> Pipeline:
    """Impute, standardise, logistic regression with unit ridge strength (regParam = 1 / rows).

    ``impute="zero"`` expects NULLs filled before.
    """
    cols = [f"_f_{f}" for f in features]
    stages = []
    if impute == "median":
        stages.append(Imputer(strategy="median", inputCols=features, outputCols=cols))
    else:
        cols = features
    stages += [
        VectorAssembler(inputCols=cols, outputCol="_raw", handleInvalid="keep"),
        StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True),
        LogisticRegression(maxIter=max_iter, regParam=1.0 / max(n_rows, 1), standardization=False, family=family,
                           **({"weightCol": "weight"} if weighted else {})),
    ]
    return Pipeline(stages=stages)


def _score(pred: DataFrame) -> DataFrame:
    return pred.withColumn("score", vector_to_array("probability")[1])


def _labelled(df: DataFrame, target: str) -> DataFrame:
    return df.withColumn("label", F.col(target).cast("double"))


def static_validation(df: DataFrame, features: list[str], target: str, key: str, train_share: float = 0.7, k: int = 5,
                      seed: int = 42, impute: str = "median", weighted: bool = True) -> DataFrame:
    """Hold-out metrics and k-fold accuracy of the logistic pipeline; no rows when a class is missing."""
    d = materialize(_labelled(df, target).select(key, "label", *features))
    if d.select("label").distinct().count() < 2:
        return d.sparkSession.createDataFrame([], "tp long, fp long, fn long, tn long, accuracy double, precision double, recall double, f1 double, auc double, cv_mean double, cv_std double, n_train long, n_test long")
    d = materialize_spread(with_class_weights(split(d, key, "label", train_share, seed, exact=True), "label"))
    train, test = materialize(folds(d.where("is_train"), key, "label", k, seed + 1, exact=True)), d.where("NOT is_train")
    n = train.count()
    pred = materialize(_score(impute_scale_logistic(features, n, impute, weighted).fit(train).transform(test)).select(key, "label", "prediction", "score"))
    rep = evaluate.binary_report(evaluate.confusion(pred.withColumn("g", F.lit(1)), ["g"]), ["g"], F.col("label") == 1, F.col("prediction") == 1)
    auc = ranks.roc_auc(pred.withColumn("g", F.lit(1)), ["g"], "score", F.col("label") == 1).select("g", "auc")
    cv = fold_predictions(train, "fold", k, lambda t: impute_scale_logistic(features, t.count(), impute, weighted))
    acc = cv.groupBy("fold").agg(F.avg((F.col("label") == F.col("prediction")).cast("double")).alias("a")).agg(
        F.avg("a").alias("cv_mean"), F.stddev_pop("a").alias("cv_std")).withColumn("g", F.lit(1))
    sizes = d.agg(F.count_if("is_train").alias("n_train"), F.count_if(~F.col("is_train")).alias("n_test")).withColumn("g", F.lit(1))
    return rep.join(auc, "g").join(acc, "g").join(sizes, "g").drop("g")


def fold_predictions(d: DataFrame, fold: str, k: int, make) -> DataFrame:
    """Out-of-fold predictions of k fits, pooled; ``make(train)`` builds the estimator."""
    def fit(i):
        train = d.where(F.col(fold) != i)
        return make(train).fit(train)

    with ThreadPool(min(k, PARALLEL_FITS)) as pool:  # folds are independent, as in ml.tuning's parallelism
        fitted = pool.map(fit, range(k))
    parts = [
        _score(m.transform(d.where(F.col(fold) == i))).select("label", "prediction", "score", F.lit(i).alias(fold)) for i, m in enumerate(fitted)
    ]
    # several metrics read the predictions; score each row once
    return materialize(reduce(DataFrame.unionByName, parts))


def year_split(df: DataFrame, year: str, train_years: list[int], test_years: list[int]) -> tuple[DataFrame, DataFrame]:
    train, test = df.where(F.col(year).isin(train_years)), df.where(F.col(year).isin(test_years))
    if train.isEmpty() or test.isEmpty():
        raise ValueError("train or test years select no rows")
    return train, test


def binary_experiment(train: DataFrame, test: DataFrame, features: list[str], target: str) -> DataFrame:
    tr, te = materialize(_labelled(train, target)), _labelled(test, target)
    pred = impute_scale_logistic(features, tr.count(), weighted=False).fit(tr).transform(te)
    return evaluate.class_report(evaluate.confusion(pred.withColumn("g", F.lit(1)), ["g"]), ["g"]).drop("g")


def multiclass_experiment(train: DataFrame, test: DataFrame, features: list[str], source: str) -> DataFrame:
    tr = materialize(train)
    index = StringIndexer(inputCol=source, outputCol="label", stringOrderType="alphabetAsc").fit(tr)
    model = impute_scale_logistic(features, tr.count(), weighted=False, family="multinomial").fit(index.transform(tr))
    names = F.array(*[F.lit(x) for x in index.labels])
    pred = model.transform(index.transform(test)).select(F.col(source).alias("label"), names[F.col("prediction").cast("int")].alias("prediction"))
    return evaluate.class_report(evaluate.confusion(pred.withColumn("g", F.lit(1)), ["g"]), ["g"]).drop("g")


def panel(n_features: int, n_rows: int, seed: int = 42) -> dict:
    """The classifiers of the panel that Spark ML offers, besides the forest; unit ridge strength is 1 / rows."""
    return {
        "Logistic Regression": LogisticRegression(maxIter=1000, standardization=False, regParam=1.0 / max(n_rows, 1)),
        "Gradient Boosting": GBTClassifier(maxIter=100, maxDepth=3, stepSize=0.1, seed=seed),
        "Naive Bayes": NaiveBayes(modelType="gaussian"),
        "Decision Tree": DecisionTreeClassifier(maxDepth=10, seed=seed),
        "Neural Network": MultilayerPerceptronClassifier(layers=[n_features, 50, 2], maxIter=500, seed=seed),
    }


NEIGHBOURS, FOREST = "K-Nearest Neighbors", "Random Forest"
#: Trees of the panel's forest.
TREES = 100


def scaled(train: DataFrame, test: DataFrame, features: list[str]) -> tuple[DataFrame, DataFrame]:
    pipe = Pipeline(stages=[
        VectorAssembler(inputCols=features, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True)])
    m = pipe.fit(train)
    return m.transform(train).drop("_raw"), m.transform(test).drop("_raw")


def _neighbour_scores(train: DataFrame, test: DataFrame, k: int = 5) -> DataFrame:
    """label, prediction, score of the k-nearest vote; both sides have ``features``, and ``_id`` tells their rows apart."""
    vec = lambda d: d.withColumn("_vec", vector_to_array("features")).drop("features")
    near = knn.nearest(vec(train).select("_id", "_vec", "label"), vec(test).select("_id", "_vec"), "_id", "_vec", "label", k)
    score = near.groupBy("_id").agg(F.avg("_nlabel").alias("score"))
    return test.select("_id", "label").join(score, "_id").withColumn("prediction", (F.col("score") > 0.5).cast("double")).drop("_id")


def fit_panel(train: DataFrame, test: DataFrame, features: list[str], key: str, models: dict | None = None, neighbours: bool = True, importance: bool = False,
              repeats: int = 10, seed: int = 42) -> tuple[DataFrame, DataFrame | None]:
    """(model, label, prediction, score) of the test rows, and on request (model, feature, importance).

    Importances sum to one: those of trees as they are, absolute coefficients, and for models without either the mean loss of
    accuracy when a feature is permuted (negative ones stay; a sum of zero or less leaves them unscaled).
    """
    spark = train.sparkSession
    tr, te = scaled(train, test, features)
    tr, te = (materialize_spread(d.select(F.col(key).cast("string").alias("_id"), "label", "features")) for d in (tr, te))
    named = list((panel(len(features), tr.count()) if models is None else models).items())
    columns = ["model", "label", "prediction", "score"]

    def grow():
        both = tr.withColumn("fold", F.lit(1)).unionByName(te.withColumn("fold", F.lit(0)))
        rows = both.select(F.col("_id").alias("key"), "label", "fold", vector_to_array("features").alias("x"))
        return forests(rows, features, [0], TREES, seed, balanced=False)

    def met_rows():
        """Every test row with its partners of each repeat, and the neighbours of all its variants."""
        met = materialize(shuffled_partners(te.withColumn("_a", vector_to_array("features")), "_id", ["_a"], repeats, seed))
        if not neighbours:
            return met, None
        given = tr.withColumn("_a", vector_to_array("features")).select("_id", "_a", F.col("label").alias("_l"))
        return met, knn.nearest_of_variants(given, met.select("_id", "_a", F.col("_others.row._a").alias("_rows")), "_id", "_a", "_rows", "_l")

    # Fits that run many small jobs one after the other leave room for the forest and the neighbours, also those of permuted rows.
    with ThreadPool(PARALLEL_FITS + 3) as pool:
        met = pool.apply_async(met_rows) if importance else None
        grown = pool.apply_async(grow) if models is None else None
        voted = pool.apply_async(_neighbour_scores, (tr, te)) if neighbours else None
        fitted = pool.map(lambda x: x[1].fit(tr.select("label", "features")), named, 1)
        scored, grown = grown.get() if grown else (None, None)
        voted = voted.get() if voted else None
        met, near = met.get() if met else (None, None)
    parts = [_score(m.transform(te)).select(F.lit(n).alias("model"), "label", "prediction", "score") for (n, _), m in zip(named, fitted)]
    if scored is not None:
        parts.append(scored.select(F.lit(FOREST).alias("model"), "label", "prediction", "score"))
    if voted is not None:
        parts.append(voted.withColumn("model", F.lit(NEIGHBOURS)).select(*columns))
    scores = materialize(reduce(DataFrame.unionByName, parts))
    if not importance:
        return scores, None
    rows, permuted_for = [], []
    for (name, _), m in zip(named, fitted):
        if hasattr(m, "featureImportances"):
            v = m.featureImportances.toArray()
        elif hasattr(m, "coefficients"):
            v = abs(m.coefficients.toArray())
            v = v / v.sum() if v.sum() > 0 else v
        else:
            permuted_for.append((name, m))
            continue
        rows += [(name, f, float(x)) for f, x in zip(features, v)]
    # Each permuted feature of each repeat is one variant of the test rows; all models score the same variants.
    other = met.withColumn("_o", F.explode("_others")).withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(len(features) - 1))))
    mixed = F.transform("_a", lambda x, i: F.when(i == F.col("_j"), F.col("_o.row._a")[i]).otherwise(x))
    variants = materialize(other.select(F.concat_ws("#", "_id", "_o.repeat", "_j").alias("_id"), "label", F.col("_j"), F.col("_o.repeat").alias("_rep"), array_to_vector(mixed).alias("features")))
    each = [m.transform(variants).select(F.lit(n).alias("model"), "_j", "_rep", "label", "prediction") for n, m in permuted_for]
    if neighbours:
        share = F.aggregate("_near", F.lit(0.0), lambda a, x: a + x["_nlabel"]) / F.size("_near")
        voted = near.withColumn("prediction", (share > 0.5).cast("double")).join(te.select("_id", "label"), "_id")
        each.append(voted.select(F.lit(NEIGHBOURS).alias("model"), "_j", "_rep", "label", "prediction"))
    hit = F.avg((F.col("label") == F.col("prediction")).cast("double"))
    base = scores.groupBy("model").agg(hit.alias("_base"))
    drops = reduce(DataFrame.unionByName, each).groupBy("model", "_j", "_rep").agg(hit.alias("_acc")).groupBy("model", "_j").agg(F.avg("_acc").alias("_acc"))
    drops = drops.join(F.broadcast(base), "model").select("model", "_j", (F.col("_base") - F.col("_acc")).alias("v"))
    total = F.sum("v").over(Window.partitionBy("model"))
    names = F.array(*map(F.lit, features))
    lost = drops.select("model", names[F.col("_j")].alias("feature"), F.when(total > 0, F.col("v") / total).otherwise(F.col("v")).alias("importance"))
    known = spark.createDataFrame(rows, "model string, feature string, importance double")
    if grown is not None:
        known = known.unionByName(grown.select(F.lit(FOREST).alias("model"), "feature", "importance"))
    return scores, known.unionByName(lost)


def panel_report(scores: DataFrame, groups: list[str]) -> DataFrame:
    """Counts, accuracy, precision, recall, F1 and AUC of every group of scored rows."""
    rep = evaluate.binary_report(evaluate.confusion(scores, groups), groups, F.col("label") == 1, F.col("prediction") == 1)
    return rep.join(ranks.roc_auc(scores, groups, "score", F.col("label") == 1).select(*groups, "auc"), groups)


def evaluate_panel(train: DataFrame, test: DataFrame, features: list[str], key: str, models: dict | None = None) -> DataFrame:
    """Accuracy, precision, recall, F1 and AUC of every model on one shared split."""
    return panel_report(fit_panel(train, test, features, key, models)[0], ["model"])


def author_experiment(df: DataFrame, sets: dict[str, list[str]], key: str, importance: bool = True) -> dict[str, dict[str, DataFrame]]:
    """The panel on every statistic's features over one shared split (``label``, ``is_train``). For each statistic ``scores``: (statistic,
    model, label, prediction, score) of the test rows, and on request ``importances``: (statistic, model, feature, importance)."""
    train, test = df.where("is_train"), df.where("NOT is_train")
    with ThreadPool(PARALLEL_FITS) as pool:  # statistics are independent
        made = pool.map(lambda x: fit_panel(train, test, x[1], key, importance=importance), sets.items(), 1)
    tables = lambda name, pair: {t: df.select(F.lit(name).alias("statistic"), "*") for t, df in zip(("scores", "importances"), pair) if df is not None}
    return {name: tables(name, pair) for name, pair in zip(sets, made)}


def forest_folds(df: DataFrame, features: list[str], target: str, key: str, trees: int = 300, k: int = 5, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Out-of-fold predictions of a balanced random forest, and every fold's importances; NULL features become 0."""
    d = folds(_labelled(df.fillna(0.0, subset=features), target), key, "label", k, seed, exact=True)
    rows = d.select(F.col(key).cast("string").alias("key"), "label", "fold", F.array(*[F.col(f).cast("double") for f in features]).alias("x"))
    scores, weights = forests(materialize(rows), features, list(range(k)), trees, seed)
    return materialize(scores.select("label", "prediction", "score", "fold")), weights


def forest_sets(df: DataFrame, sets: dict[str, list[str]], target: str, key: str, trees: int = 300, k: int = 5, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Out-of-fold predictions of a forest on every feature set, and the importances of every fold's forest."""
    d = materialize(df)

    with ThreadPool(PARALLEL_FITS) as pool:  # feature sets are independent
        made = pool.map(lambda item: forest_folds(d, item[1], target, key, trees, k, seed), sets.items())
    tag = lambda d, name: d.select(F.lit(name).alias("feature_set"), F.lit(len(sets[name])).alias("n_features"), "*")
    return tuple(reduce(DataFrame.unionByName, [tag(m[i], name) for name, m in zip(sets, made)]) for i in (0, 1))


def feature_set_report(predictions: DataFrame) -> DataFrame:
    """Mean and sd over folds of accuracy, AUC and F1 per feature set."""
    g = ["feature_set", "n_features", "fold"]
    rep = evaluate.binary_report(evaluate.confusion(predictions, g), g, F.col("label") == 1, F.col("prediction") == 1)
    per_fold = rep.join(ranks.roc_auc(predictions, g, "score", F.col("label") == 1).select(*g, "auc"), g)
    return per_fold.groupBy("feature_set", "n_features").agg(
        *[x for m in ("accuracy", "auc", "f1") for x in (F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"))])


def evaluate_feature_sets(df: DataFrame, sets: dict[str, list[str]], target: str, key: str, trees: int = 300, k: int = 5, seed: int = 42) -> DataFrame:
    """Mean and sd over folds of accuracy, AUC and F1 per feature set."""
    return feature_set_report(forest_sets(df, sets, target, key, trees, k, seed)[0])


def wald_table(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """Coefficient, standard error, z, p and odds ratio of a logistic model on standardised features."""
    spark = df.sparkSession
    d = _labelled(df, target)
    x, _ = scaled(d, d, features)
    m = GeneralizedLinearRegression(family="binomial", link="logit", maxIter=50).fit(x)
    s = m.summary
    coef = [float(c) for c in m.coefficients] + [float(m.intercept)]
    rows = list(zip([*features, "intercept"], coef, map(float, s.coefficientStandardErrors), map(float, s.tValues), map(float, s.pValues)))
    t = spark.createDataFrame(rows, "feature string, coef double, std_err double, z double, p_value double")
    return t.withColumn("odds_ratio", F.exp("coef"))


def wald_folds(df: DataFrame, features: list[str], target: str, key: str, k: int = 5, seed: int = 42) -> DataFrame:
    """Wald tables over training folds, summarised per feature."""
    d = materialize(folds(_labelled(df, target), key, "label", k, seed, exact=True))
    out = None
    for i in range(k):
        t = wald_table(d.where(F.col("fold") != i), features, target).withColumn("fold", F.lit(i))
        out = t if out is None else out.unionByName(t)
    return out.groupBy("feature").agg(
        F.avg("coef").alias("coef_mean"), F.stddev_samp("coef").alias("coef_std"), F.avg("p_value").alias("p_mean"), F.stddev_samp("p_value").alias("p_std"),
        F.min("p_value").alias("p_min"), F.max("p_value").alias("p_max"), F.min_by("odds_ratio", "fold").alias("first_odds_ratio"))


def permuted(df: DataFrame, key: str, features: list[str], repeats: int, seed: int) -> DataFrame:
    """Every row once for each repeat, with ``_other``: the features of the row that a random permutation puts in its place."""
    met = shuffled_partners(df, key, features, repeats, seed)
    return met.withColumn("_o", F.explode("_others")).select("*", F.col("_o.repeat").alias("repeat"), F.col("_o.row").alias("_other")).drop("_o", "_others")


def permutation_importance(model, test: DataFrame, features: list[str], key: str, repeats: int = 10, seed: int = 42) -> DataFrame:
    """Mean drop in accuracy when a feature is shuffled, divided by the signed sum of all where that is positive.

    ``model`` transforms raw feature columns into ``prediction``; the shuffled rows of all features and repeats are scored
    in one pass.
    """
    test = materialize(test)
    acc = F.avg((F.col("label") == F.col("prediction")).cast("double"))
    base = model.transform(test).agg(acc.alias("base"))
    variants = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), *[F.col(f"_other.{c}" if c == f else c).alias(c) for c in features]) for f in features]))
    rows = permuted(test.select(key, "label", *features), key, features, repeats, seed).select("repeat", "label", variants.alias("_v")).select("repeat", "label", "_v.*")
    out = model.transform(rows).groupBy("feature", "repeat").agg(acc.alias("acc"))
    drops = out.join(F.broadcast(base)).groupBy("feature").agg(F.avg(F.col("base") - F.col("acc")).alias("importance"), F.stddev_pop("acc").alias("std"))
    total = F.sum("importance").over(Window.partitionBy(F.lit(0)))
    return drops.withColumn("normalised", F.when(total > 0, F.col("importance") / total).otherwise(F.col("importance")))


