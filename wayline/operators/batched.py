"""Logistic regressions of many slices and folds in one job.

Every row names its slice and its fold (-1: held out). A slice has ``k + 1`` fits: one on all its training rows, and one for
each fold on the others. All fits move together by iteratively reweighted least squares: a round is one pass over the rows, in
which each task adds up the gradients and second derivatives of every fit it meets; Spark sums them by fit, and the steps are
solved where the sums lie. Only coefficients reach the driver. A fit leaves when its gradient is nearly zero; a step that makes
the loss worse is halved. Features are imputed and standardised by the moments of each fit's own training rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.operators import evaluate, ranks
from wayline.operators.ordered import quantiles
from wayline.operators.split import folds, split
from wayline.session import materialize

#: Largest component of a settled fit's gradient, per unit of weight.
SETTLED = 1e-10
ROUNDS = 60
#: Numbers of sums that a task holds before it hands them on.
HELD = 4_000_000


@dataclass
class Fit:
    """One regression: scales of its features and its coefficients (the intercept last), all for standardised features."""

    fill: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    total: float
    n: int
    beta: np.ndarray
    open: bool = True
    last: np.ndarray | None = None
    step: np.ndarray | None = None
    loss: float = math.inf
    gradient: float = math.inf
    errors: np.ndarray = field(default_factory=lambda: np.zeros(0))
    rounds: int = 0

    def design(self, x: np.ndarray) -> np.ndarray:
        z = (np.where(np.isnan(x), self.fill, x) - self.mean) / self.scale
        return np.concatenate([z, np.ones((len(z), 1))], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.design(x) @ self.beta, -700, 700)))


def _batch(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """slice, fold, label and features of a batch; NULL features are NaN."""
    x = np.asarray(batch.column(3).flatten().to_numpy(zero_copy_only=False), float)
    n = batch.num_rows
    return *(np.asarray(batch.column(i)) for i in range(3)), x.reshape(n, -1) if n else x.reshape(0, 0)


def _sums(sent, ridge: float, k: int):
    """slice, fold, label, x -> fit, sums: second derivatives, gradient, loss of every open fit over the task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fits: dict[int, Fit] = sent.value
        held: dict[int, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.tolist() for v in held.values()], pa.list_(pa.float64()))], names=["fit", "sums"])
            held.clear()
            return made

        for batch in batches:
            s, fold, y, x = _batch(batch)
            for one in np.unique(s).tolist():
                for f in range(k + 1):
                    fit = fits.get(one * (k + 1) + f)
                    if fit is None or not fit.open:
                        continue
                    use = (s == one) & (fold >= 0) & (fold != f - 1)
                    z, t = fit.design(x[use]), y[use]
                    eta = z @ fit.beta
                    p = 1 / (1 + np.exp(-np.clip(eta, -700, 700)))
                    w = fit.weight[t.astype(int)]
                    second = (z * (w * p * (1 - p))[:, None]).T @ z
                    loss = float((w * (np.logaddexp(0, eta) - t * eta)).sum())
                    part = np.concatenate([second.ravel(), z.T @ (w * (t - p)), [loss]])
                    key = one * (k + 1) + f
                    held[key] = held[key] + part if key in held else part
            if sum(map(len, held.values())) > HELD:
                yield out()
        if held:
            yield out()

    return run


def _steps(sent, ridge: float):
    """fit, sums -> fit, Newton step, largest gradient, loss, standard errors."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fits: dict[int, Fit] = sent.value
        for frame in frames:
            rows = []
            for key, v in zip(frame["fit"].tolist(), frame["sums"]):
                fit, v = fits[key], np.asarray(v, float)
                d = len(fit.beta)
                pull = np.append(np.full(d - 1, ridge), 0.0)
                second = v[: d * d].reshape(d, d) + np.diag(pull)
                slope = v[d * d : d * d + d] - pull * fit.beta
                inverse = np.linalg.pinv(second, hermitian=True)
                rows.append((key, (inverse @ slope).tolist(), float(np.abs(slope).max()) / fit.total, float(v[-1] + (pull * fit.beta**2).sum() / 2), np.sqrt(np.maximum(0, np.diag(inverse))).tolist()))
            yield pd.DataFrame(rows, columns=["fit", "step", "gradient", "loss", "errors"])

    return run


def _moments(rows: DataFrame, d: int) -> dict[tuple[int, int, int], tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(slice, fold, label) -> rows, and of each feature: values, mean, population variance."""
    x = [F.col("x")[i] for i in range(d)]
    got = rows.where("fold >= 0").groupBy("s", "fold", "label").agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.count(c) for c in x]).alias("c"), F.array(*[F.avg(c) for c in x]).alias("m"), F.array(*[F.var_pop(c) for c in x]).alias("v"))
    number = lambda a: np.array([0.0 if v is None else v for v in a], float)
    return {(r["s"], r["fold"], int(r["label"])): (r["n"], np.array(r["c"], float), number(r["m"]), number(r["v"])) for r in got.collect()}


def _medians(rows: DataFrame, holes: list[int], k: int) -> dict[tuple[int, int], float]:
    """(fit, feature) -> median of the fit's training values, for features with missing values."""
    if not holes:
        return {}
    use = F.filter(F.sequence(F.lit(0), F.lit(k)), lambda f: f != F.col("fold") + 1)
    long = rows.where("fold >= 0").select("s", F.explode(use).alias("f"), F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.col("x")[j].alias("value")) for j in holes])).alias("h"))
    long = long.select((F.col("s") * (k + 1) + F.col("f")).alias("fit"), "h.j", "h.value")
    return {(r["fit"], r["j"]): r["median"] for r in quantiles(long, ["fit", "j"], "value", {"median": 0.5}).collect()}


class Regressions:
    """Fitted regressions of all slices: ``fits[slice * (k + 1) + fit]``; fit 0 has all training rows, fit i + 1 leaves out fold i."""

    def __init__(self, slices: list[tuple], names: list[str], features: list[str], k: int, fits: dict[int, Fit]):
        self.slices, self.names, self.features, self.k, self.fits = slices, names, features, k, fits

    def coefficients(self, spark) -> DataFrame:
        """One row for each fit and feature: slice columns, fit, n_train, feature, coef, std_err, z, p_value, odds_ratio, gradient, rounds.

        Coefficients belong to standardised features; the intercept is a feature of that name.
        """
        rows = []
        for key, f in sorted(self.fits.items()):
            for name, b, e in zip([*self.features, "intercept"], f.beta.tolist(), f.errors.tolist()):
                z = b / e if e > 0 else None
                p = None if z is None else math.erfc(abs(z) / math.sqrt(2))
                rows.append((*self.slices[key // (self.k + 1)], key % (self.k + 1), f.n, name, b, e, z, p, math.exp(min(b, 700.0)), f.gradient, f.rounds, not f.open))
        kinds = "fit int, n_train long, feature string, coef double, std_err double, z double, p_value double, odds_ratio double, gradient double, rounds int, settled boolean"
        return spark.createDataFrame(rows, ", ".join([f"{n} string" for n in self.names] + [kinds]))

    def scored(self, rows: DataFrame) -> DataFrame:
        """slice columns, fold, label, score, prediction: held-out rows by fit 0, training rows by the fit that left out their fold."""
        k, fits = self.k, self.fits
        sent = rows.sparkSession.sparkContext.broadcast(fits)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                s, fold, y, x = _batch(batch)
                score = np.full(len(s), np.nan)
                for key in np.unique(s * (k + 1) + fold + 1).tolist():
                    if fit := sent.value.get(key):
                        use = s * (k + 1) + fold + 1 == key
                        score[use] = fit.score(x[use])
                keep = ~np.isnan(score)
                yield pa.RecordBatch.from_arrays([pa.array(s[keep].astype(np.int32)), pa.array(fold[keep].astype(np.int32)), pa.array(y[keep]), pa.array(score[keep]), pa.array((score[keep] > 0.5).astype(float))],
                                                 names=["s", "fold", "label", "score", "prediction"])

        found = rows.select("s", "fold", "label", "x").mapInArrow(run, "s int, fold int, label double, score double, prediction double")
        table = rows.sparkSession.createDataFrame([(i, *v) for i, v in enumerate(self.slices)], ", ".join(["s int", *(f"{n} string" for n in self.names)]))
        return materialize(found).join(F.broadcast(table), "s").select(*self.names, "fold", "label", "score", "prediction")


def regress(rows: DataFrame, slices: list[tuple], names: list[str], features: list[str], k: int, ridge: float = 1.0, balanced: bool = True, rounds: int = ROUNDS) -> Regressions:
    """Fit all slices. ``rows``: s (number of the slice), fold, label (0 or 1), x (array of the features, NULL if missing).

    The loss is the weighted log loss plus ``ridge`` / 2 times the squared coefficients without the intercept; ``balanced`` weighs
    classes by rows / (2 x rows of the class). Missing values become the median of the fit's training rows. Fits whose training
    rows lack a class are left out. A fit that is not settled after ``rounds`` keeps its last state and says so.
    """
    d = len(features)
    moments = _moments(rows, d)
    holes = [j for j in range(d) if any(c[j] < n for n, c, _, _ in moments.values())]
    medians = _medians(rows, holes, k)
    fits: dict[int, Fit] = {}
    for s in range(len(slices)):
        for f in range(k + 1):
            own = [(label, *v) for (one, fold, label), v in moments.items() if one == s and fold != f - 1]
            sizes = [sum(v[1] for v in own if v[0] == c) for c in (0, 1)]
            if not all(sizes):
                continue
            n = sum(sizes)
            key = s * (k + 1) + f
            fill = np.array([medians.get((key, j)) or 0.0 for j in range(d)], float)
            parts = [p for _, m, c, mean, var in own for p in ((c, mean, var), (m - c, fill, np.zeros(d)))]
            mean = sum(c * a for c, a, _ in parts) / n
            var = sum(c * (v + (a - mean) ** 2) for c, a, v in parts) / n
            scale = np.where(var > 1e-20 * np.maximum(1, mean**2), np.sqrt(np.maximum(var, 1e-300)), 1.0)
            weight = np.array([n / (2 * c) for c in sizes]) if balanced else np.ones(2)
            fits[key] = Fit(fill, mean, scale, weight, float(weight @ sizes), n, np.zeros(d + 1))
    sc = rows.sparkSession.sparkContext
    for i in range(rounds):
        if not any(f.open for f in fits.values()):
            break
        sent = sc.broadcast(fits)
        summed = rows.select("s", "fold", "label", "x").mapInArrow(_sums(sent, ridge, k), "fit int, sums array<double>").groupBy("fit").agg(Summarizer.sum(array_to_vector("sums")).alias("v"))
        steps = summed.select("fit", vector_to_array("v").alias("sums")).mapInPandas(_steps(sent, ridge), "fit int, step array<double>, gradient double, loss double, errors array<double>").collect()
        sent.destroy()
        for r in steps:
            f = fits[r["fit"]]
            f.rounds = i + 1
            if r["loss"] > f.loss + 1e-9 * abs(f.loss) and f.step is not None and np.abs(f.step).max() > 1e-14:
                f.step = f.step / 2
                f.beta = f.last + f.step
                continue
            f.loss, f.gradient, f.errors = r["loss"], r["gradient"], np.array(r["errors"])
            if f.gradient <= SETTLED:
                f.open = False
                continue
            f.last, f.step = f.beta, np.array(r["step"])
            f.beta = f.last + f.step
    return Regressions(slices, names, features, k, fits)


def prepared(df: DataFrame, names: list[str], features: list[str], target: str, key: str, train_share: float | None = 0.7, k: int = 5, seed: int = 42) -> tuple[DataFrame, list[tuple]]:
    """(rows for ``regress``, slices): every slice split by class into training and held-out rows, and its training rows into folds.

    ``train_share=None`` holds nothing out. Slice columns are read as text; a slice needs both classes, and rows with a NULL in a
    slice column belong to none.
    """
    df = materialize(df.select(*dict.fromkeys([*names, key, target, *features])).dropna(how="any", subset=[*names, target]))  # read by many passes
    both = df.groupBy(*names).agg(F.count_distinct(target).alias("_k")).where("_k = 2").select(*names).orderBy(*names)
    slices = [tuple(r) for r in both.select(*[F.col(n).cast("string") for n in names]).collect()]
    table = df.sparkSession.createDataFrame([(*v, i) for i, v in enumerate(slices)], ", ".join([*(f"_s_{n} string" for n in names), "s int"]))
    met = F.lit(True)
    for n in names:
        met = met & F.col(n).cast("string").eqNullSafe(F.col(f"_s_{n}"))
    x = F.array(*[F.col(f).cast("double") for f in features])
    rows = df.join(F.broadcast(table), met).select("s", F.col(key).cast("string").alias("key"), F.col(target).cast("double").alias("label"), x.alias("x"))
    rows = rows.withColumn("_class", F.concat_ws("#", "s", F.col("label").cast("int")))
    if train_share is None:
        return materialize(folds(rows, "key", "_class", k, seed + 1, exact=True).drop("_class")), slices
    parted = materialize(split(rows, "key", "_class", train_share, seed, exact=True))
    train = folds(parted.where("is_train"), "key", "_class", k, seed + 1, exact=True)
    rows = train.drop("is_train", "_class").unionByName(parted.where("NOT is_train").drop("is_train", "_class").withColumn("fold", F.lit(-1)))
    return materialize(rows), slices


def validation(df: DataFrame, names: list[str], features: list[str], target: str, key: str, train_share: float = 0.7, k: int = 5, seed: int = 42, ridge: float = 1.0) -> DataFrame:
    """One row for each slice: sizes, hold-out counts and metrics with AUC, mean and deviation of the folds' accuracy, rounds, gradient."""
    rows, slices = prepared(df, names, features, target, key, train_share, k, seed)
    fitted = regress(rows, slices, names, features, k, ridge)
    scored = fitted.scored(rows)
    test = scored.where("fold < 0")
    hit = (F.col("label") == F.col("prediction")).cast("double")
    cv = scored.where("fold >= 0").groupBy(*names, "fold").agg(F.avg(hit).alias("a")).groupBy(*names).agg(F.avg("a").alias("cv_mean"), F.stddev_pop("a").alias("cv_std"))
    sizes = scored.groupBy(*names).agg(F.count_if(F.col("fold") >= 0).alias("n_train"), F.count_if(F.col("fold") < 0).alias("n_test"), F.count_if(F.col("label") == 1).alias("n_positive"))
    report = evaluate.binary_report(evaluate.confusion(test, names), names, F.col("label") == 1, F.col("prediction") == 1)
    auc = ranks.roc_auc(test, names, "score", F.col("label") == 1).select(*names, "auc")
    return sizes.join(report, names).join(auc, names).join(cv, names)


def first_order(fitted: Regressions, rows: DataFrame, ridge: float, balanced: bool) -> DataFrame:
    """The gradient of every fit, worked out anew from the rows by plain aggregates: slice columns, fit, n_train, gradient.

    ``gradient`` is the largest component per unit of weight; at the minimum of the convex loss it is zero.
    """
    spark, k, d = rows.sparkSession, fitted.k, len(fitted.features)
    table = spark.createDataFrame([(key, key // (k + 1), key % (k + 1), f.fill.tolist(), f.mean.tolist(), f.scale.tolist(), f.beta.tolist()) for key, f in fitted.fits.items()],
                                  "fit_key int, s int, fit int, fill array<double>, mean array<double>, scale array<double>, beta array<double>")
    use = rows.where("fold >= 0").join(F.broadcast(table), "s").where("fold <> fit - 1")
    z = [(F.coalesce(F.col("x")[i], F.col("fill")[i]) - F.col("mean")[i]) / F.col("scale")[i] for i in range(d)] + [F.lit(1.0)]
    eta = sum((F.col("beta")[i] * z[i] for i in range(d + 1)), F.lit(0.0))
    rest = F.col("label") - 1 / (1 + F.exp(-eta))
    # A class's sums are weighed by rows / (2 x rows of the class) once its size is known.
    by_class = use.groupBy("s", "fit", "beta", "label").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(rest * c) for c in z]).alias("g"))
    total = by_class.groupBy("s", "fit", "beta").agg(F.sum("n").alias("n_train"), F.collect_list(F.struct("n", "g")).alias("classes"))
    weight = (lambda n, t: t / (2 * n)) if balanced else (lambda n, t: F.lit(1.0))
    slope = lambda i: F.aggregate("classes", F.lit(0.0), lambda a, c: a + weight(c["n"], F.col("n_train")) * c["g"][i])
    parts = [F.abs(slope(i) - (ridge * F.col("beta")[i] if i < d else 0.0)) for i in range(d + 1)]
    names = spark.createDataFrame([(i, *v) for i, v in enumerate(fitted.slices)], ", ".join(["s int", *(f"{n} string" for n in fitted.names)]))
    return total.withColumn("gradient", F.greatest(*parts) / F.col("n_train")).join(F.broadcast(names), "s").select(*fitted.names, "fit", "n_train", "gradient")


def fold_summary(coefficients: DataFrame, names: list[str]) -> DataFrame:
    """Coefficients and p-values over the folds' fits, by slice and feature: mean, deviation, least, largest, the first fit's odds ratio."""
    return coefficients.where("fit > 0").groupBy(*names, "feature").agg(
        F.avg("coef").alias("coef_mean"), F.stddev_samp("coef").alias("coef_std"), F.avg("p_value").alias("p_mean"), F.stddev_samp("p_value").alias("p_std"),
        F.min("p_value").alias("p_min"), F.max("p_value").alias("p_max"), F.min_by("odds_ratio", "fit").alias("first_odds_ratio"))
