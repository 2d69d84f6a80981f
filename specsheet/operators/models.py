"""Price regression and performance-class classification with ``pyspark.ml``.

Both predictors share one shape: median imputation fitted on the training rows (exact medians,
one grouped pass), a ``VectorAssembler`` + estimator ``PipelineModel`` per candidate, a hash
split for validation, metrics computed as aggregates for train and validation in one pass, and
the best candidate chosen on validation. The assembled training set is checkpointed into the
session's checkpoint dir once and shared by all candidates, so a lost executor does not send
every fit back to the source files.
"""

from __future__ import annotations

import json
import math
import os
from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassifier, LogisticRegression, OneVsRest, OneVsRestModel,
                                       RandomForestClassifier)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from ..sources.tables import ROWS_A_TASK
from .clean import ACCEL
from .features import CATEGORIES, MODEL_NUMERIC, impute_median, median_stats
from .metrics import (balanced_weights, classification_metrics, classification_report, confusion,
                      contiguous_folds, random_split, regression_metrics, stratified_folds, stratified_split)
from .ridge import ridge_fold_scores

FEATURES = "features"
SEED = 42


def regression_candidates(seed: int = SEED, fast: bool = False) -> dict:
    """The candidate registry. ``fast`` shrinks the ensembles (tests only). The forest keeps each row's node per tree, so
    a pass does not walk the deep trees from their roots."""
    trees, depth, rounds, gdepth = (10, 6, 10, 3) if fast else (100, 15, 100, 6)
    return {
        "random_forest": RandomForestRegressor(numTrees=trees, maxDepth=depth, minInstancesPerNode=2,
                                               featureSubsetStrategy="all", seed=seed, cacheNodeIds=True),
        "gradient_boosting": GBTRegressor(maxIter=rounds, maxDepth=gdepth, stepSize=0.1, seed=seed),
        # Closed-form ridge with alpha = 1 on unscaled features: Spark scales its penalty by
        # sigma(y) / n, so regParam is set at fit time (see ``PricePredictor._estimator``).
        "ridge": LinearRegression(elasticNetParam=0.0, standardization=False, solver="normal"),
    }


def classification_candidates(seed: int = SEED, fast: bool = False) -> dict:
    trees, depth, rounds, gdepth = (10, 5, 10, 3) if fast else (100, 10, 100, 5)
    return {
        "random_forest": RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=2,
                                                featureSubsetStrategy="sqrt", weightCol="weight", seed=seed),
        # GBTClassifier is binary only; one-vs-rest gives the multiclass model.
        "gradient_boosting": OneVsRest(classifier=GBTClassifier(maxIter=rounds, maxDepth=gdepth, stepSize=0.1,
                                                                seed=seed)),
        # L2 logistic regression, C = 1: Spark's penalty is divided by the weight sum, so
        # regParam = 1 / (C * sum(w)) is set at fit time.
        "logistic_regression": LogisticRegression(family="multinomial", maxIter=1000, elasticNetParam=0.0,
                                                  standardization=False, weightCol="weight"),
    }


def _is_closed_ridge(est) -> bool:
    """The default ridge candidate: penalty 1 on unscaled features, solved in closed form."""
    return (isinstance(est, LinearRegression) and not est.isSet("regParam") and est.getSolver() == "normal"
            and est.getElasticNetParam() == 0.0 and not est.getStandardization() and est.getFitIntercept())


def _parallel(fn, tasks: list, parallelism: int) -> list:
    """Run independent fits as concurrent Spark jobs (as ``CrossValidator(parallelism=...)``
    does); results keep the task order."""
    if parallelism <= 1 or len(tasks) <= 1:
        return [fn(t) for t in tasks]
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(max_workers=parallelism) as pool:
        return list(pool.map(fn, tasks))


def side_by_side(*jobs) -> list:
    """The results of independent trainings run at once: one's many short jobs fill the cores that another's leave."""
    return _parallel(lambda job: job(), list(jobs), len(jobs))


def fit_partitions(df: DataFrame, share: int = 1) -> DataFrame:
    """Training rows in a partition a core at most. In every pass of a tree fit each partition fills and sends the
    statistics of all nodes that are open, however few rows it has: more partitions than cores only add to that.
    Of several fits at once each takes one core in ``share``."""
    return df.coalesce(max(1, -(-df.sparkSession.sparkContext.defaultParallelism // share)))


def near_rows(df: DataFrame, columns: Sequence[str], id_col: str) -> DataFrame:
    """The same rows, those alike in all ``columns`` side by side: in order of the bits of each column's eighth, taken
    in turns. Neighbours then fall into the same nodes of a tree, so a pass adds to few sums at a time instead of
    to places all over them. Up to ``ROWS_A_TASK`` rows stay as they are."""
    tasks = -(-df.count() // ROWS_A_TASK)
    if tasks <= 1:
        return df
    cuts = df.approxQuantile(list(columns), [i / 8 for i in range(1, 8)], 0.01)
    eighth = [sum((F.coalesce(F.col(f"`{c}`") > q, F.lit(False)).cast("int") for q in found), F.lit(0)) for c, found in zip(columns, cuts)]
    order = F.lit(0).cast("long")
    for bit in (2, 1, 0):
        for e in eighth[: 63 // 3]:  # as many as a long has room for
            order = order * 2 + F.shiftright(e, bit).bitwiseAND(1)
    return df.repartitionByRange(tasks, order, id_col).sortWithinPartitions(order, id_col)


class _Base:
    kind = "base"

    def __init__(self, feature_cols: Sequence[str] = tuple(MODEL_NUMERIC), candidates: dict | None = None,
                 seed: int = SEED, id_col: str = "row_id", fast: bool = False, parallelism: int = 4):
        self.feature_cols = list(feature_cols)
        self.seed, self.id_col, self.fast = seed, id_col, fast
        self.parallelism = parallelism
        self.candidates = candidates if candidates is not None else self._default_candidates()
        self.models: dict[str, PipelineModel] = {}
        self.medians: dict[str, float | None] = {}
        self.best_model_name: str | None = None
        self.is_fitted = False

    def _default_candidates(self) -> dict:
        raise NotImplementedError

    # ------------------------------------------------------------ shared pieces

    def _impute(self, df: DataFrame, medians: dict | None = None, batch: bool = False) -> DataFrame:
        """Fill feature nulls with fitted medians (``batch=True``: the batch's own medians)."""
        if batch or medians is None:
            return impute_median(df, self.feature_cols)
        row = df.sparkSession.createDataFrame(
            [tuple(medians.get(c) for c in self.feature_cols)],
            ", ".join(f"`{c}` double" for c in self.feature_cols))
        return impute_median(df, self.feature_cols, row)

    def _fit_medians(self, df: DataFrame) -> dict:
        row = median_stats(df, self.feature_cols).first()
        return {c: (None if row[c] is None else float(row[c])) for c in self.feature_cols}

    def _assembler(self) -> VectorAssembler:
        return VectorAssembler(inputCols=self.feature_cols, outputCol=FEATURES, handleInvalid="keep")

    def _model(self, name: str | None) -> tuple[str, PipelineModel]:
        if not self.is_fitted:
            raise ValueError("train the candidates before using one")
        name = name or self.best_model_name
        if name not in self.models:
            raise ValueError(f"Model {name!r} not available")
        return name, self.models[name]

    def _fold_rows(self, rows: DataFrame) -> tuple[DataFrame, int]:
        """The written rows of all folds, in the order of ``near_rows``, and the share of the cores that each of the fits
        at once takes: half of them where the rows are many, so that a late fit does not leave most cores idle."""
        rows = materialize(rows)
        if rows.count() <= ROWS_A_TASK:
            return rows, 1
        return materialize(near_rows(rows, self.feature_cols, self.id_col)), 2 if self.parallelism > 1 else 1

    # ------------------------------------------------------------ persistence (SNK-1/2)

    def save_model(self, path: str, model_name: str | None = None) -> None:
        name, model = self._model(model_name)
        model.write().overwrite().save(os.path.join(path, "pipeline"))
        meta = {"kind": self.kind, "model_name": name, "feature_cols": self.feature_cols,
                "medians": self.medians, **self._extra_meta()}
        from pyspark.sql import SparkSession
        ss = SparkSession.getActiveSession()
        ss.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(
            os.path.join(path, "meta"))

    def _extra_meta(self) -> dict:
        return {}

    @classmethod
    def load_model(cls, path: str):
        from pyspark.sql import SparkSession
        ss = SparkSession.getActiveSession()
        meta = json.loads(ss.read.text(os.path.join(path, "meta")).first()[0])
        obj = cls(meta["feature_cols"], candidates={})
        obj.models = {meta["model_name"]: PipelineModel.load(os.path.join(path, "pipeline"))}
        obj.best_model_name = meta["model_name"]
        obj.medians = meta["medians"]
        obj._load_extra(meta)
        obj.is_fitted = True
        return obj

    def _load_extra(self, meta: dict) -> None:
        pass


class PricePredictor(_Base):
    """Regression candidates, trained on one split, best by validation R^2."""

    kind = "regressor"

    def _default_candidates(self) -> dict:
        return regression_candidates(self.seed, self.fast)

    def _estimator(self, name: str, est, train: DataFrame, target: str):
        est = est.copy()
        est.setLabelCol(target).setFeaturesCol(FEATURES)
        if isinstance(est, LinearRegression) and not est.isSet("regParam"):
            s = train.agg(F.stddev_pop(target).alias("s"), F.count(F.lit(1)).alias("n")).first()
            est.setRegParam(float(s["s"] or 0.0) / max(int(s["n"]), 1))
        return est

    def train(self, df: DataFrame, target: str, validate: bool = True, validation_size: float = 0.2) -> DataFrame:
        """Fit every candidate; returns ``(model, status, split, rmse, mae, r2, mape, n, error)``."""
        spark = df.sparkSession
        rows = df.select(self.id_col, *self.feature_cols, F.col(target).cast("double").alias(target))
        if validate:
            rows = random_split(rows, validation_size, self.seed, self.id_col)
        else:
            rows = rows.withColumn("is_validation", F.lit(False))
        rows = materialize(rows)
        train = rows.where(~F.col("is_validation"))
        self.medians = self._fit_medians(train)
        data = materialize(near_rows(self._impute(rows, self.medians), self.feature_cols, self.id_col))
        fit_rows = fit_partitions(data.where(~F.col("is_validation")))
        results, best = [], -math.inf
        self.models, self.best_model_name = {}, None

        def one(item):
            name, est = item
            try:
                pipe = Pipeline(stages=[self._assembler(), self._estimator(name, est, fit_rows, target)])
                model = pipe.fit(fit_rows)
                m = regression_metrics(model.transform(data), target, "prediction", by=["is_validation"]).collect()
                return name, model, sorted(m, key=lambda r: r["is_validation"]), None
            except Exception as e:  # per-candidate error capture, as the reference does
                return name, None, [], str(e)

        for name, model, m, err in _parallel(one, list(self.candidates.items()), self.parallelism):
            if err is not None:
                results.append((name, "error", None, None, None, None, None, None, err))
                continue
            self.models[name] = model
            for r in m:
                split = "validation" if r["is_validation"] else "train"
                results.append((name, "success", split, r["rmse"], r["mae"], r["r2"], r["mape"], r["n"], None))
                if r["is_validation"] and r["r2"] is not None and r["r2"] > best:
                    best, self.best_model_name = r["r2"], name
        if self.best_model_name is None:
            self.best_model_name = "random_forest" if "random_forest" in self.models else next(iter(self.models), None)
        self.is_fitted = True
        return spark.createDataFrame(results, "model string, status string, split string, rmse double, mae double, "
                                              "r2 double, mape double, n long, error string")

    def predict(self, df: DataFrame, model_name: str | None = None, out: str = "prediction",
                impute: str = "fitted") -> DataFrame:
        """Adds ``out``; ``impute='batch'`` fills with the scored batch's medians (reference)."""
        _, model = self._model(model_name)
        scored = model.transform(self._impute(df, self.medians, batch=(impute == "batch")))
        return scored.drop(FEATURES).withColumnRenamed("prediction", out) if out != "prediction" else scored.drop(FEATURES)

    def feature_importance(self, model_name: str | None = None) -> DataFrame:
        """``(feature, importance)`` desc: tree importances, or |coefficient| for linear models."""
        _, model = self._model(model_name)
        est = model.stages[-1]
        vals = est.featureImportances.toArray().tolist() if hasattr(est, "featureImportances") \
            else [abs(x) for x in est.coefficients.toArray().tolist()]
        from pyspark.sql import SparkSession
        return SparkSession.getActiveSession().createDataFrame(
            list(zip(self.feature_cols, [float(v) for v in vals])), "feature string, importance double"
        ).orderBy(F.desc("importance"), "feature")

    def cross_validate(self, df: DataFrame, target: str, cv: int = 5) -> DataFrame:
        """Unshuffled contiguous k-fold R^2 per candidate and fold, over batch-median imputed rows.
        Returns ``(model, fold, r2)``; ``cv_summary`` gives mean and population std."""
        spark = df.sparkSession
        rows = df.select(self.id_col, *self.feature_cols, F.col(target).cast("double").alias(target))
        data, share = self._fold_rows(contiguous_folds(self._impute(rows, batch=True), cv, self.id_col))

        def one(task):
            name, est, k = task
            tr, te = fit_partitions(data.where(F.col("fold") != k), share), data.where(F.col("fold") == k)
            try:
                model = Pipeline(stages=[self._assembler(), self._estimator(name, est, tr, target)]).fit(tr)
                return name, k, regression_metrics(model.transform(te), target, "prediction").first()["r2"], None
            except Exception as e:
                return name, k, None, str(e)

        one_pass = [name for name, est in self.candidates.items() if _is_closed_ridge(est)]
        tasks = [(name, est, k) for name, est in self.candidates.items() if name not in one_pass for k in range(cv)]
        found = _parallel(one, tasks, self.parallelism)
        for name in one_pass:  # every fold from one pass of products
            scores = ridge_fold_scores(data, self.feature_cols, target, "fold")
            found += [(name, k, scores.get(k), None) for k in range(cv)]
        return spark.createDataFrame(found, "model string, fold int, r2 double, error string")


def cv_summary(cv: DataFrame, score: str = "r2") -> DataFrame:
    """Mean and population std of the fold scores per model."""
    return cv.groupBy("model").agg(F.avg(score).alias(f"mean_{score}"), F.stddev_pop(score).alias(f"std_{score}"),
                                   F.count(score).alias("folds"))


def _fold_weights(sizes: dict[tuple[int, float], int], held_out: int) -> dict[float, float]:
    """Balanced class weights of the rows outside a fold, from the counts per fold and class."""
    counts: dict[float, int] = {}
    for (fold, label), n in sizes.items():
        if fold != held_out and label is not None:
            counts[label] = counts.get(label, 0) + n
    total = sum(counts.values())
    return {label: total / (len(counts) * n) for label, n in sorted(counts.items())}


# The performance classes are cuts of the acceleration, so a classifier that sees it learns the cuts.
LEAKY_FEATURES = (ACCEL,)


class PerformanceClassifier(_Base):
    """Classification candidates on a stratified split, best by validation weighted F1."""

    kind = "classifier"

    def __init__(self, *args, labels: Sequence[str] | None = None, drop_leaky: bool = False, **kw):
        """``drop_leaky`` leaves out the features that the class is made from."""
        super().__init__(*args, **kw)
        if drop_leaky:
            self.feature_cols = [c for c in self.feature_cols if c not in LEAKY_FEATURES]
        self.labels: list[str] = list(labels) if labels else []

    def _default_candidates(self) -> dict:
        return classification_candidates(self.seed, self.fast)

    def _extra_meta(self) -> dict:
        return {"labels": self.labels}

    def _load_extra(self, meta: dict) -> None:
        self.labels = meta.get("labels", [])

    def _index(self, df: DataFrame, target: str) -> DataFrame:
        """Label -> alphabetical index (``label``), a small broadcast dimension."""
        dim = df.sparkSession.createDataFrame([(v, float(i)) for i, v in enumerate(self.labels)],
                                              f"`{target}` string, label double")
        return df.join(F.broadcast(dim), target, "left")

    def _estimator(self, est, train: DataFrame):
        est = est.copy()
        if isinstance(est, OneVsRest):
            est.setLabelCol("label").setFeaturesCol(FEATURES)
            est.setParallelism(max(1, len(self.labels)))  # the classes' fits are independent jobs of many short stages
            return est
        est.setLabelCol("label").setFeaturesCol(FEATURES)
        if isinstance(est, LogisticRegression) and not est.isSet("regParam"):
            wsum = train.agg(F.sum("weight")).first()[0] or 1.0
            est.setRegParam(1.0 / float(wsum))
        return est

    def train(self, df: DataFrame, target: str, validate: bool = True, validation_size: float = 0.2) -> DataFrame:
        """Returns ``(model, status, split, accuracy, precision_weighted, recall_weighted,
        f1_weighted, error)``."""
        spark = df.sparkSession
        rows = df.where(F.col(target).isNotNull()).select(self.id_col, *self.feature_cols, target)
        self.labels = [r[0] for r in rows.select(target).distinct().orderBy(target).collect()]
        if validate:
            rows = stratified_split(rows, target, validation_size, self.seed, self.id_col)
        else:
            rows = rows.withColumn("is_validation", F.lit(False))
        rows = materialize(self._index(rows, target))
        train = rows.where(~F.col("is_validation"))
        self.medians = self._fit_medians(train)
        data = balanced_weights(self._impute(rows, self.medians), "label", "weight")
        data = materialize(near_rows(data, self.feature_cols, self.id_col))
        fit_rows = fit_partitions(data.where(~F.col("is_validation")))
        results, best = [], -math.inf
        self.models, self.best_model_name = {}, None

        def one(item):
            name, est = item
            try:
                model = Pipeline(stages=[self._assembler(), self._estimator(est, fit_rows)]).fit(fit_rows)
                scored = model.transform(data)
                ms = []
                for split, flag in (("train", False), ("validation", True)):
                    if split == "validation" and not validate:
                        continue
                    ms.append((split, classification_metrics(scored.where(F.col("is_validation") == flag), "label",
                                                             "prediction").first()))
                return name, model, ms, None
            except Exception as e:
                return name, None, [], str(e)

        for name, model, ms, err in _parallel(one, list(self.candidates.items()), self.parallelism):
            if err is not None:
                results.append((name, "error", None, None, None, None, None, err))
                continue
            self.models[name] = model
            for split, m in ms:
                results.append((name, "success", split, m["accuracy"], m["precision_weighted"],
                                m["recall_weighted"], m["f1_weighted"], None))
                if split == "validation" and m["f1_weighted"] > best:
                    best, self.best_model_name = m["f1_weighted"], name
        if self.best_model_name is None:
            self.best_model_name = "random_forest" if "random_forest" in self.models else next(iter(self.models), None)
        self.is_fitted = True
        return spark.createDataFrame(results, "model string, status string, split string, accuracy double, "
                                              "precision_weighted double, recall_weighted double, "
                                              "f1_weighted double, error string")

    def _label_of(self, c) -> F.Column:
        return F.element_at(F.array(*[F.lit(v) for v in self.labels]), c.cast("int") + 1)

    def predict(self, df: DataFrame, model_name: str | None = None, out: str = "predicted_class",
                impute: str = "fitted") -> DataFrame:
        """Adds ``out`` with the class name."""
        _, model = self._model(model_name)
        scored = model.transform(self._impute(df, self.medians, batch=(impute == "batch")))
        keep = [c for c in df.columns]
        return scored.select(*keep, self._label_of(F.col("prediction")).alias(out))

    def predict_proba(self, df: DataFrame, model_name: str | None = None, impute: str = "fitted") -> DataFrame:
        """One probability column per class (alphabetical), rows summing to 1. One-vs-rest
        boosting emits margins only: each class gets sigmoid(2 * margin), then normalised."""
        _, model = self._model(model_name)
        scored = model.transform(self._impute(df, self.medians, batch=(impute == "batch")))
        k = len(self.labels)
        est = model.stages[-1]
        if isinstance(est, OneVsRestModel):
            raw = vector_to_array("rawPrediction")
            p = [1 / (1 + F.exp(-2 * raw[i])) for i in range(k)]
            tot = sum(p[1:], p[0])
            probs = [x / tot for x in p]
        else:
            arr = vector_to_array("probability")
            probs = [arr[i] for i in range(k)]
        return scored.select(*df.columns, *[pr.alias(f"proba_{lab}") for pr, lab in zip(probs, self.labels)])

    def _scored_labels(self, df: DataFrame, target: str, model_name: str | None) -> DataFrame:
        return self.predict(df.where(F.col(target).isNotNull()), model_name, out="__pred").select(
            F.col(target).alias("actual"), F.col("__pred").alias("predicted"))

    def confusion_matrix(self, df: DataFrame, target: str, model_name: str | None = None,
                         labels: Sequence[str] = tuple(CATEGORIES)) -> DataFrame:
        return confusion(self._scored_labels(df, target, model_name), "actual", "predicted", list(labels))

    def classification_report(self, df: DataFrame, target: str, model_name: str | None = None) -> DataFrame:
        return classification_report(self._scored_labels(df, target, model_name), "actual", "predicted")

    def feature_importance(self, model_name: str | None = None) -> DataFrame:
        """Tree importances; mean |coefficient| over classes for logistic regression; mean of the
        sub-models' importances for one-vs-rest."""
        _, model = self._model(model_name)
        est = model.stages[-1]
        d = len(self.feature_cols)
        if isinstance(est, OneVsRestModel):
            subs = [m.featureImportances.toArray() for m in est.models]
            vals = [sum(s[i] for s in subs) / len(subs) for i in range(d)]
        elif hasattr(est, "featureImportances"):
            vals = est.featureImportances.toArray().tolist()
        else:
            cm = est.coefficientMatrix.toArray()
            vals = [float(abs(cm[:, i]).mean()) for i in range(d)]
        from pyspark.sql import SparkSession
        return SparkSession.getActiveSession().createDataFrame(
            list(zip(self.feature_cols, [float(v) for v in vals])), "feature string, importance double"
        ).orderBy(F.desc("importance"), "feature")

    def cross_validate(self, df: DataFrame, target: str, cv: int = 5) -> DataFrame:
        """Shuffled stratified k-fold weighted F1 per candidate and fold ``(model, fold, f1)``."""
        spark = df.sparkSession
        rows = df.where(F.col(target).isNotNull()).select(self.id_col, *self.feature_cols, target)
        if not self.labels:
            self.labels = [r[0] for r in rows.select(target).distinct().orderBy(target).collect()]
        rows = stratified_folds(self._index(self._impute(rows, batch=True), target), target, cv, self.seed,
                                self.id_col)
        data, share = self._fold_rows(rows)
        sizes = {(r["fold"], r["label"]): r["count"] for r in data.groupBy("fold", "label").count().collect()}  # folds x classes
        weights = {k: _fold_weights(sizes, k) for k in range(cv)}

        def one(task):
            name, est, k = task
            weight = F.coalesce(*[F.when(F.col("label") == label, w) for label, w in weights[k].items()], F.lit(0.0))
            tr = fit_partitions(data.where(F.col("fold") != k), share).withColumn("weight", weight)
            te = data.where(F.col("fold") == k).withColumn("weight", F.lit(1.0))
            try:
                model = Pipeline(stages=[self._assembler(), self._estimator(est, tr)]).fit(tr)
                f1 = classification_metrics(model.transform(te), "label", "prediction").first()["f1_weighted"]
                return name, k, f1, None
            except Exception as e:
                return name, k, None, str(e)

        tasks = [(name, est, k) for name, est in self.candidates.items() for k in range(cv)]
        return spark.createDataFrame(_parallel(one, tasks, self.parallelism),
                                     "model string, fold int, f1 double, error string")
