"""Model-quality metrics as aggregates, and the splits/folds models are evaluated on.

Everything here is a grouped aggregate over (actual, predicted) rows; the confusion matrix has
k x k rows for k classes, so the per-class report is computed on that small table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import attach, hash_chunks, order_cuts
from ..session import materialize


def regression_metrics(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """rmse, mae, r2, mape (percent) in one pass; r2 of a constant target and mape with a zero
    target are null."""
    y = F.col(actual).cast("double")
    e = y - F.col(predicted).cast("double")
    n = F.count(F.lit(1))
    ss_tot = F.var_pop(y) * n
    return df.groupBy(*by).agg(
        F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        F.when(ss_tot > 0, 1 - F.sum(e * e) / ss_tot).alias("r2"),
        F.when(F.count_if(y == 0) == 0, F.avg(F.abs(e / F.nullif(y, F.lit(0.0)))) * 100).alias("mape"),
        n.alias("n"),
    )


def confusion(df: DataFrame, actual: str, predicted: str, labels: Sequence | None = None) -> DataFrame:
    """Long confusion matrix ``(actual, predicted, count)`` over ``labels`` (default: the sorted
    union of both columns), zero-filled; ``actual_pos``/``predicted_pos`` give the label order. Labels
    come from the distinct pairs that the count leaves, never from the rows."""
    counts = df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")) \
        .agg(F.count(F.lit(1)).alias("count"))
    if labels is None:
        seen = counts.select(F.explode(F.array("actual", "predicted")).alias("label")).where(F.col("label").isNotNull()).distinct()
        dim = seen.agg(F.array_sort(F.collect_list("label")).alias("__l"))
    else:
        dim = df.sparkSession.range(1).select(F.array(*[F.lit(v) for v in labels]).alias("__l"))
    cells = dim.select(F.posexplode("__l").alias("actual_pos", "actual"), "__l") \
        .select("actual_pos", "actual", F.posexplode("__l").alias("predicted_pos", "predicted"))
    return cells.join(counts, ["actual", "predicted"], "left").select(
        "actual_pos", "actual", "predicted_pos", "predicted",
        F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))


def _per_class(cm: DataFrame) -> DataFrame:
    diag = cm.where(F.col("actual_pos") == F.col("predicted_pos")).select(
        F.col("actual_pos").alias("pos"), F.col("actual").alias("label"), F.col("count").alias("tp"))
    support = cm.groupBy(F.col("actual_pos").alias("pos")).agg(F.sum("count").alias("support"))
    pred = cm.groupBy(F.col("predicted_pos").alias("pos")).agg(F.sum("count").alias("pred_n"))
    t = diag.join(support, "pos").join(pred, "pos")
    prec = F.coalesce(F.col("tp") / F.nullif(F.col("pred_n"), F.lit(0)), F.lit(0.0))
    rec = F.coalesce(F.col("tp") / F.nullif(F.col("support"), F.lit(0)), F.lit(0.0))
    f1 = F.coalesce(2 * prec * rec / F.nullif(prec + rec, F.lit(0.0)), F.lit(0.0))
    return t.select("pos", F.col("label").cast("string").alias("label"), prec.alias("precision"),
                    rec.alias("recall"), f1.alias("f1"), F.col("support").cast("bigint").alias("support"),
                    "tp")


def classification_report(df: DataFrame, actual: str, predicted: str, labels: Sequence | None = None) -> DataFrame:
    """Per class precision/recall/f1/support, then ``accuracy``, ``macro avg``, ``weighted avg``
    rows (zero division -> 0). ``pos`` orders the rows. Eager: the matrix (classes x classes) is written once, so
    the rows are scored once however often the report reads it."""
    pc = _per_class(materialize(confusion(df, actual, predicted, labels)))
    k = pc.agg(F.count(F.lit(1)).alias("k"), F.sum("support").alias("n"), F.sum("tp").alias("tp"),
               F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
               (F.sum(F.col("precision") * F.col("support")) / F.nullif(F.sum("support"), F.lit(0))).alias("wp"),
               (F.sum(F.col("recall") * F.col("support")) / F.nullif(F.sum("support"), F.lit(0))).alias("wr"),
               (F.sum(F.col("f1") * F.col("support")) / F.nullif(F.sum("support"), F.lit(0))).alias("wf"))
    acc = F.coalesce(F.col("tp") / F.nullif(F.col("n"), F.lit(0)), F.lit(0.0))
    null = F.lit(None).cast("double")
    summary = k.select(F.explode(F.array(
        F.struct((F.col("k")).alias("pos"), F.lit("accuracy").alias("label"), null.alias("precision"),
                 null.alias("recall"), acc.alias("f1"), F.col("n").alias("support")),
        F.struct((F.col("k") + 1).alias("pos"), F.lit("macro avg").alias("label"), F.col("mp").alias("precision"),
                 F.col("mr").alias("recall"), F.col("mf").alias("f1"), F.col("n").alias("support")),
        F.struct((F.col("k") + 2).alias("pos"), F.lit("weighted avg").alias("label"), F.col("wp").alias("precision"),
                 F.col("wr").alias("recall"), F.col("wf").alias("f1"), F.col("n").alias("support")),
    )).alias("r")).select("r.*")
    cols = ["pos", "label", "precision", "recall", "f1", "support"]
    return pc.select(*cols).unionByName(summary.select(F.col("pos").cast("int"), *cols[1:]))


def classification_metrics(df: DataFrame, actual: str, predicted: str, labels: Sequence | None = None) -> DataFrame:
    """One row: accuracy and support-weighted precision, recall and f1 (zero division -> 0)."""
    rep = classification_report(df, actual, predicted, labels)
    acc = rep.where(F.col("label") == "accuracy").select(F.col("f1").alias("accuracy"))
    w = rep.where(F.col("label") == "weighted avg").select(
        F.coalesce("precision", F.lit(0.0)).alias("precision_weighted"),
        F.coalesce("recall", F.lit(0.0)).alias("recall_weighted"),
        F.coalesce("f1", F.lit(0.0)).alias("f1_weighted"))
    return acc.crossJoin(w)


def balanced_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Adds ``n / (k * n_class)`` per row (sklearn's ``class_weight='balanced'``)."""
    counts = df.where(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("__nc"))
    tot = counts.agg(F.sum("__nc").alias("__n"), F.count(F.lit(1)).alias("__k"))
    w = attach(counts, tot, []).select(label, (F.col("__n") / (F.col("__k") * F.col("__nc"))).alias(out))
    return attach(df, w, [label])


def stratified_split(df: DataFrame, label: str, validation_size: float = 0.2, seed: int = 42,
                     id_col: str = "row_id", out: str = "is_validation") -> DataFrame:
    """Per class, the first ``round(validation_size * n_class)`` rows of a seeded hash order are
    validation rows. Exact per-class counts without a per-class window (see ``rank_cuts``)."""
    chunks = hash_chunks(df, label, id_col, seed, [validation_size], "__chunk")
    return chunks.withColumn(out, F.col("__chunk") == 0).drop("__chunk")


def random_split(df: DataFrame, validation_size: float = 0.2, seed: int = 42, id_col: str = "row_id",
                 out: str = "is_validation") -> DataFrame:
    """The first ``round(validation_size * n)`` rows of a seeded hash order are validation rows."""
    chunks = hash_chunks(df, None, id_col, seed, [validation_size], "__chunk")
    return chunks.withColumn(out, F.col("__chunk") == 0).drop("__chunk")


def stratified_folds(df: DataFrame, label: str, k: int = 5, seed: int = 42, id_col: str = "row_id",
                     out: str = "fold") -> DataFrame:
    """Shuffled stratified k-fold: per class the hash order is cut into ``k`` chunks whose sizes
    differ by at most one."""
    return hash_chunks(df, label, id_col, seed, [j / k for j in range(1, k)], out)


def contiguous_folds(df: DataFrame, k: int = 5, order_col: str = "row_id", out: str = "fold") -> DataFrame:
    """Unshuffled k-fold over the ``order_col`` order: the first ``n % k`` folds hold one extra row.

    The ``k - 1`` values at which folds begin are found first (eager, see ``order_cuts``); the rows
    themselves are only compared with them, so none can be lost. ``order_col`` is expected to be
    unique; equal values share a fold, and nulls are in the first one.
    """
    fold = F.lit(0)
    for cut in order_cuts(df, order_col, k):
        at = F.lit(False) if cut is None else F.coalesce(F.col(order_col) >= F.lit(cut), F.lit(False))
        fold = fold + F.when(at, 1).otherwise(0)
    return df.withColumn(out, fold.cast("int"))
