"""Binary scores: threshold curves, summary metrics and segment-aware adjustment."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltlane.plans.joins import scalar_join
from voltlane.plans.ordering import chunked, plain, with_index, with_run_max, with_running

LABEL, SCORE, PREDICTED = "label", "score", "predicted"
METRICS = ("f1", "precision", "recall", "accuracy")


def score_binary(df: DataFrame, threshold: float | None = None, score: str = SCORE, target: str = PREDICTED) -> DataFrame:
    """1 at or above the threshold; only a missing threshold falls back to 0.5, a threshold of 0 is kept."""
    cut = 0.5 if threshold is None else threshold
    return df.withColumn(target, (F.col(score) >= F.lit(float(cut))).cast("int"))


def _safe(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def metric_columns(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    """Accuracy, precision, recall and F1, 0 on empty denominators."""
    return {
        "accuracy": _safe(tp + tn, tp + fp + fn + tn),
        "precision": _safe(tp, tp + fp),
        "recall": _safe(tp, tp + fn),
        "f1": _safe(2 * tp, 2 * tp + fp + fn),
    }


def grouped_scores(df: DataFrame, score: str = SCORE, label: str = LABEL) -> DataFrame:
    """One row per distinct score with the confusion counts of ``score >= threshold``.

    Equal scores are counted before anything is sorted, so ties of any size are one row.
    """
    counts = df.groupBy(F.col(score).alias("threshold")).agg(
        F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) == 0).alias("_neg")
    )
    cdf = chunked(counts, [], [F.col("threshold").desc()])
    run = with_running(cdf, [], {"tp": ("sum", "_pos"), "fp": ("sum", "_neg")})
    totals = cdf.agg(F.sum("_pos").alias("_p"), F.sum("_neg").alias("_q"))
    full = scalar_join(plain(run), totals)
    return full.withColumns({"fn": F.col("_p") - F.col("tp"), "tn": F.col("_q") - F.col("fp")})


def threshold_curve(df: DataFrame, score: str = SCORE, label: str = LABEL) -> DataFrame:
    """Confusion counts and metrics at every distinct score."""
    return grouped_scores(df, score, label).withColumns(
        metric_columns(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn"))
    )


def pr_curve(df: DataFrame, score: str = SCORE, label: str = LABEL) -> DataFrame:
    """Precision and recall at every distinct score."""
    return threshold_curve(df, score, label).select("threshold", "precision", "recall")


def _best(curve: DataFrame, value: Column, name: str) -> DataFrame:
    """Highest value, the lowest threshold among equals; 0.5 when nothing is above 0."""
    best = curve.agg(F.max(F.struct(value.alias("v"), (-F.col("threshold")).alias("t"))).alias("_b"))
    found = F.col("_b.v") > 0
    return best.select(
        F.when(found, -F.col("_b.t")).otherwise(F.lit(0.5)).alias("threshold"), F.coalesce(F.col("_b.v"), F.lit(0.0)).alias(name)
    )


def best_threshold(curve: DataFrame, metric: str = "f1") -> DataFrame:
    """Best threshold of a curve by one of its metrics."""
    if metric not in METRICS:
        raise ValueError(f"unknown metric {metric!r}")
    return _best(curve, F.col(metric), metric)


def threshold_all_scores(df: DataFrame, metric: str = "f1", score: str = SCORE, label: str = LABEL) -> DataFrame:
    """Best threshold among all distinct scores."""
    return best_threshold(threshold_curve(df, score, label), metric)


def threshold_pr_curve(df: DataFrame, score: str = SCORE, label: str = LABEL) -> DataFrame:
    """Best threshold by ``2 p r / (p + r + 1e-10)`` over the precision-recall curve."""
    p, r = F.col("precision"), F.col("recall")
    return _best(pr_curve(df, score, label), 2 * p * r / (p + r + 1e-10), "f1")


# fixed values: 0.01 to 0.99 in steps of 0.01
GRID = [float(t) for t in np.linspace(0.01, 0.99, 99)]


def threshold_grid_curve(df: DataFrame, score: str = SCORE, label: str = LABEL) -> DataFrame:
    """Confusion counts and metrics at the 99 grid thresholds, from counts per grid cell."""
    cuts = F.array(*[F.lit(t) for t in GRID])
    s = F.col(score)
    near = F.greatest(F.lit(0), F.least(F.lit(99), F.floor(s * 100))).cast("int")
    up = (F.col("_near") < 99) & (F.get(cuts, F.col("_near")) <= s)
    down = (F.col("_near") > 0) & (F.get(cuts, F.col("_near") - 1) > s)
    cell = F.col("_near") + F.when(up, 1).when(down, -1).otherwise(0)
    counts = df.withColumn("_near", near).groupBy(cell.alias("_cell")).agg(
        F.count_if(F.col(label) == 1).alias("_pos"), F.count_if(F.col(label) == 0).alias("_neg")
    )  # at most 100 rows
    above = lambda c, i: F.coalesce(F.sum(F.when(F.col("_cell") > i, F.col(c))), F.lit(0))
    sums = [F.sum("_pos").alias("_p"), F.sum("_neg").alias("_q")]
    for i in range(len(GRID)):
        sums += [above("_pos", i).alias(f"tp{i}"), above("_neg", i).alias(f"fp{i}")]
    rows = [F.struct(F.lit(t).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp")) for i, t in enumerate(GRID)]
    curve = counts.agg(*sums).select("_p", "_q", F.inline(F.array(*rows)))
    full = curve.withColumns({"fn": F.col("_p") - F.col("tp"), "tn": F.col("_q") - F.col("fp")})
    return full.withColumns(metric_columns(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn"))).drop("_p", "_q")


def threshold_grid(df: DataFrame, metric: str = "f1", score: str = SCORE, label: str = LABEL) -> DataFrame:
    """Best of the grid thresholds, the first among equals."""
    curve = threshold_grid_curve(df, score, label)
    best = curve.agg(F.max(F.struct(F.col(metric).alias("v"), (-F.col("threshold")).alias("t"))).alias("_b"))
    return best.select((-F.col("_b.t")).alias("threshold"), F.col("_b.v").alias(metric))


def _counts(label: str, predicted: str) -> dict[str, Column]:
    y, p = F.col(label), F.col(predicted)
    return {
        "tn": F.count_if((y == 0) & (p == 0)),
        "fp": F.count_if((y == 0) & (p == 1)),
        "fn": F.count_if((y == 1) & (p == 0)),
        "tp": F.count_if((y == 1) & (p == 1)),
    }


def confusion_matrix(df: DataFrame, label: str = LABEL, predicted: str = PREDICTED, by: tuple[str, ...] = ()) -> DataFrame:
    return df.groupBy(*by).agg(*[c.alias(n) for n, c in _counts(label, predicted).items()])


def binary_metrics(df: DataFrame, label: str = LABEL, predicted: str = PREDICTED, by: tuple[str, ...] = ()) -> DataFrame:
    """Confusion matrix with accuracy, precision, recall and F1."""
    matrix = confusion_matrix(df, label, predicted, by)
    return matrix.withColumns(metric_columns(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")))


def curve_areas(df: DataFrame, score: str = SCORE, label: str = LABEL) -> DataFrame:
    """``auroc`` and ``average_precision`` from one pass over the grouped scores."""
    won = F.sum(F.col("_pos") * (F.col("tn") + F.col("_neg") / 2))
    pairs = F.max(F.col("_p").cast("double") * F.col("_q"))
    area = F.sum(F.col("_pos") * F.col("tp") / (F.col("tp") + F.col("fp")))
    total = F.max("_p")
    return grouped_scores(df, score, label).agg(
        F.coalesce(F.when(pairs > 0, won / pairs), F.lit(0.0)).alias("auroc"),
        F.coalesce(F.when(total > 0, area / total), F.lit(0.0)).alias("average_precision"),
    )


def auroc(df: DataFrame, score: str = SCORE, label: str = LABEL) -> DataFrame:
    """Probability that a positive outscores a negative, ties one half; 0 with one class."""
    return curve_areas(df, score, label).select("auroc")


def average_precision(df: DataFrame, score: str = SCORE, label: str = LABEL) -> DataFrame:
    """``sum (R_n - R_{n-1}) P_n`` over the distinct scores, 0 without positives."""
    return curve_areas(df, score, label).select("average_precision")


def point_adjustment(
    df: DataFrame, order: list[str], part: tuple[str, ...] = (), label: str = LABEL, predicted: str = PREDICTED,
    target: str = "adjusted", keep_first_row: bool = False,
) -> DataFrame:
    """A true segment with any hit counts as fully detected.

    Segments are runs of equal labels in order. ``keep_first_row`` leaves the very first row as predicted, as a
    backward walk that stops before row 0 does.
    """
    keys = list(part)
    cdf = chunked(df, keys, order)
    hit = with_run_max(cdf, keys, label, predicted, "_hit")
    whole = F.when(F.col(label) == 1, F.col("_hit")).otherwise(F.col(predicted))
    if keep_first_row:
        hit = with_index(hit, keys, "_at")
        whole = F.when(F.col("_at") == 0, F.col(predicted)).otherwise(whole)
    return plain(hit).select(*df.columns, whole.cast("int").alias(target))


def adjusted_metrics(adjusted: DataFrame, label: str = LABEL, predicted: str = PREDICTED, target: str = "adjusted") -> DataFrame:
    """Matrix and metrics after adjustment, with the number of rows the adjustment turned positive."""
    turned = F.count_if((F.col(target) == 1) & (F.col(predicted) == 0)).alias("turned_positive")
    counts = adjusted.agg(*[c.alias(n) for n, c in _counts(label, target).items()], turned)
    return counts.withColumns(metric_columns(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")))


def flatten_windows(windows: DataFrame, labels: str = "labels", scores: str = "scores", keep: tuple[str, ...] = ("window_id",)) -> DataFrame:
    """One row per timestep of every window; overlapping windows count a timestep more than once."""
    zipped = F.arrays_zip(F.col(labels).alias(LABEL), F.col(scores).alias(SCORE))
    exploded = windows.select(*keep, F.posexplode(zipped).alias("step", "_z"))
    return exploded.select(*keep, "step", F.col(f"_z.{LABEL}").alias(LABEL), F.col(f"_z.{SCORE}").alias(SCORE))


def score_window_labels(windows: DataFrame, threshold: float = 0.5, labels: str = "labels", scores: str = "scores") -> DataFrame:
    """Metrics of the flattened per-timestep scores at a threshold."""
    return binary_metrics(score_binary(flatten_windows(windows, labels, scores), threshold))


def evaluation(df: DataFrame, threshold: float, score: str = SCORE, label: str = LABEL) -> DataFrame:
    """All summary metrics of a scored table in one row."""
    predicted = score_binary(df, threshold, score)
    out = scalar_join(binary_metrics(predicted, label), curve_areas(df, score, label))
    return out.withColumn("threshold", F.lit(float(threshold)))
