"""Queries of the threshold curves and metrics."""

from pyspark.sql import functions as F

from voltlane.operators import metrics as op
from voltlane.operators import series
from voltlane.plans.ordering import settled
from voltlane.queries import fixtures as fx
from voltlane.queries.registry import query, rounded

_CURVE = f"""WITH {fx.SCORED}, per_score AS (SELECT score AS threshold, sum(label) AS p, sum(1 - label) AS q FROM scored GROUP BY score),
  run AS (SELECT *, sum(p) OVER w AS tp, sum(q) OVER w AS fp, sum(p) OVER () AS pp, sum(q) OVER () AS qq FROM per_score
    WINDOW w AS (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING)),
  curve AS (SELECT threshold, p, q, pp, qq, tp::DOUBLE AS tp, fp::DOUBLE AS fp, (pp - tp)::DOUBLE AS fn, (qq - fp)::DOUBLE AS tn,
    tp / (tp + fp)::DOUBLE AS precision, tp / pp::DOUBLE AS recall,
    2 * tp / (2 * tp + fp + pp - tp)::DOUBLE AS f1, (tp + qq - fp) / (pp + qq)::DOUBLE AS accuracy FROM run)"""


@query("score_binary", f"WITH {fx.SCORED} SELECT l_orderkey, l_linenumber, score, predicted FROM scored")
def score_binary(spark, d):
    rows = fx.scored(spark, d).select("l_orderkey", "l_linenumber", "score")
    return op.score_binary(rows)


@query("pr_curve", _CURVE + " SELECT threshold, round(precision, 6) AS precision, round(recall, 6) AS recall FROM curve")
def pr_curve(spark, d):
    out = op.pr_curve(fx.scored(spark, d))
    return out.withColumns({"precision": F.round("precision", 6), "recall": F.round("recall", 6)})


@query(
    "threshold_all_scores",
    _CURVE
    + " UNION ALL ".join(
        f" (SELECT '{m}' AS metric, threshold, round({m}, 6) AS best FROM curve ORDER BY {m} DESC, threshold LIMIT 1)" for m in op.METRICS
    ),
)
def threshold_all_scores(spark, d):
    curve = settled(op.threshold_curve(fx.scored(spark, d)))
    out = None
    for m in op.METRICS:
        one = op.best_threshold(curve, m).select(F.lit(m).alias("metric"), "threshold", F.round(m, 6).alias("best"))
        out = one if out is None else out.unionByName(one)
    return out


_GRID = ", ".join(f"({t!r}::DOUBLE)" for t in op.GRID)


@query(
    "threshold_grid",
    f"""WITH {fx.FEATURE_ROWS}, scored AS (SELECT l_quantity / 50 AS score, label FROM feature_rows),
    per_score AS (SELECT score, sum(label) AS p, sum(1 - label) AS q FROM scored GROUP BY score),
    curve AS (SELECT t AS threshold, coalesce(sum(p) FILTER (WHERE score >= t), 0) AS tp, coalesce(sum(q) FILTER (WHERE score >= t), 0) AS fp,
      sum(p) AS pp FROM per_score, (VALUES {_GRID}) g(t) GROUP BY t)
    SELECT threshold, round(2 * tp / (tp + fp + pp)::DOUBLE, 6) AS f1 FROM curve
    ORDER BY 2 * tp / (tp + fp + pp)::DOUBLE DESC, threshold LIMIT 1""",
)
def threshold_grid(spark, d):
    rows = fx.features(spark, d).select((F.col("l_quantity") / 50).alias("score"), "label")
    return op.threshold_grid(rows).withColumn("f1", F.round("f1", 6))


@query(
    "threshold_grid_curve",
    f"""WITH {fx.FEATURE_ROWS}, scored AS (SELECT l_quantity / 50 AS score, label FROM feature_rows),
    per_score AS (SELECT score, sum(label) AS p, sum(1 - label) AS q FROM scored GROUP BY score)
    SELECT t AS threshold, CAST(coalesce(sum(p) FILTER (WHERE score >= t), 0) AS BIGINT) AS tp,
      CAST(coalesce(sum(q) FILTER (WHERE score >= t), 0) AS BIGINT) AS fp FROM per_score, (VALUES {_GRID}) g(t) GROUP BY t""",
)
def threshold_grid_curve(spark, d):
    rows = fx.features(spark, d).select((F.col("l_quantity") / 50).alias("score"), "label")
    return op.threshold_grid_curve(rows).select("threshold", "tp", "fp")


@query(
    "threshold_pr_curve",
    _CURVE
    + """ SELECT threshold, round(2 * precision * recall / (precision + recall + 1e-10), 6) AS f1 FROM curve
    ORDER BY 2 * precision * recall / (precision + recall + 1e-10) DESC, threshold LIMIT 1""",
)
def threshold_pr_curve(spark, d):
    return op.threshold_pr_curve(fx.scored(spark, d)).withColumn("f1", F.round("f1", 6))


_MATRIX = """count(*) FILTER (WHERE label = 0 AND {p} = 0) AS tn, count(*) FILTER (WHERE label = 0 AND {p} = 1) AS fp,
  count(*) FILTER (WHERE label = 1 AND {p} = 0) AS fn, count(*) FILTER (WHERE label = 1 AND {p} = 1) AS tp"""
_FROM_MATRIX = """tn, fp, fn, tp, round((tp + tn) / (tp + tn + fp + fn)::DOUBLE, 6) AS accuracy,
  round(coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0), 6) AS recall,
  round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE, 0), 6) AS f1"""


@query("confusion_matrix", f"WITH {fx.SCORED} SELECT {_MATRIX.format(p='predicted')} FROM scored")
def confusion_matrix(spark, d):
    return op.confusion_matrix(fx.scored(spark, d))


@query(
    "binary_metrics",
    f"WITH {fx.SCORED}, m AS (SELECT {_MATRIX.format(p='predicted')} FROM scored) SELECT {_FROM_MATRIX} FROM m",
)
def binary_metrics(spark, d):
    return rounded(op.binary_metrics(fx.scored(spark, d)))


@query(
    "auroc", _CURVE + " SELECT round(sum(p * (tn + q / 2.0::DOUBLE)) / max(pp::DOUBLE * qq), 6) AS auroc FROM curve"
)
def auroc(spark, d):
    return rounded(op.auroc(fx.scored(spark, d)))


@query("average_precision", _CURVE + " SELECT round(sum(p / pp::DOUBLE * precision), 6) AS average_precision FROM curve")
def average_precision(spark, d):
    return rounded(op.average_precision(fx.scored(spark, d)))


_ADJUST = f"""WITH {fx.SCORED}, placed AS (SELECT *, row_number() OVER (ORDER BY {fx.SORT_SQL}) AS i FROM scored),
  flagged AS (SELECT *, CASE WHEN label = lag(label) OVER (ORDER BY i) THEN 0 ELSE 1 END AS fresh FROM placed),
  segments AS (SELECT *, sum(fresh) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) AS segment FROM flagged),
  adjusted AS (SELECT *, CASE WHEN label = 1 THEN max(predicted) OVER (PARTITION BY segment) ELSE predicted END AS adjusted FROM segments)"""


def _adjusted(spark, d):
    return op.point_adjustment(fx.scored(spark, d), fx.SORT)


@query(
    "point_adjustment",
    _ADJUST + " SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, label, predicted, CAST(adjusted AS INTEGER) AS adjusted FROM adjusted",
)
def point_adjustment(spark, d):
    return _adjusted(spark, d).select(*fx.ROW_KEY, "label", "predicted", "adjusted")


@query(
    "adjusted_metrics",
    _ADJUST
    + f""", m AS (SELECT {_MATRIX.format(p='adjusted')}, count(*) FILTER (WHERE adjusted = 1 AND predicted = 0) AS turned_positive
    FROM adjusted) SELECT {_FROM_MATRIX}, turned_positive FROM m""",
)
def adjusted_metrics(spark, d):
    return rounded(op.adjusted_metrics(_adjusted(spark, d)))


@query(
    "score_window_labels",
    f"""WITH {fx.SCORED}, placed AS (SELECT *, row_number() OVER (ORDER BY {fx.SORT_SQL}) - 1 AS idx, count(*) OVER () AS n FROM scored),
    starts AS (SELECT unnest(range(0, (SELECT CAST((count(*) - 60) // 20 + 1 AS BIGINT) FROM scored))) AS w),
    steps AS (SELECT CAST(p.label AS INTEGER) AS label, CAST(p.score::FLOAT >= 0.5 AS INTEGER) AS predicted
      FROM starts JOIN placed p ON p.idx >= w * 20 AND p.idx < w * 20 + 60),
    m AS (SELECT {_MATRIX.format(p='predicted')} FROM steps) SELECT {_FROM_MATRIX} FROM m""",
)
def score_window_labels(spark, d):
    windows = series.sequence_windows(fx.scored(spark, d), ["score"], fx.SORT, 60, 20, "label")
    scores = windows.withColumn("scores", F.transform("features", lambda x: x[0].cast("double")))
    return rounded(op.score_window_labels(scores))


@query(
    "evaluation",
    _CURVE
    + f""", m AS (SELECT {_MATRIX.format(p='predicted')} FROM scored)
    SELECT {_FROM_MATRIX}, 0.5::DOUBLE AS threshold,
      (SELECT round(sum(p * (tn + q / 2.0::DOUBLE)) / max(pp::DOUBLE * qq), 6) FROM curve) AS auroc,
      (SELECT round(sum(p / pp::DOUBLE * precision), 6) FROM curve) AS average_precision FROM m""",
)
def evaluation(spark, d):
    return rounded(op.evaluation(fx.scored(spark, d), 0.5))
