"""Queries of feature ranking, principal components, attributions and class separation."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from voltlane.operators import ranking as op
from voltlane.plans.joins import scalar_join
from voltlane.queries import fixtures as fx
from voltlane.queries.registry import query, rounded

_EDGES = ", ".join(f"quantile_cont(v, {i / 10}) AS e{i}" for i in range(1, 10))
_BIN = " + ".join(f"CAST(v > e{i} AS INTEGER)" for i in range(1, 10))


@query(
    "mutual_information",
    f"WITH {fx.FEATURE_ROWS}, long AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, label, {c} AS v FROM feature_rows" for c in fx.FEATURES)
    + f"""), edges AS (SELECT feature, {_EDGES} FROM long GROUP BY feature),
    binned AS (SELECT feature, label, {_BIN} AS bin FROM long JOIN edges USING (feature)),
    cells AS (SELECT feature, bin, label, count(*) AS n FROM binned GROUP BY ALL),
    terms AS (SELECT feature, n, sum(n) OVER (PARTITION BY feature) AS t, sum(n) OVER (PARTITION BY feature, bin) AS b,
      sum(n) OVER (PARTITION BY feature, label) AS c FROM cells),
    scores AS (SELECT feature, sum(n / t::DOUBLE * ln(n * t / (b * c)::DOUBLE)) AS mi FROM terms GROUP BY feature)
    SELECT feature, round(mi, 9) AS mutual_info, CAST(rank() OVER (ORDER BY mi DESC) AS INTEGER) AS rank FROM scores""",
)
def mutual_information(spark, d):
    return op.mutual_information(fx.features(spark, d), fx.FEATURES).withColumn("mutual_info", F.round("mutual_info", 9))


def _digamma(n: str) -> str:
    x = f"({n} + 10.0::DOUBLE)"
    back = " + ".join(f"1 / ({n} + {i}.0::DOUBLE)" for i in range(10))
    return f"(ln({x}) - 1 / (2 * {x}) - 1 / (12 * {x} ** 2) + 1 / (120 * {x} ** 4) - 1 / (252 * {x} ** 6) - ({back}))"


_NEAR = " UNION ALL ".join(
    f"SELECT feature, label, v, n, class_n, abs({side}(v, {i}) OVER w - v) AS d, {side}(v, {i}) OVER w AS far, {side}(n, {i}) OVER w AS copies FROM counted "
    "WINDOW w AS (PARTITION BY feature, label ORDER BY v)" for side in ("lag", "lead") for i in (1, 2, 3)
)


@query(
    "mutual_information_nearest",
    f"WITH {fx.FEATURE_ROWS}, long AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS feature, label, {c} AS v FROM feature_rows" for c in fx.FEATURES)
    + f"""), counted AS (SELECT *, CAST(sum(n) OVER (PARTITION BY feature, label) AS BIGINT) AS class_n
      FROM (SELECT feature, label, v::DOUBLE AS v, count(*) AS n FROM long GROUP BY ALL)),
    near AS (SELECT *, sum(copies) OVER (PARTITION BY feature, label, v ORDER BY d, far ROWS UNBOUNDED PRECEDING) AS upto
      FROM ({_NEAR}) WHERE far IS NOT NULL),
    far AS (SELECT feature, label, v, any_value(n) AS n, any_value(class_n) AS class_n,
      CASE WHEN any_value(n) > 3 THEN v ELSE arg_min(far, upto) FILTER (WHERE upto >= 4 - n) END AS far FROM near GROUP BY feature, label, v),
    bounds AS (SELECT *, CASE WHEN far < v THEN far ELSE v - (far - v) END AS low, CASE WHEN far > v THEN far ELSE v + (v - far) END AS high FROM far),
    line AS (SELECT feature, v, sum(n) OVER (PARTITION BY feature ORDER BY v) AS upto FROM (SELECT feature, v, sum(n) AS n FROM counted GROUP BY ALL)),
    a AS (SELECT b.*, coalesce(l.upto, 0) AS c_low FROM bounds b ASOF LEFT JOIN line l ON l.feature = b.feature AND b.low >= l.v),
    z AS (SELECT a.*, coalesce(l.upto, 0) AS c_high FROM a ASOF LEFT JOIN line l ON l.feature = a.feature AND a.high > l.v),
    own AS (SELECT feature, v, sum(n) AS n_all FROM counted GROUP BY ALL),
    m AS (SELECT z.*, CASE WHEN far = v THEN n_all ELSE c_high - c_low END AS m FROM z JOIN own USING (feature, v)),
    scores AS (SELECT feature, greatest(0, any_value(p) + {_digamma('3')} - sum(n * {_digamma('class_n')}) / sum(n) - sum(n * {_digamma('m')}) / sum(n)) AS mi
      FROM m JOIN (SELECT feature, {_digamma('sum(n)')} AS p FROM m GROUP BY feature) USING (feature) GROUP BY feature)
    SELECT feature, round(mi, 7) AS mutual_info, CAST(rank() OVER (ORDER BY mi DESC) AS INTEGER) AS rank FROM scores""",
)
def mutual_information_nearest(spark, d):
    return op.mutual_information_nearest(fx.features(spark, d), fx.FEATURES).withColumn("mutual_info", F.round("mutual_info", 7))


_METHODS = ["quantity", "price", "tax"]
_SCORES = """WITH parts AS (SELECT 'p' || l_partkey AS feature, sum(l_quantity) AS quantity, max(l_extendedprice) AS price,
    CASE WHEN l_partkey % 7 <> 0 THEN max(l_tax) END AS tax FROM lineitem GROUP BY l_partkey),
  scores AS (SELECT feature, 'quantity' AS method, quantity AS score FROM parts UNION ALL SELECT feature, 'price', price FROM parts
    UNION ALL SELECT feature, 'tax', tax FROM parts WHERE tax IS NOT NULL),
  ranked AS (SELECT *, rank() OVER (PARTITION BY method ORDER BY score DESC)
    + (count(*) OVER (PARTITION BY method, score) - 1) / 2.0 AS rank FROM scores),
  summary AS (SELECT feature, """ + ", ".join(
    f"max(score) FILTER (WHERE method = '{m}') AS {m}, max(rank) FILTER (WHERE method = '{m}') AS {m}_rank" for m in _METHODS
) + ", avg(rank) AS mean_rank FROM ranked GROUP BY feature)"


def _summary(spark, d):
    parts = (
        fx.table(spark, d, "lineitem")
        .groupBy("l_partkey")
        .agg(F.sum("l_quantity").alias("quantity"), F.max("l_extendedprice").alias("price"), F.max("l_tax").alias("tax"))
        .withColumn("tax", F.expr("if(l_partkey % 7 <> 0, tax, null)"))
        .withColumn("feature", F.concat(F.lit("p"), "l_partkey"))
    )
    return op.rank_and_mean_rank(parts.unpivot(["feature"], _METHODS, "method", "score"), _METHODS)


@query(
    "rank_and_mean_rank",
    _SCORES
    + " SELECT feature, "
    + ", ".join(f"{m}, {m}_rank::DOUBLE AS {m}_rank" for m in _METHODS)
    + ", round(mean_rank, 6) AS mean_rank FROM summary",
)
def rank_and_mean_rank(spark, d):
    return _summary(spark, d).withColumn("mean_rank", F.round("mean_rank", 6))


@query(
    "normalised_importance",
    _SCORES
    + ", best AS (SELECT * FROM summary ORDER BY mean_rank, feature LIMIT 15) "
    + " UNION ALL ".join(
        f"SELECT feature, '{m}' AS method, {m} AS importance, round({m} / (SELECT max({m}) FROM best), 6) AS normalised FROM best WHERE {m} IS NOT NULL"
        for m in _METHODS
    ),
)
def normalised_importance(spark, d):
    return op.normalised_importance(_summary(spark, d), _METHODS).withColumn("normalised", F.round("normalised", 6))


# the sum of squared shares of the components is that of the squared correlations over the squared number of features
_SQUARES = " + ".join(f"corr({a}, {b}) ** 2" for a in fx.FEATURES for b in fx.FEATURES)
_COMPONENTS = f"SELECT unnest(range(1, {len(fx.FEATURES) + 1}))::INTEGER AS component"


@query(
    "standardised_pca_variance",
    f"""WITH {fx.FEATURE_ROWS} SELECT component, 1.0::DOUBLE AS total, TRUE AS ordered,
    (SELECT round(({_SQUARES}) / {len(fx.FEATURES) ** 2}, 6) FROM feature_rows) AS squares FROM ({_COMPONENTS})""",
)
def standardised_pca_variance(spark, d):
    found = op.standardised_pca_variance(fx.features(spark, d), fx.FEATURES)
    every = Window.partitionBy()  # one row per component
    ordered = F.col("ratio") <= F.coalesce(F.lag("ratio").over(Window.orderBy("component")), F.lit(1.0))
    return rounded(
        found.select("component", F.max("cumulative").over(every).alias("total"), ordered.alias("ordered"), F.sum(F.col("ratio") ** 2).over(every).alias("squares"))
    )


_CORRELATIONS = "[" + ", ".join("[" + ", ".join("1.0::DOUBLE" if a == b else f"corr({a}, {b})" for b in fx.FEATURES) + "]" for a in fx.FEATURES) + "]"
_N = len(fx.FEATURES)

# eigenvalues by power iteration: 300 steps for the largest, whose part is then taken out of the matrix, and so on
_COMPONENT_COUNT = f"""WITH RECURSIVE {fx.FEATURE_ROWS}, steps AS (
  SELECT 0 AS step, {_CORRELATIONS} AS r, list_transform(range({_N}), lambda i: 1.0::DOUBLE / (i + 1)) AS v, []::DOUBLE[] AS found FROM feature_rows
  UNION ALL
  SELECT step + 1,
    CASE WHEN (step + 1) % 300 = 0 THEN list_transform(range(1, {_N + 1}), lambda i: list_transform(range(1, {_N + 1}),
      lambda j: r[i][j] - list_inner_product(v, w) * v[i] * v[j])) ELSE r END,
    CASE WHEN (step + 1) % 300 = 0 THEN list_transform(range({_N}), lambda i: 1.0::DOUBLE / (i + 1))
      ELSE list_transform(w, lambda x: x / sqrt(list_inner_product(w, w))) END,
    CASE WHEN (step + 1) % 300 = 0 THEN list_append(found, list_inner_product(v, w)) ELSE found END
  FROM (SELECT *, list_transform(r, lambda row: list_inner_product(row, v)) AS w FROM steps) WHERE step < 300 * {_N})
SELECT greatest(2, (SELECT min(k) FROM range(1, {_N + 1}) t(k) WHERE list_sum(found[1:k]) / {_N} >= 0.95 - 1e-9))::INTEGER AS components
FROM steps WHERE step = 300 * {_N}"""


@query("pca_component_count", _COMPONENT_COUNT)
def pca_component_count(spark, d):
    """Of 95 % of the variance."""
    return op.pca_component_count(op.standardised_pca_variance(fx.features(spark, d), fx.FEATURES), share=0.95, at_least=2)


# loadings are correlations of features and components: times their transpose they give the correlation matrix
@query(
    "pca_loadings",
    f"WITH {fx.FEATURE_ROWS} "
    + " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 4) + 0.0 AS product FROM feature_rows" for a in fx.FEATURES for b in fx.FEATURES if a <= b
    ),
)
def pca_loadings(spark, d):
    loadings = op.pca_loadings(fx.features(spark, d), fx.FEATURES)
    n = fx.features(spark, d).agg(F.count(F.lit(1)).alias("n"))
    left, right = (loadings.select(F.col("feature").alias(x), "component", F.col("loading").alias(f"l{x}")) for x in "ab")
    products = left.join(right, "component").where("a <= b").groupBy("a", "b").agg(F.sum(F.col("la") * F.col("lb")).alias("p"))
    # the features are scaled by the deviation of the rows, the variances are those of a sample
    return scalar_join(products, n).select("a", "b", (F.round(F.col("p") * (F.col("n") - 1) / F.col("n"), 4) + 0.0).alias("product"))


@query(
    "pca_scores",
    f"WITH {fx.FEATURE_ROWS} SELECT count(*) AS rows, 0.0::DOUBLE AS mean_1, 0.0::DOUBLE AS mean_2, 0.0::DOUBLE AS covariance, TRUE AS ordered FROM feature_rows",
)
def pca_scores(spark, d):
    scores = op.pca_scores(fx.features(spark, d), fx.FEATURES, 2, [*fx.ROW_KEY, "ts", "label"])
    zero = lambda c: F.abs(F.round(c, 6))
    return scores.agg(
        F.count(F.lit(1)).alias("rows"), zero(F.avg("PC1")).alias("mean_1"), zero(F.avg("PC2")).alias("mean_2"),
        zero(F.covar_pop("PC1", "PC2")).alias("covariance"), (F.var_pop("PC1") >= F.var_pop("PC2")).alias("ordered"),
    )


WEIGHTS = {"l_quantity": 0.02, "l_extendedprice": -0.00001, "l_discount": 3.5, "l_tax": -2.0}
_ATTR = f"WITH {fx.FEATURE_ROWS}, attr AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, " + ", ".join(
    f"{w} * ({f} - (SELECT avg({f}) FROM feature_rows)) AS {f}_contribution" for f, w in WEIGHTS.items()
) + " FROM feature_rows)"


def _attributions(spark, d):
    return op.linear_attributions(fx.features(spark, d), WEIGHTS)


@query(
    "linear_attributions",
    _ATTR + " SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, " + ", ".join(f"round({f}_contribution, 8) AS {f}_contribution" for f in WEIGHTS) + " FROM attr",
)
def linear_attributions(spark, d):
    return rounded(_attributions(spark, d).select(*fx.ROW_KEY, *[f"{f}_contribution" for f in WEIGHTS]), 8)


@query(
    "attribution_importance",
    _ATTR
    + ", scores AS ("
    + " UNION ALL ".join(f"SELECT '{f}' AS feature, avg(abs({f}_contribution)) AS importance FROM attr" for f in WEIGHTS)
    + ") SELECT feature, round(importance, 6) AS importance, CAST(rank() OVER (ORDER BY importance DESC) AS INTEGER) AS rank FROM scores",
)
def attribution_importance(spark, d):
    return rounded(op.attribution_importance(_attributions(spark, d), list(WEIGHTS)))


_TOTAL = " + ".join(f"{f}_contribution" for f in WEIGHTS)


@query(
    "attribution_extremes",
    _ATTR
    + f""" (SELECT l_orderkey, l_linenumber, round(0.25 + {_TOTAL}, 6) AS output, 'highest' AS side FROM attr
      ORDER BY 0.25 + {_TOTAL} DESC LIMIT 1) UNION ALL
    (SELECT l_orderkey, l_linenumber, round(0.25 + {_TOTAL}, 6), 'lowest' FROM attr ORDER BY 0.25 + {_TOTAL} LIMIT 1)""",
)
def attribution_extremes(spark, d):
    out = op.attribution_extremes(_attributions(spark, d), list(WEIGHTS), fx.ROW_KEY, 0.25)
    return rounded(out.select("l_orderkey", "l_linenumber", "output", "side"))


_SILHOUETTE = """WITH points AS (SELECT vec_id, CAST(label = 0 AS INTEGER) AS label, embedding::DOUBLE[] AS x FROM embeddings),
  sums AS (SELECT p.vec_id, p.label, q.label AS other, avg({d}) AS m FROM points p JOIN points q ON p.vec_id <> q.vec_id GROUP BY ALL),
  per_row AS (SELECT vec_id, max(m) FILTER (WHERE label = other) AS a, min(m) FILTER (WHERE label <> other) AS b FROM sums GROUP BY vec_id)
  SELECT round(avg((b - a) / greatest(a, b)), 6) AS silhouette, count(*) AS rows FROM per_row"""


def _points(spark, d):
    return fx.table(spark, d, "embeddings").select("vec_id", "embedding", (F.col("label") == 0).cast("int").alias("label"))


@query("silhouette_by_label", _SILHOUETTE.format(d="list_distance(p.x, q.x)"))
def silhouette_by_label(spark, d):
    return rounded(op.silhouette_by_label(_points(spark, d), "vec_id", "embedding"))


_EXACT = _SILHOUETTE.format(d="list_distance(p.x, q.x)")


@query("silhouette_sampled", f"SELECT silhouette, rows, TRUE AS holds, TRUE AS narrow FROM ({_EXACT})")
def silhouette_sampled(spark, d):
    """The exact value lies in the interval that a sample of some forty rows a class gives; a draw of all rows is exact."""
    points = _points(spark, d)
    exact = op.silhouette_sampled(points, "vec_id", "embedding", per_class=1 << 40).select(F.round("silhouette", 6).alias("silhouette"), "rows")
    sample = op.silhouette_sampled(points, "vec_id", "embedding", per_class=40)
    both = scalar_join(exact, sample.select("low", "high"))
    holds = (F.col("silhouette") >= F.col("low")) & (F.col("silhouette") <= F.col("high"))
    return both.select("silhouette", "rows", holds.alias("holds"), (F.col("high") - F.col("low") < 0.2).alias("narrow"))


@query("silhouette_squared", _SILHOUETTE.format(d="list_distance(p.x, q.x) ** 2"))
def silhouette_squared(spark, d):
    return rounded(op.silhouette_squared(_points(spark, d), "vec_id", "embedding"))
