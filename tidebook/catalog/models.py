"""Features, models and their evaluation."""

from __future__ import annotations

import math

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidebook.catalog.registry import as_double, as_long, dbl, query
from tidebook.catalog.reports import IRIS, IRIS_SQL, TAX, iris
from tidebook.models import classifiers, lloyd, logit, regression, saved
from tidebook.models import text as text_models
from tidebook.models import trees as tree_models
from tidebook.operators import aggregates, clean, sampling
from tidebook.plans import churn
from tidebook.session import materialize, shared_dir, spread

LINE = ["l_quantity", "l_discount", "l_tax"]
CHURN = ["worker_count", "fss_count", "pfr_count", "fns_count", "documents_count", "cnt_users", "has_certificate", *churn.TAX_CLASSES]


def _churn(t):
    return spread(materialize(churn.churn_features(t.fx_companies, TAX), "churn"), "churn")


@query("assemble_features", f"SELECT vec_id, {', '.join(f'CAST(embedding[{i + 1}] AS DOUBLE) AS f{i}' for i in range(len(IRIS)))}, 1.0::DOUBLE AS one FROM embeddings")
def _(t):
    vectors = regression.assemble(iris(t).withColumn("one", F.lit(1.0)), [*IRIS, "one"])
    cells = vectors.select("vec_id", vector_to_array("features").alias("cells"))
    return cells.select("vec_id", *[F.col("cells")[i].alias(f"f{i}") for i in range(len(IRIS))], F.col("cells")[len(IRIS)].alias("one"))


@query("factorize", """
WITH f AS (SELECT o_orderpriority AS c, MIN(o_orderkey) AS k FROM orders GROUP BY 1), n AS (SELECT c, row_number() OVER (ORDER BY k) - 1 AS code FROM f)
SELECT o_orderkey, code FROM orders JOIN n ON c = o_orderpriority""")
def _(t):
    return clean.factorize(t.orders, "o_orderpriority", "o_orderkey", "code").select("o_orderkey", "code")


@query("one_hot", """
SELECT c_custkey, CAST(c_mktsegment = 'BUILDING' AS INT) AS building, CAST(c_mktsegment = 'MACHINERY' AS INT) AS machinery, CAST(c_mktsegment = 'FURNITURE' AS INT) AS furniture FROM customer""")
def _(t):
    return clean.one_hot(t.customer, "c_mktsegment", {v.lower(): v for v in ("BUILDING", "MACHINERY", "FURNITURE")}).select(
        "c_custkey", "building", "machinery", "furniture")


@query("minmax_scale", """
WITH s AS (SELECT MIN(o_totalprice) AS lo, MAX(o_totalprice) AS hi FROM orders WHERE o_orderstatus = 'F')
SELECT o_orderkey, ROUND((o_totalprice - lo) / (hi - lo), 6) AS o_totalprice FROM orders CROSS JOIN s""")
def _(t):
    rows = t.orders.select("o_orderkey", "o_totalprice")
    return as_double(clean.minmax(rows, ["o_totalprice"], fitted_on=t.orders.where("o_orderstatus = 'F'")))


@query("standardize", """
WITH s AS (SELECT AVG(o_totalprice) AS m, STDDEV_POP(o_totalprice) AS s FROM orders) SELECT o_orderkey, ROUND((o_totalprice - m) / s, 6) AS o_totalprice FROM orders CROSS JOIN s""")
def _(t):
    return as_double(clean.standardize(t.orders.select("o_orderkey", "o_totalprice"), ["o_totalprice"]))


@query("poly_features", f"""
WITH v AS ({IRIS_SQL})
SELECT vec_id, {", ".join(f"ROUND({a} * {b}, 6) AS {a}_{b}" for a, b in zip(IRIS, IRIS[1:]))}, {", ".join(f"ROUND({a} * {a}, 6) AS {a}_{a}" for a in IRIS)} FROM v""")
def _(t):
    """Products of neighbouring features and all squares."""
    pairs = [*zip(IRIS, IRIS[1:]), *zip(IRIS, IRIS)]
    return as_double(iris(t).select("vec_id", *[(F.col(a) * F.col(b)).alias(f"{a}_{b}") for a, b in pairs]))


# Two-feature least squares solved from the covariances; {pen} is added to the diagonal.
TWO_FEATURE_SQL = """
WITH d AS ({rows}),
s AS (SELECT COUNT(*) AS n, AVG(a) AS ma, AVG(b) AS mb, AVG(y) AS my, covar_pop(a, a) * COUNT(*) + {pen} AS aa, covar_pop(b, b) * COUNT(*) + {pen} AS bb,
  covar_pop(a, b) * COUNT(*) AS ab, covar_pop(a, y) * COUNT(*) AS ay, covar_pop(b, y) * COUNT(*) AS by_ FROM d),
w AS (SELECT *, (bb * ay - ab * by_) / (aa * bb - ab * ab) AS wa, (aa * by_ - ab * ay) / (aa * bb - ab * ab) AS wb FROM s)
SELECT '{fa}' AS feature, ROUND(wa, 4) AS weight FROM w UNION ALL SELECT '{fb}', ROUND(wb, 4) FROM w UNION ALL SELECT 'intercept', ROUND(my - wa * ma - wb * mb, 4) FROM w"""


@query("linear_regression", TWO_FEATURE_SQL.format(
    rows="SELECT l_quantity AS a, l_tax AS b, l_extendedprice / 1000 AS y FROM lineitem", pen=0, fa="l_quantity", fb="l_tax"))
def _(t):
    rows = t.lineitem.withColumn("target", F.col("l_extendedprice") / 1000)
    return as_double(regression.coefficients(regression.linear(rows, ["l_quantity", "l_tax"], "target"), ["l_quantity", "l_tax"], rows), 4)


# One feature: the weight is the covariance shrunk by alpha, over the variance.
LASSO_FIT = "sign(covar_pop(x, y)) * greatest(abs(covar_pop(x, y)) - {alpha}, 0) / var_pop(x)"


@query("lasso_one_feature", f"""
WITH d AS (SELECT l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem), w AS (SELECT {LASSO_FIT.format(alpha=5.0)} AS w, AVG(x) AS mx, AVG(y) AS my FROM d)
SELECT 'l_quantity' AS feature, ROUND(w, 4) AS weight FROM w UNION ALL SELECT 'intercept', ROUND(my - w * mx, 4) FROM w""")
def _(t):
    rows = t.lineitem.withColumn("target", F.col("l_extendedprice") / 1000)
    return as_double(regression.coefficients(regression.lasso(rows, ["l_quantity"], "target", 5.0), ["l_quantity"], rows), 4)


PRICES = f"SELECT l_orderkey, {', '.join(f'{c}::DOUBLE AS x{i}' for i, c in enumerate(LINE))}, l_extendedprice / 1000 AS y FROM lineitem"


def descent_sql(moments: str, alpha: str, steps: int = 60) -> str:
    """``w`` has the weights after some rounds of coordinate descent from ``moments`` (columns key, m0.., c00.., c0y..), whatever the number of keys."""
    p = range(len(LINE))

    def step(i: int, w: list[str]) -> str:
        rest = f"(c{i}y" + "".join(f" - c{min(i, j)}{max(i, j)} * {w[j]}" for j in p if j != i) + ")"
        return f"sign({rest}) * greatest(abs({rest}) - {alpha}, 0) / c{i}{i}"

    new = ["v0", "v1", "v2"]
    keep = ", ".join(["key", "alpha", "my", *(f"m{i}" for i in p), *(f"c{i}{j}" for i in p for j in p if i <= j), *(f"c{i}y" for i in p)])
    return f"""
w AS (
  SELECT 0 AS step, {keep}, {", ".join(f"0.0::DOUBLE AS w{i}" for i in p)} FROM {moments}
  UNION ALL
  SELECT step + 1, {keep}, v0, v1, {step(2, new)} FROM (
    SELECT *, {step(1, ["v0", "v1", "w2"])} AS v1 FROM (SELECT *, {step(0, ["w0", "w1", "w2"])} AS v0 FROM w WHERE step < {steps}))
), fit AS (SELECT *, my - (m0 * w0 + m1 * w1 + m2 * w2) AS intercept FROM w WHERE step = {steps})"""


MOMENTS = ", ".join(["AVG(y) AS my", *(f"AVG(x{i}) AS m{i}, covar_pop(x{i}, y) AS c{i}y" for i in range(3)), *(f"covar_pop(x{i}, x{j}) AS c{i}{j}" for i in range(3) for j in range(i, 3))])
LASSO_SQL = f"""WITH RECURSIVE d AS ({PRICES}), mom AS (SELECT 0 AS key, {{alpha}}::DOUBLE AS alpha, {MOMENTS} FROM d), {descent_sql("mom", "alpha")}"""


@query("lasso", LASSO_SQL.format(alpha=0.001) + " UNION ALL ".join(f" SELECT '{c}' AS feature, ROUND(w{i}, 4) AS weight FROM fit" for i, c in enumerate(LINE)) + " UNION ALL SELECT 'intercept', ROUND(intercept, 4) FROM fit")
def _(t):
    rows = t.lineitem.withColumn("target", F.col("l_extendedprice") / 1000)
    return as_double(regression.coefficients(regression.lasso(rows, LINE, "target", 0.001), LINE, rows), 4)


@query("lasso_optimality", LASSO_SQL.format(alpha=0.05) + " UNION ALL ".join(f" SELECT '{c}' AS feature, w{i} != 0 AS active, true AS optimal FROM fit" for i, c in enumerate(LINE)))
def _(t):
    rows = t.lineitem.withColumn("target", F.col("l_extendedprice") / 1000)
    model = regression.lasso(rows, LINE, "target", 0.05)
    return regression.subgradients(rows, LINE, "target", 0.05, model).select("feature", "active", (F.col("excess") < 1e-6).alias("optimal"))


def cg_sql(rows: str, p: int, penalty: float) -> str:
    """Least squares with a penalty by conjugate gradients over lists, from ``rows(x, y)``: ``last`` has the weights w, ``m`` the means mx and my.

    a is the penalised matrix, r what is left, p the direction.
    """
    places = f"(SELECT unnest(range(1, {p + 1})) AS {{}})"
    return f"""
WITH RECURSIVE d AS ({rows}),
m AS MATERIALIZED (SELECT list(m ORDER BY i) AS mx, any_value(my) AS my FROM (SELECT i, AVG(x[i]) AS m, AVG(y) AS my FROM d CROSS JOIN {places.format("i")} GROUP BY i)),
c AS (SELECT i, j, covar_pop(x[i], x[j]) * COUNT(*) + CASE WHEN i = j THEN {penalty} ELSE 0.0 END AS v, covar_pop(x[i], y) * COUNT(*) AS b
      FROM d CROSS JOIN {places.format("i")} CROSS JOIN {places.format("j")} GROUP BY i, j),
a AS MATERIALIZED (SELECT list(row ORDER BY i) AS a, list(b ORDER BY i) AS b FROM (SELECT i, list(v ORDER BY j) AS row, any_value(b) AS b FROM c GROUP BY i)),
cg AS (
  SELECT 0 AS step, list_transform(b, lambda v: 0.0::DOUBLE) AS w, b AS r, b AS p FROM a
  UNION ALL
  SELECT step + 1, w2, r2, list_transform(r2, lambda v, i: v + list_dot_product(r2, r2) / nullif(rr, 0) * p[i]) FROM (
    SELECT step, p, rr, list_transform(w, lambda v, i: v + rr / nullif(pap, 0) * p[i]) AS w2, list_transform(r, lambda v, i: v - rr / nullif(pap, 0) * ap[i]) AS r2 FROM (
      SELECT step, w, r, p, ap, list_dot_product(r, r) AS rr, list_dot_product(p, ap) AS pap FROM (
        SELECT cg.*, list_transform(a.a, lambda row: list_dot_product(row, p)) AS ap FROM cg CROSS JOIN a WHERE step < {2 * p} AND list_dot_product(r, r) > 1e-22)))
), last AS (SELECT w FROM cg ORDER BY step DESC LIMIT 1)"""


RIDGE_ROWS = f"SELECT [{', '.join(f'embedding[{i + 1}]::DOUBLE' for i in range(len(IRIS)))}] AS x, CASE WHEN label < 5 THEN 1.0 ELSE -1.0 END::DOUBLE AS y FROM embeddings"
RIDGE_SQL = cg_sql(RIDGE_ROWS, len(IRIS), 1.0) + f"""
SELECT 'x' || (i - 1) AS feature, ROUND(w[i], 4) + 0.0 AS weight FROM last CROSS JOIN (SELECT unnest(range(1, {len(IRIS) + 1})) AS i)
UNION ALL SELECT 'intercept', ROUND(my - list_dot_product(w, mx), 4) + 0.0 FROM last CROSS JOIN m"""


@query("ridge_classifier", RIDGE_SQL)
def _(t):
    rows = iris(t).withColumn("low", (F.col("label") < 5).cast("int"))
    out = as_double(regression.coefficients(regression.ridge_classifier(rows, IRIS, "low"), IRIS, rows), 4)
    return out.withColumn("weight", F.col("weight") + 0.0)


def _iris_split(t):
    cells = t.embeddings.select("vec_id", F.col("label").cast("double").alias("label"), *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(64)])
    rows = materialize(cells, "iris")
    return sampling.split(regression.assemble(rows, [f"x{i}" for i in range(64)]), 0.3, 7, "vec_id")


def _scored(model, train, test, label):
    def part(name, df):
        return model.transform(df).agg(F.lit(name).alias("part"), F.round(classifiers.accuracy(df, label), 6).alias("accuracy"), F.count(F.lit(1)).alias("cnt"))

    return part("train", train).union(part("test", test))


@query("logistic_ml")
def _(t):
    train, test = _iris_split(t)
    return _scored(classifiers.logistic("label", train.count()).fit(train), train, test, "label")


@query("decision_tree_ml")
def _(t):
    train, test = _iris_split(t)
    return _scored(classifiers.decision_tree("label").fit(train), train, test, "label")


@query("bagging_trees_ml")
def _(t):
    train, test = sampling.split(regression.assemble(_churn(t), CHURN), 0.3, 7, "id")
    return _scored(classifiers.bagged_trees("is_prolong").fit(train), train, test, "is_prolong")


@query("random_forest_ml")
def _(t):
    train, test = sampling.split(regression.assemble(_churn(t), CHURN), 0.3, 7, "id")
    return _scored(classifiers.random_forest("is_prolong").fit(train), train, test, "is_prolong")


@query("kmeans_ml")
def _(t):
    columns = ["worker_count", "fss_count", "pfr_count", "fns_count", "has_certificate", "documents_count", "cnt_users"]
    groups = classifiers.kmeans_groups(_churn(t).where("is_prolong = 0"), columns)
    return as_double(groups.groupBy("cluster").agg(F.count(F.lit(1)).alias("cnt"), *[F.avg(c).alias(c) for c in columns]))


COMPANIES = "SELECT id, is_prolong AS y, {columns} FROM fx_companies WHERE regdt IS NOT NULL"


def _companies(t):
    return spread(t.fx_companies.where("regdt IS NOT NULL"), "companies")


def logit_sql(rows: str, a: str, b: str, penalty: float = 1.0, steps: int = 25) -> str:
    """Newton steps on two features ``a``, ``b`` and an intercept, each solved by cofactors."""
    c = {"00": "saa * sbb - sab * sab", "0a": "sab * s0b - s0a * sbb", "0b": "s0a * sab - saa * s0b", "aa": "s00 * sbb - s0b * s0b", "ab": "s0a * s0b - s00 * sab", "bb": "s00 * saa - s0a * s0a"}
    det = f"(s00 * ({c['00']}) + s0a * ({c['0a']}) + s0b * ({c['0b']}))"
    return f"""
WITH RECURSIVE d AS ({rows}), s AS (
  SELECT 0 AS step, 0.0::DOUBLE AS w0, 0.0::DOUBLE AS wa, 0.0::DOUBLE AS wb
  UNION ALL
  SELECT step + 1, w0 - (({c['00']}) * g0 + ({c['0a']}) * ga + ({c['0b']}) * gb) / {det}, wa - (({c['0a']}) * g0 + ({c['aa']}) * ga + ({c['ab']}) * gb) / {det}, wb - (({c['0b']}) * g0 + ({c['ab']}) * ga + ({c['bb']}) * gb) / {det}
  FROM (
    SELECT step, w0, wa, wb, SUM(q - y) AS g0, SUM((q - y) * a) + {penalty} * wa AS ga, SUM((q - y) * b) + {penalty} * wb AS gb,
      SUM(v) AS s00, SUM(v * a) AS s0a, SUM(v * b) AS s0b, SUM(v * a * a) + {penalty} AS saa, SUM(v * a * b) AS sab, SUM(v * b * b) + {penalty} AS sbb
    FROM (SELECT *, q * (1 - q) AS v FROM (SELECT s.*, d.*, 1 / (1 + exp(-(w0 + wa * a + wb * b))) AS q FROM s CROSS JOIN d WHERE step < {steps})) GROUP BY step, w0, wa, wb)
)
SELECT '{a}' AS feature, ROUND(wa, 6) AS weight FROM s WHERE step = {steps} UNION ALL SELECT '{b}', ROUND(wb, 6) FROM s WHERE step = {steps} UNION ALL SELECT 'intercept', ROUND(w0, 6) FROM s WHERE step = {steps}"""


@query("logistic", logit_sql(COMPANIES.format(columns="documents_count::DOUBLE AS a, worker_count::DOUBLE AS b"), "documents_count", "worker_count"))
def _(t):
    rows = _companies(t)
    return as_double(logit.fit(rows, ["documents_count", "worker_count"], "is_prolong").table(rows))


GROUPED = ["worker_count", "fss_count", "pfr_count", "fns_count", "has_certificate", "documents_count", "cnt_users"]


def lloyd_sql(rows: str, columns: list[str], k: int, rounds: int, seed: int = 1) -> str:
    """Lloyd rounds over lists; centres are a list of points, numbered from 1."""
    z = ", ".join(f"({c} - m_{c}) / CASE WHEN s_{c} = 0 THEN 1 ELSE s_{c} END" for c in columns)
    gap = f"round(list_sum(list_transform(range(1, {len(columns) + 1}), lambda i: (z[i] - c[i]) * (z[i] - c[i]))), 9)"
    gaps = f"list_transform(centres, lambda c: {gap})"
    return f"""
WITH RECURSIVE d AS ({rows}), m AS (SELECT {", ".join(f"AVG({c}) AS m_{c}, STDDEV_POP({c}) AS s_{c}" for c in columns)} FROM d),
p AS MATERIALIZED (SELECT md5('{seed}|' || id) AS h, d.*, [{z}] AS z FROM d CROSS JOIN m),
start AS (
  SELECT 1 AS n, [(SELECT arg_min(z, h) FROM p)] AS centres
  UNION ALL
  SELECT n + 1, list_append(any_value(centres), arg_max(z, (list_min({gaps}), h))) FROM start CROSS JOIN p WHERE n < {k} GROUP BY n
), moves AS (
  SELECT 0 AS step, centres FROM start WHERE n = {k}
  UNION ALL
  SELECT step + 1, list_transform(range(1, {k + 1}), lambda i: coalesce(list_filter(news, lambda x: x.c = i)[1].z, centres[i])) FROM (
    SELECT step, any_value(centres) AS centres, list({{'c': c, 'z': z}}) AS news FROM (
      SELECT step, any_value(centres) AS centres, c, [{", ".join(f"AVG(z[{i}])" for i in range(1, len(columns) + 1))}] AS z
      FROM (SELECT step, centres, z, list_position({gaps}, list_min({gaps})) AS c FROM moves CROSS JOIN p WHERE step < {rounds}) GROUP BY step, c) GROUP BY step)
), last AS (SELECT centres FROM moves WHERE step = {rounds})
SELECT (list_position({gaps}, list_min({gaps})) - 1)::INT AS cluster, COUNT(*) AS cnt, {", ".join(f"ROUND(AVG({c}), 6) AS {c}" for c in columns)} FROM p CROSS JOIN last GROUP BY 1"""


@query("kmeans", lloyd_sql(f"SELECT id, {', '.join(GROUPED)} FROM fx_companies WHERE regdt IS NOT NULL AND is_prolong = 0", GROUPED, 4, 60))
def _(t):
    rows = _companies(t).where("is_prolong = 0")
    return as_double(lloyd.summary(rows, lloyd.fit(rows, GROUPED, "id", 4, 60)))


def tree_sql(features: list[str], trees: int, depth: int, min_leaf: int, sampled: bool = False, per_node: int | None = None, seed: int = 1) -> str:
    """Common table expressions that try every value of every feature as a cut, level by level: ``n{depth}`` has every row's leaf, ``s{l}`` the cuts of a level."""
    word = f"substr(md5('{seed}|' || tree || '|' || id), 1, 8)"
    drawn = " + ".join(f"({word} >= '{b}')::INT" for b in tree_models.poisson_bounds()) if sampled else "1"
    few = f"list_position(list_sort(list_transform(range(0, {len(features)}), lambda g: md5('{seed}|' || tree || '|' || node || '|' || g))), md5('{seed}|' || tree || '|' || node || '|' || f)) <= {per_node}" if per_node else "true"
    out = [f"""d AS ({COMPANIES.format(columns="[" + ", ".join(f"{f}::DOUBLE" for f in features) + "] AS x")}),
n0 AS MATERIALIZED (SELECT id, y, x, tree, ({drawn})::BIGINT AS w, 1 AS node FROM d CROSS JOIN (SELECT unnest(range(0, {trees})) AS tree))"""]
    for i in range(depth):
        out.append(f"""u{i} AS (SELECT tree, node, f, v, SUM(w)::BIGINT AS n, SUM(w * y)::BIGINT AS p FROM (SELECT *, x[f + 1] AS v FROM (SELECT *, unnest(range(0, {len(features)})) AS f FROM n{i} WHERE w > 0)) WHERE {few} GROUP BY tree, node, f, v),
c{i} AS (SELECT *, SUM(n) OVER o AS nl, SUM(p) OVER o AS pl, SUM(n) OVER a AS nt, SUM(p) OVER a AS pt FROM u{i} WINDOW a AS (PARTITION BY tree, node, f), o AS (PARTITION BY tree, node, f ORDER BY v)),
s{i} AS MATERIALIZED (SELECT tree, node, f, v FROM (SELECT *, ((nl - pl) * (nl - pl) + pl * pl)::DOUBLE / nl + ((nt - nl - pt + pl) * (nt - nl - pt + pl) + (pt - pl) * (pt - pl))::DOUBLE / nullif(nt - nl, 0) AS score,
    ((nt - pt) * (nt - pt) + pt * pt)::DOUBLE / nt AS whole FROM c{i}) WHERE nl >= {min_leaf} AND nt - nl >= {min_leaf} AND score > whole * (1 + 1e-12)
  QUALIFY row_number() OVER (PARTITION BY tree, node ORDER BY score DESC, f, v) = 1),
n{i + 1} AS MATERIALIZED (SELECT n.* EXCLUDE (node), CASE WHEN s.f IS NULL THEN n.node ELSE 2 * n.node + (x[s.f + 1] > s.v)::INT END AS node FROM n{i} n LEFT JOIN s{i} s ON s.tree = n.tree AND s.node = n.node)""")
    return "WITH " + ",\n".join(out)


def nodes_sql(features: list[str], depth: int, **options) -> str:
    cuts = " UNION ALL ".join(f"SELECT * FROM s{i}" for i in range(depth))
    return tree_sql(features, depth=depth, **options) + f""",
part AS (SELECT tree, node, SUM(w) AS n, SUM(w * y) AS p FROM (SELECT tree, w, y, unnest(list_filter(list_transform(range(0, {depth + 1}), lambda k: node >> k), lambda m: m > 0)) AS node FROM n{depth} WHERE w > 0) GROUP BY tree, node),
cuts AS (SELECT DISTINCT * FROM ({cuts}))
SELECT part.tree::INT AS tree, part.node::INT AS node, [{", ".join(f"'{f}'" for f in features)}][f + 1] AS feature, v AS cut, n::BIGINT AS n, p::BIGINT AS positives FROM part LEFT JOIN cuts ON cuts.tree = part.tree AND cuts.node = part.node"""


def bag_sql(features: list[str], trees: int, depth: int, **options) -> str:
    return tree_sql(features, trees=trees, depth=depth, sampled=True, **options) + f""",
said AS (SELECT tree, node, (2 * SUM(w * y) > SUM(w))::INT AS said FROM n{depth} WHERE w > 0 GROUP BY tree, node),
votes AS (SELECT id, y, (2 * SUM(said) > COUNT(*))::INT AS said FROM n{depth} n JOIN said s ON s.tree = n.tree AND s.node = n.node WHERE w = 0 GROUP BY id, y)
SELECT {trees} AS trees, COUNT(*) AS rows, COUNT(*) FILTER (said != y) AS wrong, ROUND(COUNT(*) FILTER (said != y) / COUNT(*), 6) AS error FROM votes"""


TREE = ["documents_count", "worker_count", "fss_count", "pfr_count", "fns_count", "cnt_users", "has_certificate"]
HARD = TREE[1:]  # without the column that decides most


def _nodes(forest, rows):
    return forest.table(rows).select("tree", "node", "feature", "cut", "n", F.col("counts")[1].alias("positives"))


@query("decision_tree", nodes_sql(TREE, depth=3, trees=1, min_leaf=4))
def _(t):
    rows = _companies(t)
    return _nodes(tree_models.grow(rows, TREE, "is_prolong", depth=3), rows)


@query("bagging_trees", bag_sql(TREE, trees=7, depth=3, min_leaf=4))
def _(t):
    rows = _companies(t)
    forest = tree_models.grow(rows, TREE, "is_prolong", "id", trees=7, depth=3, sampled=True)
    return as_double(forest.out_of_bag(rows, "is_prolong"))


@query("random_forest", bag_sql(TREE, trees=150, depth=10, min_leaf=1, per_node=2))
def _(t):
    rows = _companies(t)
    forest = tree_models.grow(rows, TREE, "is_prolong", "id", trees=150, depth=10, min_leaf=1, sampled=True, per_node=2)
    return as_double(forest.out_of_bag(rows, "is_prolong"))


@query("forest_nodes", nodes_sql(HARD, depth=2, trees=3, min_leaf=2, sampled=True, per_node=3, seed=5))
def _(t):
    rows = _companies(t)
    return _nodes(tree_models.grow(rows, HARD, "is_prolong", "id", trees=3, depth=2, min_leaf=2, sampled=True, per_node=3, seed=5), rows)


FOLD_SQL = "('0x' || substr(md5('{seed}|' || l_orderkey), 1, 8))::BIGINT / 4294967296.0"


@query("k_fold_cv", f"""
WITH d AS (SELECT CAST(floor({FOLD_SQL.format(seed=1)} * 7) AS INT) AS fold, l_quantity AS a, l_tax AS b, l_extendedprice / 1000 AS y FROM lineitem),
s AS (SELECT f.fold, AVG(a) AS ma, AVG(b) AS mb, AVG(y) AS my, var_pop(a) AS aa, var_pop(b) AS bb, covar_pop(a, b) AS ab, covar_pop(a, y) AS ay, covar_pop(b, y) AS by_
      FROM (SELECT DISTINCT fold FROM d) f JOIN d ON d.fold != f.fold GROUP BY f.fold),
w AS (SELECT *, (bb * ay - ab * by_) / (aa * bb - ab * ab) AS wa, (aa * by_ - ab * ay) / (aa * bb - ab * ab) AS wb FROM s),
e AS (SELECT d.fold, y - (my + wa * (a - ma) + wb * (b - mb)) AS gap FROM d JOIN w ON w.fold = d.fold)
SELECT fold, ROUND(AVG(ABS(gap)), 4) AS mae, ROUND(AVG(gap * gap), 3) AS mse FROM e GROUP BY fold""")
def _(t):
    rows = materialize(t.lineitem.select("l_orderkey", *LINE, (F.col("l_extendedprice") / 1000).alias("target")), "lines")
    out = regression.cross_validate(rows, ["l_quantity", "l_tax"], "target", "l_orderkey", 7)
    return out.select("fold", dbl("mae", 4).alias("mae"), dbl("mse", 3).alias("mse"))


@query("churn_cv")
def _(t):
    rows = regression.assemble(_churn(t), CHURN)
    score = classifiers.cross_validate(rows, classifiers.logistic("is_prolong", rows.count()), "is_prolong", "id", 20)
    return t.spark.createDataFrame([("logistic", 20, score)], "model string, folds int, accuracy double")


ALPHAS = [0.0001 + i * (0.01 - 0.0001) / 9 for i in range(10)]


def _lines(t):
    return materialize(t.lineitem.select("l_orderkey", *LINE, (F.col("l_extendedprice") / 1000).alias("target")), "lines")


GRID_SQL = f"""
WITH RECURSIVE d AS ({PRICES}), spread AS (SELECT *, unnest(range(0, 30)) AS key FROM d),
dealt AS MATERIALIZED (SELECT * EXCLUDE (l_orderkey), ('0x' || substr(md5((12 + key // 4) || '|' || l_orderkey), 1 + 8 * (key % 4), 8))::BIGINT / 4294967296.0 < 0.2 AS tested FROM spread),
mom AS (SELECT m.*, a.alpha FROM (SELECT key, {MOMENTS} FROM dealt WHERE NOT tested GROUP BY key) m CROSS JOIN (SELECT unnest([{", ".join(map(repr, ALPHAS))}])::DOUBLE AS alpha) a), {descent_sql("mom", "alpha")},
errors AS (SELECT key, alpha, AVG(abs(y - (intercept + w0 * x0 + w1 * x1 + w2 * x2))) AS mae FROM dealt JOIN fit USING (key) WHERE tested GROUP BY key, alpha)
SELECT ROUND(alpha, 6) AS alpha, ROUND(AVG(mae), 6) AS mae, COUNT(*) AS splits FROM errors GROUP BY alpha"""


@query("grid_search", GRID_SQL)
def _(t):
    return as_double(regression.grid_search(_lines(t), LINE, "target", "l_orderkey", ALPHAS))


WORD_SQL = "('0x' || substr(md5('12|' || l_orderkey), {at}, 8))::BIGINT / 4294967296.0"


@query("grid_search_one_feature", " UNION ALL ".join(f"""
SELECT {100 * i}.0::DOUBLE AS alpha, ROUND((SELECT AVG(m) FROM ({' UNION ALL '.join(f"""
  SELECT (SELECT AVG(ABS(y - (my + w * (x - mx)))) FROM d{s} WHERE u < 0.2) AS m
  FROM (SELECT {LASSO_FIT.format(alpha=f'{100 * i}.0')} AS w, AVG(x) AS mx, AVG(y) AS my FROM d{s} WHERE u >= 0.2)""" for s in (0, 1))})), 3) AS mae, 2::BIGINT AS splits"""
    for i in (0, 1, 2, 4)).join(["WITH " + ", ".join(
        f"d{s} AS (SELECT {WORD_SQL.format(at=1 + 8 * s)} AS u, l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem)" for s in (0, 1)), ""]))
def _(t):
    out = regression.grid_search(_lines(t), ["l_quantity"], "target", "l_orderkey", [0.0, 100.0, 200.0, 400.0], splits=2)
    return out.withColumn("mae", dbl("mae", 3))


PRED_SQL = "SELECT o_orderkey, o_totalprice AS label, 1000.0 * CAST(o_orderkey % 500 AS DOUBLE) AS prediction FROM orders"


@query("metrics", f"""
SELECT ROUND(AVG(ABS(label - prediction)), 4) AS mae, ROUND(AVG((label - prediction) * (label - prediction)), 0) AS mse, ROUND(SQRT(AVG((label - prediction) * (label - prediction))), 4) AS rmse
FROM ({PRED_SQL})""")
def _(t):
    rows = t.orders.select(F.col("o_totalprice").alias("label"), (1000.0 * (F.col("o_orderkey") % 500)).alias("prediction"))
    out = as_double(classifiers.regression_errors(rows, "label", "prediction"), 4)
    return out.withColumn("mse", F.round("mse", 0))


@query("class_report", """
WITH p AS (SELECT o_orderstatus AS l, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'F' WHEN o_orderpriority = '5-LOW' THEN 'P' ELSE 'O' END AS p FROM orders),
c AS (SELECT l AS class, COUNT(*) AS support, SUM(CASE WHEN l = p THEN 1 ELSE 0 END) AS hits FROM p GROUP BY l), s AS (SELECT p AS class, COUNT(*) AS said FROM p GROUP BY p),
m AS (SELECT c.class, hits / said AS precision, hits / support AS recall, support FROM c JOIN s ON s.class = c.class)
SELECT class, ROUND(precision, 6) AS precision, ROUND(recall, 6) AS recall, ROUND(2 * precision * recall / (precision + recall), 6) AS f1, support FROM m""")
def _(t):
    said = F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "F").when(F.col("o_orderpriority") == "5-LOW", "P").otherwise("O")
    return as_double(classifiers.class_report(t.orders.withColumn("said", said), "o_orderstatus", "said"))


VOTES_SQL = """
SELECT id, CAST(documents_count >= 6 AS INT) AS a, CAST(documents_count >= 5 AS INT) AS b, CAST(has_certificate + cnt_users > 0 AS INT) AS c, CAST(worker_count > 9 AS INT) AS d,
  documents_count, worker_count FROM fx_companies"""


def _votes(t):
    docs = F.col("documents_count")
    rules = {"a": docs >= 6, "b": docs >= 5, "c": F.col("has_certificate") + F.col("cnt_users") > 0, "d": F.col("worker_count") > 9}
    return t.fx_companies.withColumns({k: v.cast("int") for k, v in rules.items()})


@query("model_agreement", f"WITH v AS ({VOTES_SQL}) " + " UNION ALL ".join(
    f"SELECT '{x}' AS model_a, '{y}' AS model_b, ROUND(AVG(CAST({x} = {y} AS INT)), 6) AS agreement FROM v" for x, y in ("ab", "ac", "ad", "bc", "bd", "cd")))
def _(t):
    return as_double(aggregates.agree_share(_votes(t), {c: c for c in "abcd"}))


@query("vote_risk_groups", f"""
WITH v AS ({VOTES_SQL}) SELECT (a + b + c + d) / 4.0::DOUBLE AS mean_vote, COUNT(*) AS cnt, ROUND(AVG(documents_count), 6) AS avg_documents_count, ROUND(AVG(worker_count), 6) AS avg_worker_count
FROM v GROUP BY 1""")
def _(t):
    return as_double(classifiers.risk_groups(classifiers.add_votes(_votes(t), "abcd"), ["documents_count", "worker_count"]))


@query("vote_risk_counts", f"""
WITH v AS ({VOTES_SQL}), m AS (SELECT a * b * c * d AS vote, (a + b + c + d) / 4.0 AS mean_vote FROM v)
SELECT COUNT(*) FILTER (vote = 0) AS any_model, COUNT(*) FILTER (mean_vote <= 0.5) AS half_or_more, COUNT(*) FILTER (mean_vote < 0.3) AS below_0_3, COUNT(*) FILTER (mean_vote < 0.6) AS below_0_6 FROM m""")
def _(t):
    return classifiers.risk_counts(classifiers.add_votes(_votes(t), "abcd"))


@query("tfidf", """
WITH train AS (SELECT * FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)),
n AS (SELECT COUNT(*) AS n FROM train),
df AS (SELECT term, COUNT(*) AS df FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS term FROM train) GROUP BY term HAVING COUNT(*) >= 2),
idf AS (SELECT term, ln((1 + n) / (1 + df)) + 1 AS idf FROM df CROSS JOIN n),
tf AS (SELECT doc_id, term, COUNT(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS term FROM documents) GROUP BY 1, 2),
w AS (SELECT doc_id, tf.term, tf * idf AS w FROM tf JOIN idf ON idf.term = tf.term),
len AS (SELECT doc_id, sqrt(SUM(w * w)) AS len FROM w GROUP BY doc_id)
SELECT w.term, COUNT(*) AS docs, ROUND(SUM(w / len), 6) AS weight FROM w JOIN len ON len.doc_id = w.doc_id GROUP BY w.term""")
def _(t):
    train = t.documents.join(t.labels.select("doc_id"), "doc_id", "left_semi")
    weights = text_models.tfidf(t.documents, text_models.fit_idf(train, "doc_id", "text"), "doc_id", "text")
    return as_double(weights.groupBy("term").agg(F.count(F.lit(1)).alias("docs"), F.sum("weight").alias("weight")))


TEXT_ROUNDS, TEXT_PENALTY = 30, 1e-4


def text_sql(rounds: int = TEXT_ROUNDS, penalty: float = TEXT_PENALTY, min_df: int = 2) -> str:
    """The rounds written out: ``u{rounds}`` and ``b{rounds}`` have the weights and biases."""
    side = "CASE WHEN y = c THEN 1.0::DOUBLE ELSE -1.0 END"
    rate = repr(1.0 / (4.0 + penalty))
    out = [f"""WITH docs AS (SELECT doc_id, lang, substr(md5('42|' || doc_id), 1, 8) < '{math.ceil(0.33 * (1 << 32)):08x}' AS tested, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}') AS terms FROM documents),
tf AS MATERIALIZED (SELECT doc_id, lang, tested, term, COUNT(*) AS tf FROM (SELECT doc_id, lang, tested, unnest(terms) AS term FROM docs) GROUP BY ALL),
total AS (SELECT COUNT(*) AS total FROM docs WHERE NOT tested AND lang IS NOT NULL),
idf AS MATERIALIZED (SELECT term, ln((1 + total) / (1 + COUNT(*))) + 1 AS idf FROM tf CROSS JOIN total WHERE NOT tested AND lang IS NOT NULL GROUP BY term, total HAVING COUNT(*) >= {min_df}),
xs AS MATERIALIZED (SELECT doc_id, lang AS y, tested, term, tf * idf / sqrt(SUM((tf * idf) * (tf * idf)) OVER (PARTITION BY doc_id)) AS x FROM tf JOIN idf USING (term)),
x AS MATERIALIZED (SELECT * FROM xs WHERE NOT tested AND y IS NOT NULL),
size AS (SELECT COUNT(DISTINCT doc_id) AS n FROM x),
classes AS (SELECT DISTINCT lang AS c FROM docs WHERE NOT tested AND lang IS NOT NULL),
u0 AS (SELECT term, c, 0.0::DOUBLE AS w, 0.0::DOUBLE AS u FROM idf CROSS JOIN classes), b0 AS (SELECT c, 0.0::DOUBLE AS w, 0.0::DOUBLE AS u FROM classes)"""]
    for t in range(rounds):
        push = repr(t / (t + 3.0))
        out.append(f"""g{t} AS MATERIALIZED (SELECT doc_id, c, -2.0 * {side} * greatest(0.0, 1.0 - {side} * m) / n AS g FROM (
  SELECT doc_id, y, u.c, SUM(x.x * u.u) + any_value(b.u) AS m FROM x JOIN u{t} u USING (term) JOIN b{t} b ON b.c = u.c GROUP BY doc_id, y, u.c) CROSS JOIN size),
d{t} AS (SELECT term, c, SUM(x * g) AS d FROM x JOIN g{t} USING (doc_id) GROUP BY term, c),
u{t + 1} AS MATERIALIZED (SELECT term, c, a AS w, a + {push} * (a - w) AS u FROM (SELECT term, c, w, u - {rate} * (d + {penalty!r} * u) AS a FROM u{t} JOIN d{t} USING (term, c))),
b{t + 1} AS MATERIALIZED (SELECT c, a AS w, a + {push} * (a - w) AS u FROM (SELECT b.c, b.w, b.u - {rate} * SUM(g) AS a FROM b{t} b JOIN g{t} g ON g.c = b.c GROUP BY b.c, b.w, b.u))""")
    return ",\n".join(out)


def _text_model(t):
    train, test = sampling.split(t.documents.select("doc_id", "text", "lang"), 0.33, 42, "doc_id")
    return text_models.fit_text_classifier(train, "text", "lang", "doc_id", rounds=TEXT_ROUNDS, penalty=TEXT_PENALTY), test


@query("text_classifier", text_sql() + f""",
margins AS (SELECT doc_id, u.c, SUM(x * u.w) AS m FROM xs JOIN u{TEXT_ROUNDS} u USING (term) WHERE tested GROUP BY doc_id, u.c),
said AS (SELECT d.doc_id, d.lang, b.c AS predicted FROM docs d CROSS JOIN b{TEXT_ROUNDS} b LEFT JOIN margins m ON m.doc_id = d.doc_id AND m.c = b.c WHERE tested
  QUALIFY row_number() OVER (PARTITION BY d.doc_id ORDER BY coalesce(m, 0) + b.w DESC, b.c) = 1),
actual AS (SELECT lang AS class, COUNT(*) AS support, COUNT(*) FILTER (lang = predicted) AS hits FROM said GROUP BY lang), spoken AS (SELECT predicted AS class, COUNT(*) AS said FROM said GROUP BY predicted),
rates AS (SELECT class, coalesce(hits / said, 0) AS precision, hits / support AS recall, support FROM actual LEFT JOIN spoken USING (class))
SELECT class, ROUND(precision, 6) AS precision, ROUND(recall, 6) AS recall, ROUND(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) AS f1, support FROM rates""")
def _(t):
    model, test = _text_model(t)
    return as_double(classifiers.class_report(model(test, "doc_id"), "lang", "predicted"))


@query("text_weights", text_sql() + f" SELECT term, c AS class, ROUND(w, 6) + 0.0 AS weight FROM u{TEXT_ROUNDS}")
def _(t):
    return as_double(_text_model(t)[0].table()).withColumn("weight", F.col("weight") + 0.0)


HOUSE = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


# Features in units of their own deviation, which keeps the conjugate gradients short; errors are the same.
HOUSE_ROWS = f"SELECT [{', '.join(f'{c} / s{i}' for i, c in enumerate(HOUSE))}] AS x, l_extendedprice / 1000 AS y FROM lineitem CROSS JOIN (SELECT {', '.join(f'STDDEV_POP({c}) AS s{i}' for i, c in enumerate(HOUSE))} FROM lineitem)"


@query("gd_regression", cg_sql(HOUSE_ROWS, len(HOUSE), 0.0) + """
SELECT ROUND(AVG(abs(gap)), 6) AS mae, ROUND(AVG(gap * gap), 6) AS mse, ROUND(sqrt(AVG(gap * gap)), 6) AS rmse
FROM (SELECT y - my - list_dot_product(w, x) + list_dot_product(w, mx) AS gap FROM d CROSS JOIN last CROSS JOIN m)""")
def _(t):
    rows = t.lineitem.withColumn("target", F.col("l_extendedprice") / 1000)
    model = regression.linear(rows, HOUSE, "target")
    return as_double(classifiers.regression_errors(rows.withColumn("prediction", regression.predicted(model, HOUSE)), "target", "prediction"))


@query("feature_rmse", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, ROUND(SQRT((regr_syy(y, x) - regr_sxy(y, x) * regr_sxy(y, x) / regr_sxx(y, x)) / COUNT(*)), 4) AS rmse FROM (SELECT {c}::DOUBLE AS x, l_extendedprice / 1000 AS y FROM lineitem)"
    for c in HOUSE))
def _(t):
    rows = t.lineitem.select(*[F.col(c).cast("double").alias(c) for c in HOUSE], (F.col("l_extendedprice") / 1000).alias("target"))
    return as_double(regression.feature_rmse(rows, HOUSE, "target"), 4)


@query("score_new_data", f"""
WITH n AS (SELECT id, {', '.join(GROUPED)} FROM fx_companies WHERE regdt IS NOT NULL AND substr(md5('7|' || id), 1, 8) < '{math.ceil(0.3 * (1 << 32)):08x}')
SELECT id, true AS same_votes, true AS same_mean FROM n""")
def _(t):
    """Votes on later rows by a stored model that another session reads equal those of the fitted one, row by row."""
    train, new = sampling.split(_churn(t), 0.3, 7, "id")
    model, path = saved.fit(train, GROUPED, ["tax_class"], "is_prolong", "id", bagged=5, forest=7, depth=4), shared_dir(t.spark, "votes")
    model.save(t.spark, path)
    other = t.spark.newSession()
    back = saved.load(other, path)
    pick = ["id", *saved.VOTES, "mean_vote"]
    before, after = (m.votes(new).select(*pick) for m in (model, back))
    after = after.withColumnsRenamed({c: f"back_{c}" for c in pick[1:]})
    same = F.lit(True)
    for c in saved.VOTES:
        same = same & (F.col(c) == F.col(f"back_{c}"))
    return before.join(after, "id").select("id", same.alias("same_votes"), (F.col("mean_vote") == F.col("back_mean_vote")).alias("same_mean"))


@query("score_new_data_ml")
def _(t):
    train, new = sampling.split(_churn(t), 0.3, 7, "id")
    stages = classifiers.category_pipeline(["tax_class"], CHURN[:7], classifiers.random_forest("is_prolong"))
    model = classifiers.fit_and_save(stages, train, shared_dir(t.spark, "churn-model"))
    return model.transform(new).groupBy("is_prolong", F.col("prediction").cast("int").alias("predicted")).agg(F.count(F.lit(1)).alias("cnt"))


@query("churn_votes")
def _(t):
    train, new = sampling.split(_churn(t), 0.3, 7, "id")
    rows = [c for c in CHURN]
    voted = classifiers.churn_votes(train.withColumns({c: F.col(c).cast("double") for c in rows}), new.withColumns({c: F.col(c).cast("double") for c in rows}), rows, "is_prolong")
    return voted.groupBy("mean_vote", "vote").agg(F.count(F.lit(1)).alias("cnt"), F.round(F.avg("is_prolong"), 6).alias("kept_share"))
