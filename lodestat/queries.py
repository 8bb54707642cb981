"""Queries over the driver's tables, one or more for each operator, with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import dist
from .functions.tests import LogLikelihood, bic, likelihood_ratio_test, student_test, z_test
from .operators import cluster, diagnostics, frames, kernels, linalg, prep
from .plans import penalties, regression, selection, updaters
from .plans.objectives import Data, Linear, Logistic, binary_metrics_frame, multiclass_frame
from .sources import tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

X3 = ["l_quantity", "l_discount", "l_tax"]
#: The embedding's first components as columns, on both engines.
E4 = ["e0", "e1", "e2", "e3"]
_E4_SQL = ", ".join(f"embedding[{i + 1}]::double AS e{i}" for i in range(4))
_E4 = f"(SELECT vec_id, label, {_E4_SQL} FROM embeddings)"


def query(sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    """Doubles rounded for comparison; + 0 turns -0 into 0."""
    return df.withColumns({c: F.round(F.col(c), d) + 0.0 for c, d in digits.items()})


def e4(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(4)])


def labelled(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "lang", "source", F.col("n_chars").cast("double").alias("n_chars")).join(table(spark, sf, "labels"), "doc_id", "left")


_LABELLED = "(SELECT d.doc_id, lang, source, n_chars::double AS n_chars, quality, toxic FROM documents d LEFT JOIN labels USING (doc_id))"


def row(spark: SparkSession, **values) -> DataFrame:
    return spark.createDataFrame([tuple(values.values())], list(values))


# --- regression -------------------------------------------------------------------------------


@query("""SELECT round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
 round(regr_r2(l_extendedprice, l_quantity), 6) AS r2,
 round(sqrt((1 - regr_r2(l_extendedprice, l_quantity)) * regr_syy(l_extendedprice, l_quantity) / (count(*) - 2) / regr_sxx(l_extendedprice, l_quantity)), 4) AS slope_sd FROM lineitem""")
def ols_simple(spark, sf):
    r = regression.linear_regression(table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity"])
    out = row(spark, intercept=r.effect("intercept").slope, slope=r.effect("l_quantity").slope, r2=r.fit["r2"], slope_sd=r.effect("l_quantity").sd)
    return rounded(out, intercept=4, slope=4, r2=6, slope_sd=4)


_GRAM2 = """m AS (SELECT count(*)::double AS n, avg(l_quantity) AS ma, avg(l_discount) AS mb, avg(l_extendedprice) AS my FROM lineitem),
 s AS (SELECT sum((l_quantity - ma) * (l_quantity - ma)) AS aa, sum((l_quantity - ma) * (l_discount - mb)) AS ab, sum((l_discount - mb) * (l_discount - mb)) AS bb,
 sum((l_quantity - ma) * (l_extendedprice - my)) AS ay, sum((l_discount - mb) * (l_extendedprice - my)) AS byy, sum((l_extendedprice - my) * (l_extendedprice - my)) AS yy, any_value(n) AS n,
 any_value(ma) AS ma, any_value(mb) AS mb, any_value(my) AS my FROM lineitem, m)"""


@query(f"""WITH {_GRAM2}, b AS (SELECT *, (bb * ay - ab * byy) / (aa * bb - ab * ab) AS b1, (aa * byy - ab * ay) / (aa * bb - ab * ab) AS b2 FROM s),
 r AS (SELECT *, yy - b1 * ay - b2 * byy AS rss FROM b)
 SELECT 'l_discount' AS term, round(b2, 3) AS estimate, round(sqrt(rss / (n - 3) * aa / (aa * bb - ab * ab)), 3) AS std_error, round(b2 / sqrt(rss / (n - 3) * aa / (aa * bb - ab * ab)), 4) AS statistic FROM r
 UNION ALL SELECT 'l_quantity', round(b1, 3), round(sqrt(rss / (n - 3) * bb / (aa * bb - ab * ab)), 3), round(b1 / sqrt(rss / (n - 3) * bb / (aa * bb - ab * ab)), 4) FROM r""")
def ols_two_terms(spark, sf):
    r = regression.linear_regression(table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"])
    return rounded(r.table(spark).where("term <> 'intercept'").drop("p_value"), estimate=3, std_error=3, statistic=4)


@query(f"""WITH {_GRAM2}, w AS (SELECT *, aa + 1000 / sqrt(aa / (n - 1)) AS a2, bb + 1000 / sqrt(bb / (n - 1)) AS b2 FROM s)
 SELECT round((b2 * ay - ab * byy) / (a2 * b2 - ab * ab), 3) AS l_quantity, round((a2 * byy - ab * ay) / (a2 * b2 - ab * ab), 3) AS l_discount,
 round(my - ma * (b2 * ay - ab * byy) / (a2 * b2 - ab * ab) - mb * (a2 * byy - ab * ay) / (a2 * b2 - ab * ab), 3) AS intercept FROM w""")
def ridge_two_features(spark, sf):
    r = regression.linear_regression(table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"], ridge=1000.0)
    out = row(spark, l_quantity=r.effect("l_quantity").slope, l_discount=r.effect("l_discount").slope, intercept=r.effect("intercept").slope)
    return rounded(out, l_quantity=3, l_discount=3, intercept=3)


_SIMPLE = """p AS (SELECT p_partkey, p_size::double AS x, p_retailprice AS y FROM part),
 c AS (SELECT regr_slope(y, x) AS b, regr_intercept(y, x) AS a, avg(x) AS mx, regr_sxx(y, x) AS sxx, regr_syy(y, x) * (1 - regr_r2(y, x)) AS rss, count(*)::double AS n FROM p)"""


def _part(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))


@query(f"WITH {_SIMPLE} SELECT p_partkey, round(y - a - b * x, 4) AS residual, round(1 / n + (x - mx) * (x - mx) / sxx, 8) AS leverage FROM p, c")
def ols_residuals_leverage(spark, sf):
    df = _part(spark, sf)
    r = regression.linear_regression(df, "y", ["x"])
    return rounded(regression.influence(r, df, "y").select("p_partkey", "residual", "leverage"), residual=4, leverage=8)


@query(f"""WITH {_SIMPLE}, e AS (SELECT p_partkey, y - a - b * x AS e, 1 / n + (x - mx) * (x - mx) / sxx AS h, rss, n FROM p, c)
 SELECT p_partkey, round(e / sqrt((rss - e * e) / (n - 3) * (1 - h)), 5) AS studentized FROM e""")
def studentized_residuals(spark, sf):
    df = _part(spark, sf)
    return rounded(regression.influence(regression.linear_regression(df, "y", ["x"]), df, "y").select("p_partkey", "studentized"), studentized=5)


@query("""WITH c AS (SELECT regr_r2(l_extendedprice, l_quantity) AS r2, regr_syy(l_extendedprice, l_quantity) * (1 - regr_r2(l_extendedprice, l_quantity)) AS rss, count(*)::double AS n FROM lineitem),
 l AS (SELECT *, -n / 2 * (ln(2 * pi()) + 1 - ln(n) + ln(rss)) AS ll FROM c)
 SELECT round(ll, 2) AS loglik, round(-2 * ll + 3 * ln(n), 2) AS bic, round(1 - (1 - r2) * (n - 1) / (n - 2), 6) AS adj_r2 FROM l""")
def ols_loglik_bic(spark, sf):
    r = regression.linear_regression(table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity"])
    return rounded(row(spark, loglik=r.likelihood.value, bic=bic(r.likelihood), adj_r2=r.fit["adj_r2"]), loglik=2, bic=2, adj_r2=6)


@query(f"""WITH {_GRAM2}, r AS (SELECT n, yy - ay * ay / aa AS rss0, yy - (ay * (bb * ay - ab * byy) + byy * (aa * byy - ab * ay)) / (aa * bb - ab * ab) AS rss1 FROM s)
 SELECT round(n * ln(rss0 / rss1), 4) AS statistic, 1.0::double AS df FROM r""")
def lrt_statistic(spark, sf):
    li = table(spark, sf, "lineitem")
    small, large = (regression.linear_regression(li, "l_extendedprice", x).likelihood for x in (["l_quantity"], ["l_quantity", "l_discount"]))
    t = likelihood_ratio_test(small, large)
    return rounded(row(spark, statistic=t.statistic, df=float(t.df)), statistic=4)


@query("""SELECT * FROM (VALUES ('z 1.96', 0.049996), ('t 2.0 df 10', 0.073388), ('chi2 3.841459 df 1', 0.05), ('t upper 1.812461 df 10', 0.05)) AS t(test, p_value)""")
def hypothesis_tests(spark, sf):
    lrt = likelihood_ratio_test(LogLikelihood(0, 1, 10), LogLikelihood(3.841459 / 2, 2, 10))
    rows = [("z 1.96", z_test(1.96, 1).p_value), ("t 2.0 df 10", student_test(2.0, 1.0, 10).p_value), ("chi2 3.841459 df 1", lrt.p_value), ("t upper 1.812461 df 10", dist.t_upper(1.812461, 10))]
    return rounded(spark.createDataFrame([(a, float(b)) for a, b in rows], "test string, p_value double"), p_value=6)


@query("""SELECT * FROM (VALUES ('normal 0.975', 1.959964), ('t 0.975 df 5', 2.570582), ('chi2 0.95 df 3', 7.814728), ('beta 0.5 1 3', 0.206299)) AS t(quantile, value)""")
def distribution_quantiles(spark, sf):
    rows = [("normal 0.975", dist.normal_quantile(0.975)), ("t 0.975 df 5", dist.t_quantile(0.975, 5)), ("chi2 0.95 df 3", dist.chi2_quantile(0.95, 3)), ("beta 0.5 1 3", dist.beta_quantile(0.5, 1, 3))]
    return rounded(spark.createDataFrame(rows, "quantile string, value double"), value=6)


@query("""WITH x AS (SELECT 1.0::double AS one, l_discount AS d, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS y FROM lineitem),
 s AS (SELECT sum(y - 0.5) AS g0, sum((y - 0.5) * d) AS g1, sum(0.25) AS h00, sum(0.25 * d) AS h01, sum(0.25 * d * d) AS h11 FROM x)
 SELECT round((h11 * g0 - h01 * g1) / (h00 * h11 - h01 * h01), 6) AS b0, round((h00 * g1 - h01 * g0) / (h00 * h11 - h01 * h01), 6) AS b1 FROM s""")
def logistic_newton_step(spark, sf):
    df = table(spark, sf, "lineitem").select(F.lit(1.0).alias("one"), F.col("l_discount").alias("d"), F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("y"))
    bound = Logistic().on(Data(df, ["one", "d"], "y", np.array([0.0, 1.0])))
    b = updaters.Newton().next(updaters.State(np.zeros(2)), bound, penalties.NoPenalty()).point
    bound.close()
    return rounded(row(spark, b0=float(b[0]), b1=float(b[1])), b0=6, b1=6)


@query("""WITH s AS (SELECT sum(l_quantity * l_quantity) + 10 AS a, sum(l_quantity * l_extendedprice) AS xy, sum(l_extendedprice * l_extendedprice) AS yy, count(*)::double AS n FROM lineitem)
 SELECT round(xy / a, 4) AS mean, round((yy - xy * xy / a) / 2 / (n / 2) / a * n / (n - 2), 6) AS variance FROM s""")
def bayes_one_feature(spark, sf):
    r = regression.bayesian_regression(table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity"], 10.0, add_intercept=False)
    return rounded(row(spark, mean=float(r.mean[0]), variance=float(r.variances[0])), mean=4, variance=6)


@query("""WITH s AS (SELECT sum(l_quantity * l_quantity) AS g, sum(l_quantity * l_extendedprice) AS xy, sum(l_extendedprice * l_extendedprice) AS yy, count(*)::double AS n FROM lineitem)
 SELECT round(-0.5 * (n * ln(1e6) + ln(2 + g / 1e6) - ln(2)) - 0.5 * (yy / 1e6 - xy * xy / 1e12 / (2 + g / 1e6)), 2) AS log_marginal FROM s""")
def log_marginal_likelihood(spark, sf):
    v = regression.log_marginal_likelihood(table(spark, sf, "lineitem"), "l_extendedprice", ["l_quantity"], 2.0, 1e6, add_intercept=False)
    return rounded(row(spark, log_marginal=v), log_marginal=2)


@query("""SELECT l_orderkey, l_linenumber, round(100 + 2.5 * l_quantity - 40 * l_discount, 6) AS linear, round(1 / (1 + exp(-(0.5 - 0.02 * l_quantity + 3 * l_discount))), 8) AS logistic FROM lineitem""")
def predict_linear_sigmoid(spark, sf):
    df = table(spark, sf, "lineitem")
    out = df.select("l_orderkey", "l_linenumber", frames.dot(["l_quantity", "l_discount"], [2.5, -40.0], 100.0).alias("linear"), frames.sigmoid(frames.dot(["l_quantity", "l_discount"], [-0.02, 3.0], 0.5)).alias("logistic"))
    return rounded(out, linear=6, logistic=8)


# --- gradient side ------------------------------------------------------------------------------


@query("""SELECT round(sum(l_quantity * (l_extendedprice - 700 * l_quantity - 10 * l_discount)), 0) AS g_quantity, round(sum(l_discount * (l_extendedprice - 700 * l_quantity - 10 * l_discount)), 1) AS g_discount,
 round(-sum((l_extendedprice - 700 * l_quantity - 10 * l_discount) * (l_extendedprice - 700 * l_quantity - 10 * l_discount)) / 1e6, 1) AS value_m FROM lineitem""")
def linear_gradient(spark, sf):
    b = np.array([700.0, 10.0])
    o = Linear().on(Data(table(spark, sf, "lineitem"), ["l_quantity", "l_discount"], "l_extendedprice", np.ones(2)))
    g = o.gradient(b)
    return rounded(row(spark, g_quantity=float(g[0]), g_discount=float(g[1]), value_m=o.value(b) / 1e6), g_quantity=0, g_discount=1, value_m=1)


@query("""WITH x AS (SELECT l_quantity AS q, l_discount AS d, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS y, 0.01 * l_quantity - 2 * l_discount AS eta FROM lineitem)
 SELECT round(sum(q * (y - 1 / (1 + exp(-eta)))), 3) AS g_quantity, round(sum(d * (y - 1 / (1 + exp(-eta)))), 4) AS g_discount, round(sum(y * eta - ln(1 + exp(eta))), 3) AS value FROM x""")
def logistic_gradient(spark, sf):
    df = table(spark, sf, "lineitem").select("l_quantity", "l_discount", F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0).alias("y"))
    o = Logistic().on(Data(df, ["l_quantity", "l_discount"], "y", np.ones(2)))
    b = np.array([0.01, -2.0])
    g, v = o.gradient(b), o.value(b)
    o.close()
    return rounded(row(spark, g_quantity=float(g[0]), g_discount=float(g[1]), value=v), g_quantity=3, g_discount=4, value=3)


_PROX = "(VALUES (-3.0::double), (-0.4::double), (0.0::double), (0.2::double), (5.0::double)) AS t(b)"


@query(f"""SELECT b, round(b / (1 + 0.5 * 2), 6) + 0 AS l2, round(sign(b) * greatest(0, abs(b) - 0.5 * 2), 6) + 0 AS l1, round(sign(b) * greatest(0, (abs(b) - 0.3 * 2) / (1 + 2 * 0.7)), 6) + 0 AS elastic_net FROM {_PROX}""")
def prox_steps(spark, sf):
    b, one = np.array([-3.0, -0.4, 0.0, 0.2, 5.0]), np.ones(5)
    cols = [b, penalties.L2(0.5).prox(b, one, 2.0), penalties.L1(0.5).prox(b, one, 2.0), penalties.ElasticNet(0.3, 0.7).prox(b, one, 2.0)]
    return rounded(spark.createDataFrame([tuple(map(float, r)) for r in zip(*cols, strict=True)], "b double, l2 double, l1 double, elastic_net double"), l2=6, l1=6, elastic_net=6)


def _steps_sql(n: int, step: str, init: str = "0.0::double AS b") -> str:
    return f"""WITH RECURSIVE s AS (SELECT sum(l_quantity * l_quantity) / 1e6 AS xx, sum(l_quantity * l_extendedprice) / 1e6 AS xy FROM lineitem),
 t AS (SELECT 0 AS k, {init}, xx, xy FROM s UNION ALL SELECT k + 1 AS k, {step}, xx, xy FROM t WHERE k < {n}) SELECT round(b, 4) AS b FROM t WHERE k = {n}"""


def _unrolled(name: str, updater, n: int, penalty=None):
    def run(spark, sf):
        df = table(spark, sf, "lineitem").select((F.col("l_quantity") / 1000).alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))
        o = Linear().on(Data(df, ["x"], "y", np.ones(1)))
        s = updaters.State(np.zeros(1))
        for _ in range(n):
            s = updater.next(s, o, penalty or penalties.L2(0.0))
        return rounded(row(spark, b=float(s.point[0])), b=4)

    run.__name__ = name
    return run


query(_steps_sql(5, "b + 0.001 * (xy - xx * b)"))(_unrolled("gradient_steps", updaters.FixedStep(0.001), 5))
query(_steps_sql(3, "b + 0.001 * (xy - xx * b - 2.0 * b)"))(_unrolled("ridge_gradient_steps", updaters.FixedStep(0.001), 3, penalties.L2(2.0)))
query(_steps_sql(6, "b + 5.0 * (xy - xx * b) / sqrt(s + (xy - xx * b) * (xy - xx * b) + 1e-8) AS b, s + (xy - xx * b) * (xy - xx * b) AS s", "0.0::double AS b, 0.0::double AS s"))(_unrolled("adagrad_steps", updaters.AdaGrad(5.0), 6))
query(_steps_sql(6, "b + 2.0 * (xy - xx * b) / sqrt(0.95 * s + 0.05 * (xy - xx * b) * (xy - xx * b) + 1e-8) AS b, 0.95 * s + 0.05 * (xy - xx * b) * (xy - xx * b) AS s", "0.0::double AS b, 0.0::double AS s"))(_unrolled("rmsprop_steps", updaters.RmsProp(2.0), 6))
query(_steps_sql(4, """b + 0.5 * (0.9 * a + 0.1 * (xy - xx * b)) / (1 - 0.9 ** (k + 1)) / (sqrt((0.999 * v + 0.001 * (xy - xx * b) * (xy - xx * b)) / (1 - 0.999 ** (k + 1))) + 1e-8) AS b,
 0.9 * a + 0.1 * (xy - xx * b) AS a, 0.999 * v + 0.001 * (xy - xx * b) * (xy - xx * b) AS v""", "0.0::double AS b, 0.0::double AS a, 0.0::double AS v"))(_unrolled("adam_steps", updaters.Adam(0.5), 4))
query(_steps_sql(5, """b + (xy - xx * b) * sqrt(u + 1e-8) / sqrt(0.95 * a + 0.05 * (xy - xx * b) * (xy - xx * b) + 1e-8) AS b, 0.95 * a + 0.05 * (xy - xx * b) * (xy - xx * b) AS a,
 0.95 * u + 0.05 * (xy - xx * b) * (xy - xx * b) * (u + 1e-8) / (0.95 * a + 0.05 * (xy - xx * b) * (xy - xx * b) + 1e-8) AS u""", "0.0::double AS b, 0.0::double AS a, 0.0::double AS u"))(_unrolled("adadelta_steps", updaters.AdaDelta(), 5))
query(_steps_sql(5, """b + 2.0 * (CASE WHEN k = 0 THEN xy - xx * b ELSE 0.909 * v + 0.091 * (xy - xx * b) END) / sqrt(s + (xy - xx * b) * (xy - xx * b) * d * 0.9 + 1e-8) AS b, d * 0.9 AS d, s + (xy - xx * b) * (xy - xx * b) * d * 0.9 AS s,
 CASE WHEN k = 0 THEN xy - xx * b ELSE 0.909 * v + 0.091 * (xy - xx * b) END AS v""", "0.0::double AS b, 1.0::double AS d, 0.0::double AS s, 0.0::double AS v"))(_unrolled("momentum_steps", updaters.DecayingMomentum(2.0), 5))
query(_steps_sql(1, "sign(xy / xx) * greatest(0, abs(xy / xx) - 50.0 / xx) AS b"))(_unrolled("coordinate_step_l1", updaters.CoordinateDescent(), 1, penalties.L1(50.0)))
query(_steps_sql(1, "xy / (xx + 3.0) AS b"))(_unrolled("newton_step_l2", updaters.Newton(), 1, penalties.L2(3.0)))


# --- metrics --------------------------------------------------------------------------------------


@query("""WITH p AS (SELECT l_quantity > 25 AS p, l_returnflag = 'R' AS y FROM lineitem)
 SELECT round(avg(CASE WHEN p = y THEN 1.0 ELSE 0 END), 8) AS accuracy, round(sum(CASE WHEN p AND y THEN 1.0 ELSE 0 END) / sum(CASE WHEN p THEN 1 ELSE 0 END), 8) AS precision, round(sum(CASE WHEN p AND y THEN 1.0 ELSE 0 END) / sum(CASE WHEN y THEN 1 ELSE 0 END), 8) AS recall, count(*) AS n FROM p""")
def binary_metrics(spark, sf):
    df = table(spark, sf, "lineitem").select((F.col("l_quantity") / 50).alias("p"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("y"))
    return rounded(binary_metrics_frame(df, "y", "p"), accuracy=8, precision=8, recall=8)


@query("""WITH p AS (SELECT label AS y, (label + vec_id % 3) % 10 AS p FROM embeddings), c AS (SELECT DISTINCT y AS class FROM p UNION SELECT DISTINCT p FROM p)
 SELECT class::int AS class, round(count(*) FILTER (WHERE p = class AND y = class) / nullif(count(*) FILTER (WHERE p = class), 0), 8) AS precision,
 round(count(*) FILTER (WHERE p = class AND y = class) / nullif(count(*) FILTER (WHERE y = class), 0), 8) AS recall, count(*) FILTER (WHERE y = class) AS support FROM c, p GROUP BY class""")
def multiclass_metrics(spark, sf):
    df = table(spark, sf, "embeddings").select("label", ((F.col("label") + F.col("vec_id") % 3) % 10).alias("p"))
    return rounded(multiclass_frame(df, "label", "p"), precision=8, recall=8)


@query("""WITH m AS (SELECT avg(l_extendedprice) AS m FROM lineitem) SELECT round(1 - sum((l_extendedprice - 1500 * l_quantity) * (l_extendedprice - 1500 * l_quantity)) / sum((l_extendedprice - m) * (l_extendedprice - m)), 6) AS r2 FROM lineitem, m""")
def r_squared(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("prediction", F.col("l_quantity") * 1500)
    return rounded(row(spark, r2=selection.r2(Linear(), df, "l_extendedprice")), r2=6)


@query(f"SELECT round(corr(n_chars, quality), 8) AS r_quality, round(corr(n_chars, toxic), 8) AS r_toxic FROM {_LABELLED}")
def pearson_pairwise(spark, sf):
    df = labelled(spark, sf).withColumn("n_chars", F.col("n_chars"))
    return rounded(df.agg(regression.pearson(F.col("n_chars"), F.col("quality")).alias("r_quality"), regression.pearson(F.col("n_chars"), F.col("toxic")).alias("r_toxic")), r_quality=8, r_toxic=8)


@query("""SELECT a, b, round(r, 7) AS r FROM (SELECT unnest(['l_quantity', 'l_discount', 'l_tax', 'l_quantity', 'l_discount', 'l_quantity', 'l_tax', 'l_discount', 'l_tax']) AS a, unnest(['l_quantity', 'l_discount', 'l_tax', 'l_discount', 'l_quantity', 'l_tax', 'l_quantity', 'l_tax', 'l_discount']) AS b,
 unnest([1.0, 1.0, 1.0, corr(l_quantity, l_discount), corr(l_quantity, l_discount), corr(l_quantity, l_tax), corr(l_quantity, l_tax), corr(l_discount, l_tax), corr(l_discount, l_tax)]) AS r FROM lineitem)""")
def correlation_matrix(spark, sf):
    return rounded(diagnostics.correlation_matrix(table(spark, sf, "lineitem"), X3), r=7)


# --- frames and preparation -----------------------------------------------------------------------


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def row_filter_by_keys(spark, sf):
    gone = table(spark, sf, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"))
    return frames.pick(frames.without_rows(table(spark, sf, "customer"), gone, "c_nationkey"), ["c_custkey", "c_acctbal"])


@query("SELECT c_custkey, c_acctbal, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 200000")
def keyed_concat(spark, sf):
    o = table(spark, sf, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    return frames.beside(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), o, "c_custkey")


@query("SELECT round(var_samp(l_quantity), 5) AS l_quantity, round(var_samp(l_discount), 9) AS l_discount, round(var_samp(l_tax), 9) AS l_tax FROM lineitem")
def column_reduce(spark, sf):
    return rounded(frames.reduce_columns(table(spark, sf, "lineitem"), X3, F.var_samp), l_quantity=5, l_discount=9, l_tax=9)


@query("SELECT l_orderkey, l_linenumber, l_quantity, 0.0::double AS unknown, l_tax FROM lineitem")
def reindex_fill_zero(spark, sf):
    df = table(spark, sf, "lineitem")
    return frames.reindex(df, ["l_orderkey", "l_linenumber", "l_quantity", "unknown", "l_tax"], 0.0).withColumns({"l_orderkey": F.col("l_orderkey").cast("long"), "l_linenumber": F.col("l_linenumber").cast("int")})


@query("""(SELECT c_custkey, c_acctbal, 'low' AS side FROM customer ORDER BY c_acctbal, c_custkey LIMIT 5) UNION ALL (SELECT c_custkey, c_acctbal, 'high' FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 5)""")
def top_and_bottom(spark, sf):
    return frames.extremes(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "c_custkey")


@query("SELECT p_partkey, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 AS rank FROM part")
def rank_ties_average(spark, sf):
    return frames.ranked(table(spark, sf, "part").select("p_partkey", "p_size"), "p_size", "rank").drop("p_size")


@query("SELECT c_custkey, round(ln(greatest(c_acctbal + c_nationkey + 2000, 1)), 8) AS s FROM customer")
def row_sum_log(spark, sf):
    df = table(spark, sf, "customer").withColumn("k", F.lit(2000.0))
    return rounded(df.select("c_custkey", frames.scalar("log", frames.scalar("max", frames.row_sum(["c_acctbal", "c_nationkey", "k"]), 1.0)).alias("s")), s=8)


@query("SELECT lang, min(doc_id) AS first FROM documents GROUP BY lang")
def first_seen_values(spark, sf):
    return frames.first_seen(table(spark, sf, "documents"), "lang", "doc_id")


@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, 1 LIMIT 1")
def modal_value(spark, sf):
    return frames.modal(table(spark, sf, "orders"), "o_orderpriority")


@query(f"SELECT vec_id, 'e' || k AS j, round([e0, e1, e2, e3][k + 1], 7) AS v FROM {_E4}, range(4) AS r(k)")
def melt_columns(spark, sf):
    return rounded(frames.long(e4(spark, sf), "vec_id", E4), v=7)


@query("""SELECT * FROM (VALUES (1, exp(-1.0), ln(2.0), log10(50.0), sqrt(2.0), 2.25, 1.0, -1.0, 0.5)) AS t(id, e, l, l10, s, p, a, g, sg)""".replace("exp(-1.0), ln(2.0), log10(50.0), sqrt(2.0)", "round(exp(-1.0), 8), round(ln(2.0), 8), round(log10(50.0), 8), round(sqrt(2.0), 8)").replace("2.25, 1.0, -1.0, 0.5", "2.25::double, 1.0::double, -1.0::double, 0.5::double"))
def scalar_functions(spark, sf):
    x = lambda v: F.lit(float(v))
    f = frames.scalar
    cols = {"e": f("exp", x(-1)), "l": f("log", x(2)), "l10": f("log10", x(50)), "s": f("sqrt", x(2)), "p": f("pow", x(1.5), 2.0), "a": f("abs", x(-1)), "g": f("sign", x(-3)), "sg": f("sigmoid", x(0))}
    return rounded(spark.range(1).select(F.lit(1).alias("id"), *[F.round(c, 8).alias(k) for k, c in cols.items()]), p=8)


@query("""SELECT 'o_orderpriority' AS column_name, bool_or(try_cast(o_orderpriority AS double) IS NULL) AS categorical FROM orders UNION ALL SELECT 'o_orderstatus', bool_or(try_cast(o_orderstatus AS double) IS NULL) FROM orders UNION ALL SELECT 'o_totalprice', false""")
def detect_categorical(spark, sf):
    columns = ["o_orderpriority", "o_orderstatus", "o_totalprice"]
    found = prep.categorical_columns(table(spark, sf, "orders"), columns)
    return spark.createDataFrame([(c, c in found) for c in columns], "column_name string, categorical boolean")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 1.0 ELSE 0.0 END AS "o_orderstatus_O", CASE WHEN o_orderstatus = 'P' THEN 1.0 ELSE 0.0 END AS "o_orderstatus_P" FROM orders""")
def onehot_drop_first(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return prep.one_hot(df, "o_orderstatus", prep.levels(df, "o_orderstatus"))


@query(f"WITH d AS {_LABELLED} SELECT doc_id, round(coalesce(quality, avg(quality) OVER ()), 8) AS quality FROM d")
def mean_impute(spark, sf):
    df = labelled(spark, sf).select("doc_id", F.col("quality").cast("double").alias("quality"))
    return rounded(prep.fill_numeric(df, ["quality"], prep.MissingMode.MEAN_IMPUTE), quality=8)


@query(f"WITH d AS {_LABELLED} SELECT doc_id, quality::double AS quality FROM d WHERE quality IS NOT NULL")
def drop_missing(spark, sf):
    df = labelled(spark, sf).select("doc_id", F.col("quality").cast("double").alias("quality"))
    return prep.fill_numeric(df, ["quality"], prep.MissingMode.DROP_SAMPLE)


@query("""WITH d AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'N/A ' ELSE lang END AS lang FROM documents), m AS (SELECT lang FROM d WHERE lang <> 'N/A ' GROUP BY lang ORDER BY count(*) DESC, lang LIMIT 1)
 SELECT doc_id, CASE WHEN d.lang = 'N/A ' THEN m.lang ELSE d.lang END AS lang FROM d, m""")
def mode_impute_category(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 7 == 0, "N/A ").otherwise(F.col("lang")).alias("lang"))
    return prep.fill_category(df, "lang", prep.MissingMode.MEAN_IMPUTE)


@query("WITH s AS (SELECT stddev_samp(l_quantity) AS q, stddev_samp(l_tax) AS t FROM lineitem) SELECT l_orderkey, l_linenumber, round(l_quantity / q, 7) AS l_quantity, round(l_tax / t, 7) AS l_tax, 1.0::double AS one FROM lineitem, s")
def scale_without_centring(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax", F.lit(1.0).alias("one"))
    return rounded(prep.scale(df, ["l_quantity", "l_tax", "one"]), l_quantity=7, l_tax=7)


@query("""WITH m AS (SELECT avg(l_discount) FILTER (WHERE l_discount <> 0) AS m FROM lineitem) SELECT l_orderkey, l_linenumber, round(CASE WHEN l_discount = 0 THEN m ELSE l_discount END, 8) AS l_discount FROM lineitem, m""")
def zero_to_mean(spark, sf):
    return rounded(prep.zero_to_mean(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_discount"), ["l_discount"]), l_discount=8)


@query("""SELECT l_orderkey, l_linenumber, round(log10(l_quantity + 1), 7) AS l_quantity, round(l_tax * l_tax, 8) AS l_tax_p2, round(l_tax * l_discount, 8) AS tax_discount FROM lineitem""")
def feature_expressions(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax", "l_discount")
    df = prep.interactions(prep.powers(prep.log10_plus_1(df, ["l_quantity"]), ["l_tax"], (2,)), ["l_tax", "l_discount"])
    return rounded(df.withColumnRenamed("l_tax*l_discount", "tax_discount").drop("l_tax", "l_discount"), l_quantity=7, l_tax_p2=8, tax_discount=8)


@query("""SELECT count_if(l_tax * l_discount = 0) < 1000000 AS kept, count_if(l_tax * l_discount = 0)::bigint AS zeros FROM lineitem""")
def interaction_screen(spark, sf):
    df = table(spark, sf, "lineitem").select("l_tax", "l_discount")
    kept = "l_tax*l_discount" in prep.interactions(df, ["l_tax", "l_discount"], 1_000_000).columns
    return df.agg(F.lit(kept).alias("kept"), F.count_if(F.col("l_tax") * F.col("l_discount") == 0).alias("zeros"))


@query("""SELECT p_partkey, rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2.0 - rank() OVER (ORDER BY p_retailprice) - (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0 AS rank_sum FROM part""")
def rank_sum(spark, sf):
    return prep.rank_sum(table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice"), {"p_size": 1, "p_retailprice": -1}).select("p_partkey", "rank_sum")


@query("""WITH c AS (SELECT 'l_quantity' AS term, regr_slope(l_extendedprice, l_quantity) AS slope, corr(l_extendedprice, l_quantity) AS r, count(*) AS n FROM lineitem
 UNION ALL SELECT 'l_discount', regr_slope(l_extendedprice, l_discount), corr(l_extendedprice, l_discount), count(*) FROM lineitem UNION ALL SELECT 'l_tax', regr_slope(l_extendedprice, l_tax), corr(l_extendedprice, l_tax), count(*) FROM lineitem)
 SELECT term, round(slope, 3) AS slope, round(r * sqrt((n - 2) / (1 - r * r)), 5) AS t FROM c""")
def univariate_screen(spark, sf):
    got = prep.univariate_screen(table(spark, sf, "lineitem"), "l_extendedprice", X3, p_below=1.1)
    return rounded(spark.createDataFrame([(r["term"], r["slope"], r["t"]) for r in got], "term string, slope double, t double"), slope=3, t=5)


# --- linear algebra -------------------------------------------------------------------------------

_COO = "(SELECT vec_id AS i, k - 1 AS j, embedding[k]::double AS v FROM embeddings, range(1, 65) AS r(k) WHERE embedding[k] > 0.1)"


def _coo(spark, sf):
    return linalg.coo(table(spark, sf, "embeddings"), "vec_id", "embedding").where("v > cast(0.1 as float)")


@query(f"WITH m AS {_COO} SELECT i, round(sum(v * (j + 1)), 6) AS v FROM m GROUP BY i")
def coo_mv(spark, sf):
    return rounded(linalg.mv(_coo(spark, sf), linalg.vector(range(1, 65), spark)), v=6)


@query(f"WITH m AS {_COO} SELECT j AS i, round(sum(v * (i % 5)), 6) AS v FROM m GROUP BY j")
def coo_tmv(spark, sf):
    m = _coo(spark, sf)
    return rounded(linalg.tmv(m, m.select("i").distinct().select("i", (F.col("i") % 5).cast("double").alias("v"))).withColumn("i", F.col("i").cast("long")), v=6)


@query(f"WITH m AS {_COO} SELECT a.j AS i, b.j AS j, round(sum(a.v * b.v), 6) AS v FROM m a JOIN m b USING (i) GROUP BY a.j, b.j")
def gram(spark, sf):
    return rounded(linalg.gram(_coo(spark, sf)).select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "v"), v=6)


@query(f"WITH m AS MATERIALIZED {_COO} SELECT a.i AS i, b.i AS j, round(sum(a.v * b.v), 6) AS v FROM m a JOIN m b USING (j) GROUP BY a.i, b.i")
def outer_product(spark, sf):
    return rounded(linalg.outer(_coo(spark, sf)), v=6)


@query(f"WITH m AS {_COO}, b AS (SELECT k AS i, c AS j, ((k * 3 + c) % 7)::double AS v FROM range(64) AS r(k), range(3) AS q(c)) SELECT m.i, b.j, round(sum(m.v * b.v), 6) AS v FROM m JOIN b ON m.j = b.i GROUP BY m.i, b.j")
def matrix_product(spark, sf):
    b = spark.range(64).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("j")).withColumn("v", ((F.col("i") * 3 + F.col("j")) % 7).cast("double"))
    return rounded(linalg.mm(_coo(spark, sf), b), v=6)


@query(f"WITH m AS {_COO}, b AS (SELECT i, 0::bigint AS j, (i % 4)::double AS v FROM (SELECT DISTINCT i FROM m)) SELECT m.j AS i, b.j AS j, round(sum(m.v * b.v), 6) AS v FROM m JOIN b USING (i) GROUP BY m.j, b.j")
def transposed_product(spark, sf):
    m = _coo(spark, sf)
    b = m.select("i").distinct().select("i", F.lit(0).cast("long").alias("j"), (F.col("i") % 4).cast("double").alias("v"))
    return rounded(linalg.tmm(m, b).withColumn("i", F.col("i").cast("long")), v=6)


@query(f"WITH m AS {_COO} SELECT i, j, round(v * (i % 3) * (j + 1), 6) AS v FROM m")
def diagonal_scaling(spark, sf):
    m = _coo(spark, sf)
    left = linalg.diag_left(m.select("i").distinct().select("i", (F.col("i") % 3).cast("double").alias("v")), m)
    return rounded(linalg.diag_right(left, linalg.vector(range(1, 65), spark)).select("i", F.col("j").cast("long").alias("j"), "v"), v=6)


@query(f"WITH m AS {_COO} SELECT j, round(sum(v) / (SELECT count(*) FROM embeddings), 8) AS mean FROM m GROUP BY j")
def sparse_column_means(spark, sf):
    n = table(spark, sf, "embeddings").count()
    return rounded(linalg.column_means(_coo(spark, sf), n).withColumn("j", F.col("j").cast("long")), mean=8)


@query(f"WITH m AS {_COO} SELECT round(sum(a.v * b.v), 7) AS v FROM m a JOIN m b ON a.i = 0 AND b.i = 1 AND a.j = b.j")
def sparse_dot(spark, sf):
    m = _coo(spark, sf)
    return rounded(linalg.dot(linalg.row(m, 0), linalg.row(m, 1)), v=7)


@query(f"WITH m AS {_COO} SELECT i, 64::bigint AS width, count(*) AS stored, round(sum(v), 6) AS total FROM m GROUP BY i")
def dense_rows(spark, sf):
    d = linalg.dense(_coo(spark, sf), 64)
    total = F.aggregate("row", F.lit(0.0), lambda s, x: s + x)
    return rounded(d.select("i", F.size("row").cast("long").alias("width"), F.size(F.filter("row", lambda x: x != 0)).cast("long").alias("stored"), total.alias("total")), total=6)


@query("SELECT round(sum(embedding[k]::double * embedding[k]::double), 5) AS squared FROM embeddings, range(1, 65) AS r(k)")
def svd_frobenius(spark, sf):
    s = linalg.singular_values(linalg.coo(table(spark, sf, "embeddings"), "vec_id", "embedding"), 64, 64)
    return rounded(row(spark, squared=float((s * s).sum())), squared=5)


@query(f"""WITH e AS {_E4}, m AS (SELECT *, e0 - avg(e0) OVER () AS a, e1 - avg(e1) OVER () AS b FROM e), s AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb FROM m)
 SELECT round(sqrt((aa + bb) / 2 + sqrt((aa - bb) * (aa - bb) / 4 + ab * ab)), 7) AS s1, round(sqrt((aa + bb) / 2 - sqrt((aa - bb) * (aa - bb) / 4 + ab * ab)), 7) AS s2 FROM s""")
def pca_sigma(spark, sf):
    p = cluster.pca(e4(spark, sf), ["e0", "e1"])
    return rounded(row(spark, s1=float(p.sigma[0]), s2=float(p.sigma[1])), s1=7, s2=7)


# --- clustering and kernels ----------------------------------------------------------------------------

_CENTRES = np.array([[-0.1, -0.1], [0.1, 0.1], [0.2, -0.1]])
_D = ["(e0 + 0.1) * (e0 + 0.1) + (e1 + 0.1) * (e1 + 0.1)", "(e0 - 0.1) * (e0 - 0.1) + (e1 - 0.1) * (e1 - 0.1)", "(e0 - 0.2) * (e0 - 0.2) + (e1 + 0.1) * (e1 + 0.1)"]


@query(f"WITH d AS (SELECT vec_id, {_D[0]} AS d0, {_D[1]} AS d1, {_D[2]} AS d2 FROM {_E4}) SELECT vec_id, (CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END)::int AS cluster, round(least(d0, d1, d2), 8) AS distance2 FROM d")
def kmeans_assign(spark, sf):
    return rounded(cluster.assign(e4(spark, sf), ["e0", "e1"], _CENTRES).select("vec_id", "cluster", "distance2"), distance2=8)


_STEP0 = f"d AS (SELECT *, {_D[0]} AS d0, {_D[1]} AS d1, {_D[2]} AS d2 FROM {_E4}), a AS (SELECT *, (CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END)::int AS k FROM d), m AS (SELECT k, avg(e0) AS m0, avg(e1) AS m1 FROM a GROUP BY k)"
_STEP1 = ", b AS (SELECT vec_id, e0, e1, arg_min(k, (e0 - m0) * (e0 - m0) + (e1 - m1) * (e1 - m1)) AS k FROM (SELECT vec_id, e0, e1 FROM d) AS z, m GROUP BY vec_id, e0, e1), m2 AS (SELECT k, avg(e0) AS m0, avg(e1) AS m1 FROM b GROUP BY k)"


@query(f"WITH {_STEP0} SELECT k AS cluster, round(m0, 8) AS e0, round(m1, 8) AS e1 FROM m")
def kmeans_update(spark, sf):
    return rounded(cluster.update(cluster.assign(e4(spark, sf), ["e0", "e1"], _CENTRES), ["e0", "e1"]), e0=8, e1=8)


@query(f"WITH {_STEP0}{_STEP1} SELECT round(sum((b.e0 - m2.m0) * (b.e0 - m2.m0) + (b.e1 - m2.m1) * (b.e1 - m2.m1)), 6) AS cost FROM b JOIN m2 USING (k)")
def kmeans_cost(spark, sf):
    return rounded(row(spark, cost=cluster.kmeans(e4(spark, sf), ["e0", "e1"], _CENTRES, 1).cost), cost=6)


@query(f"WITH {_STEP0}{_STEP1} SELECT k::bigint AS cluster, round(m0, 7) AS e0, round(m1, 7) AS e1 FROM m2")
def kmeans_two_steps(spark, sf):
    r = cluster.kmeans(e4(spark, sf), ["e0", "e1"], _CENTRES, 1)
    return rounded(spark.createDataFrame([(k, float(c[0]), float(c[1])) for k, c in enumerate(r.centres)], "cluster long, e0 double, e1 double"), e0=7, e1=7)


@query()
def kmeans_restarts(spark, sf):
    r = cluster.kmeans_random(e4(spark, sf), E4, 5, 2, 4, "vec_id")
    return r.transform(e4(spark, sf), E4).groupBy("cluster").agg(F.count("*").alias("n"))


_DIST = f"(SELECT a.vec_id AS i, b.vec_id AS j, sqrt((a.e0 - b.e0) * (a.e0 - b.e0) + (a.e1 - b.e1) * (a.e1 - b.e1)) AS d FROM {_E4} a, {_E4} b)"
_MEDOID = f"d AS {_DIST}, a AS (SELECT i, arg_min(j, (d, j)) AS medoid, min(d) AS d FROM d WHERE j IN (0, 1, 2) GROUP BY i)"


def _assigned(rows: DataFrame, medoids: list) -> DataFrame:
    return cluster.medoid_assign(cluster.medoid_distances(rows, "vec_id", ["e0", "e1"], medoids), medoids)


@query(f"WITH {_MEDOID} SELECT i, medoid, round(d, 8) AS d FROM a")
def kmedoid_assign(spark, sf):
    return rounded(_assigned(e4(spark, sf), [0, 1, 2]), d=8)


@query(f"WITH {_MEDOID}, s AS (SELECT a.medoid, d.i, sum(d.d) AS s FROM d JOIN a USING (i) JOIN a b ON d.j = b.i AND a.medoid = b.medoid GROUP BY a.medoid, d.i) SELECT medoid, arg_min(i, (s, i)) AS new FROM s GROUP BY medoid")
def kmedoid_recenter(spark, sf):
    rows = e4(spark, sf)
    return cluster.medoid_recenter_rows(rows, "vec_id", ["e0", "e1"], _assigned(rows, [0, 1, 2]))


def _kmedoid_sql(steps: int = 12) -> str:
    """Alternating assignment and recentring; the step before the first that costs no less counts."""
    out = [f"d AS MATERIALIZED (SELECT a.vec_id AS i, b.vec_id AS j, sqrt((a.e0 - b.e0) * (a.e0 - b.e0) + (a.e1 - b.e1) * (a.e1 - b.e1)) AS d FROM {_E4} a, {_E4} b)", "m0 AS MATERIALIZED (SELECT unnest([0, 1, 2])::bigint AS j)"]
    for t in range(steps):
        out.append(f"a{t} AS MATERIALIZED (SELECT i, arg_min(d.j, (d, d.j)) AS medoid, min(d) AS d FROM d JOIN m{t} ON m{t}.j = d.j GROUP BY i)")
        out.append(f"m{t + 1} AS MATERIALIZED (SELECT arg_min(i, (s, i)) AS j FROM (SELECT x.medoid, d.i, sum(d.d) AS s FROM d JOIN a{t} x USING (i) JOIN a{t} y ON d.j = y.i AND x.medoid = y.medoid GROUP BY x.medoid, d.i) GROUP BY medoid)")
    out.append("c AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT {t} AS t, sum(d) AS c FROM a{t}" for t in range(steps)) + ")")
    out.append("b AS MATERIALIZED (SELECT min(t) AS t FROM (SELECT t, c, lead(c) OVER (ORDER BY t) AS e FROM c) WHERE e >= c - 1e-12)")
    out.append("r AS (" + " UNION ALL ".join(f"SELECT {t} AS t, * FROM a{t}" for t in range(steps)) + ")")
    return f"WITH {', '.join(out)} SELECT medoid, count(*) AS n, round(sum(d), 6) AS cost FROM r JOIN b USING (t) GROUP BY medoid"


@query(_kmedoid_sql())
def kmedoid_fit(spark, sf):
    rows = e4(spark, sf)
    out = _assigned(rows, cluster.kmedoid_rows(rows, "vec_id", ["e0", "e1"], [0, 1, 2], 20).medoids)
    return rounded(out.groupBy("medoid").agg(F.count("*").alias("n"), F.sum("d").alias("cost")), cost=6)


@query(f"SELECT vec_id, round(exp(-({_D[0]}) / (2 * 0.02)), 8) AS rbf_0, round(exp(-({_D[1]}) / (2 * 0.02)), 8) AS rbf_1, round(exp(-({_D[2]}) / (2 * 0.025)), 8) AS rbf_2 FROM {_E4}")
def rbf_features(spark, sf):
    # Half the squared distance of centres 1 and 2 to their nearest is 0.025; of centre 0 it is 0.04; given widths are used here.
    out = kernels.rbf_features(e4(spark, sf), ["e0", "e1"], _CENTRES, np.array([0.02, 0.02, 0.025]))
    return rounded(out.select("vec_id", "rbf_0", "rbf_1", "rbf_2"), rbf_0=8, rbf_1=8, rbf_2=8)


@query(f"WITH c AS (SELECT vec_id, e0, e1 FROM {_E4} WHERE vec_id < 5) SELECT a.vec_id, round(min((a.e0 - b.e0) * (a.e0 - b.e0) + (a.e1 - b.e1) * (a.e1 - b.e1)) / 2, 9) AS bandwidth FROM c a JOIN c b ON a.vec_id <> b.vec_id GROUP BY a.vec_id")
def rbf_bandwidth(spark, sf):
    _, b = kernels.rbf_centres(e4(spark, sf), ["e0", "e1"], "vec_id", list(range(5)))
    return rounded(spark.createDataFrame([(i, float(v)) for i, v in enumerate(b)], "vec_id long, bandwidth double"), bandwidth=9)


@query("SELECT a.vec_id, round(acos(greatest(-1, least(1, list_dot_product(a.embedding::double[], b.embedding::double[]) / sqrt(list_dot_product(a.embedding::double[], a.embedding::double[]) * list_dot_product(b.embedding::double[], b.embedding::double[]))))) / pi(), 7) AS angle FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def angular_distance(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return rounded(e.join(b, "vec_id").select("vec_id", kernels.angular_arrays(F.col("embedding"), F.col("other")).alias("angle")), angle=7)


@query("SELECT a.vec_id, round(list_distance(a.embedding::double[], b.embedding::double[]), 7) AS d FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def euclid_distance(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return rounded(e.join(b, "vec_id").select("vec_id", kernels.euclid_arrays(F.col("embedding"), F.col("other")).alias("d")), d=7)


# --- diagnostics ------------------------------------------------------------------------------------------


@query("SELECT round(0.5 / median(l_discount * 10), 8) AS lambda FROM lineitem")
def qq_lambda(spark, sf):
    return rounded(diagnostics.qq_lambda(table(spark, sf, "lineitem").withColumn("p", F.col("l_discount") * 10), "p"), **{"lambda": 8})


@query("WITH r AS (SELECT l_tax * 12 AS p, row_number() OVER (ORDER BY l_tax * 12) AS rn, count(*) OVER () AS n FROM lineitem) SELECT round(avg((p - rn / n) * (p - rn / n)), 8) AS error FROM r")
def qq_error(spark, sf):
    df = table(spark, sf, "lineitem").select((F.col("l_tax") * 12).alias("p"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("k"))
    return rounded(diagnostics.qq_error(df, "p", "k"), error=8)


@query("""WITH b AS (SELECT min(c_acctbal) AS lo, (max(c_acctbal) - min(c_acctbal)) / 8 AS w FROM customer) SELECT least(7, floor((c_acctbal - lo) / w))::bigint AS bin, count(*) AS n FROM customer, b GROUP BY 1""")
def histogram(spark, sf):
    return diagnostics.histogram(table(spark, sf, "customer"), "c_acctbal", 8).select("bin", "n")


# --- splits and candidates ----------------------------------------------------------------------------------


@query("SELECT c_custkey, floor((row_number() OVER (ORDER BY c_custkey) - 1) / (floor((SELECT count(*) FROM customer) / 7) + 1))::int AS fold FROM customer")
def kfold(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey")
    place = selection.position(df, "c_custkey", order=F.col("c_custkey"))
    return selection.k_fold(place.withColumnRenamed("position", "at"), "c_custkey", 7, place=F.col("at")).select("c_custkey", "fold")


@query("SELECT c_custkey, c_mktsegment, ((row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1) % 5)::int AS fold FROM customer")
def kfold_stratified(spark, sf):
    return selection.k_fold_stratified(table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", 5, "c_mktsegment", order=F.col("c_custkey"))


@query("SELECT floor(count(*) * 0.7)::bigint AS train, count(*) - floor(count(*) * 0.7)::bigint AS test FROM customer")
def split_ratio(spark, sf):
    s = selection.split(table(spark, sf, "customer"), "c_custkey", 0.7)
    return s.agg(F.count_if("is_train").alias("train"), F.count_if(~F.col("is_train")).alias("test"))


@query("SELECT k AS i, round(exp(-2 + k * 4.0 / 4), 8) AS value FROM range(5) AS r(k)")
def grid_candidates(spark, sf):
    return rounded(spark.createDataFrame([(i, float(v)) for i, v in enumerate(selection.grid(-2, 2, 5))], "i long, value double"), value=8)


@query("SELECT k AS i, round(exp(-2 + k * 4.0 / 2), 8) AS a, round(exp(k * 1.0), 8) AS b FROM range(3) AS r(k)")
def zip_candidates(spark, sf):
    z = selection.zipped(selection.grid(-2, 2, 3), selection.grid(0, 2, 3))
    return rounded(spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(z)], "i long, a double, b double"), a=8, b=8)


# --- models as files -------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, greatest(1.0, round(10 ** log10(o_totalprice + 1) - 1, 2)) AS prediction, CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END AS decided FROM orders")
def back_transform(spark, sf):
    df = table(spark, sf, "orders").withColumn("p", F.log10(F.col("o_totalprice") + 1))
    return df.select("o_orderkey", F.greatest(F.lit(1.0), F.round(tables.from_log10_plus_1(F.col("p")), 2)).alias("prediction"), tables.decided(F.col("o_totalprice"), 100000.0).alias("decided"))


@query("SELECT vec_id, 64 AS size, len(list_filter(embedding, lambda x: x <> 0))::int AS stored, round(list_sum(embedding::double[]), 5) AS total FROM embeddings")
def sparse_rows(spark, sf):
    s = tables.sparse_rows(table(spark, sf, "embeddings"), "vec_id", "embedding")
    return rounded(s.select("vec_id", "size", F.size("indices").alias("stored"), F.aggregate("values", F.lit(0.0), lambda t, x: t + x).alias("total")), total=5)


from . import queries_fits, queries_parts  # noqa: E402, F401 - they register theirs
