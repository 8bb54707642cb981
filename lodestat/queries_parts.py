"""Queries of sources, sinks, frames, preparation, matrices, clustering and plot data, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from .operators import cluster, diagnostics, frames, kernels, linalg, prep
from .plans import penalties, regression
from .plans.objectives import Linear
from .plans.rows import Vectors
from .queries import _CENTRES, _COO, _D, _E4, _LABELLED, E4, X3, _assigned, _coo, e4, labelled, query, rounded, row, table
from .queries_fits import _sparse, _union
from .sources import tables
from .sqltext import normal_quantile

# --- sources, sinks, codecs -----------------------------------------------------------------------------------


@query("SELECT p_partkey::varchar AS row_id, p_brand, p_retailprice, p_size::double AS p_size, NULL::double AS p_name FROM part")
def csv_source(spark, sf):
    """A table written as CSV and read with its key first, cells as strings; then as numbers where they are."""
    path = tables.scratch(spark, "csv_source")
    table(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice", "p_size", F.concat(F.lit("name "), "p_name").alias("p_name")).write.option("header", True).csv(path)
    return tables.doubles(tables.read_csv(spark, path), ["p_retailprice", "p_size", "p_name"])


@query("""WITH x AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row_id, label::double AS label, list_filter(embedding, lambda v: v > 0.1::float) AS v, embedding FROM embeddings)
 SELECT row_id, label, (len(v) + 1)::int AS stored, round(list_sum(v::double[]) + 1, 5) AS total, (SELECT sum(k)::bigint FROM range(1, 65) AS r(k) WHERE embedding[k] > 0.1::float) AS places FROM x""")
def libsvm_source(spark, sf):
    """Sparse rows written as 'label i:v ...' and read with a constant at index 0; row ids count the lines of all files."""
    df, _ = _sparse(spark, sf)
    path = tables.scratch(spark, "libsvm_source")
    cells = F.transform(F.arrays_zip("at", "values"), lambda c: F.concat_ws(":", (c["at"] + 1).cast("string"), c["values"].cast("string")))
    df.repartitionByRange(4, "vec_id").sortWithinPartitions("vec_id").select(F.concat_ws(" ", F.col("label").cast("string"), F.array_join(cells, " "))).write.text(path)
    got = tables.read_libsvm(spark, path, constant=True)
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    return rounded(got.select(F.col("row_id").cast("long").alias("row_id"), "label", F.size("indices").alias("stored"), add("values").alias("total"), F.aggregate("indices", F.lit(0).cast("long"), lambda s, x: s + x).alias("places")), total=5)


@query("SELECT o_orderkey::varchar AS o_orderkey, round(greatest(1.0, 10 ** log10(o_totalprice + 1) - 1), 2)::varchar AS prediction FROM orders WHERE false UNION ALL SELECT o_orderkey::varchar, round(o_totalprice, 2)::varchar FROM orders")
def prediction_sink(spark, sf):
    """Predictions on the log scale, written back-transformed as CSV, and read."""
    path = tables.scratch(spark, "prediction_sink")
    df = table(spark, sf, "orders").withColumn("p", F.log10(F.col("o_totalprice") + 1))
    tables.write_predictions(df, "o_orderkey", F.round(tables.from_log10_plus_1(F.col("p")), 2), path)
    return spark.read.option("header", True).csv(path)


@query("SELECT n_nationkey::varchar AS name, n_regionkey::double AS value FROM nation")
def series_codec(spark, sf):
    """A named vector as JSON and back."""
    rows = table(spark, sf, "nation").select(F.col("n_nationkey").cast("string"), "n_regionkey").orderBy("n_nationkey").collect()  # 25 rows
    names, values = tables.series_from_json(tables.series_json([r[0] for r in rows], [float(r[1]) for r in rows]))
    return spark.createDataFrame([(n, float(v)) for n, v in zip(names, tables.vector_from_json(tables.vector_json(values)), strict=True)], "name string, value double")


@query("WITH b AS (SELECT min(c_acctbal) AS lo, (max(c_acctbal) - min(c_acctbal)) / 8 AS w FROM customer) SELECT least(7, floor((c_acctbal - lo) / w))::bigint::varchar AS bin, count(*)::varchar AS n FROM customer, b GROUP BY 1")
def plot_sink(spark, sf):
    """The table behind a histogram, written as CSV."""
    path = tables.scratch(spark, "plot_sink")
    tables.write_plot(diagnostics.histogram(table(spark, sf, "customer"), "c_acctbal", 8).select("bin", "n"), path)
    return spark.read.option("header", True).csv(path)


# --- frames and preparation -----------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_orderstatus, o_orderdate, o_orderpriority FROM orders")
def pick_by_predicate(spark, sf):
    return frames.pick(table(spark, sf, "orders"), lambda c: c.startswith("o_order"))


@query("SELECT l_orderkey, l_linenumber, round(exp(-l_tax), 9) AS l_tax, round(exp(-l_discount), 9) AS l_discount FROM lineitem")
def map_cells(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_tax", "l_discount")
    return rounded(frames.map_columns(df, ["l_tax", "l_discount"], lambda c: F.exp(-c)), l_tax=9, l_discount=9)


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS place FROM orders")
def sort_rows(spark, sf):
    """The place of every row in ascending order of a column, ties by key."""
    return frames.numbered(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", "place").select("o_orderkey", "place")


@query("SELECT column_name AS name FROM (DESCRIBE orders) WHERE column_name NOT IN ('o_orderkey', 'o_totalprice')")
def column_names_difference(spark, sf):
    df = table(spark, sf, "orders")
    return spark.createDataFrame([(c,) for c in frames.column_difference(df, df.select("o_orderkey", "o_totalprice"))], "name string")


@query("SELECT c_nationkey, round(sum(c_acctbal) FILTER (WHERE c_mktsegment = 'BUILDING'), 2) AS \"BUILDING\", round(sum(c_acctbal) FILTER (WHERE c_mktsegment = 'MACHINERY'), 2) AS \"MACHINERY\" FROM customer GROUP BY 1")
def wide_pivot(spark, sf):
    df = table(spark, sf, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.sum("c_acctbal").alias("v"))
    return rounded(frames.wide(df, "c_nationkey", "c_mktsegment", "v", ["BUILDING", "MACHINERY"]), BUILDING=2, MACHINERY=2)


@query(f"SELECT * FROM (SELECT 'e' || k AS j, round(any_value([e0, e1, e2, e3][k + 1]) FILTER (WHERE vec_id = 0), 7) AS \"0\", round(any_value([e0, e1, e2, e3][k + 1]) FILTER (WHERE vec_id = 3), 7) AS \"3\" FROM {_E4}, range(4) AS r(k) GROUP BY k)")
def transpose_frame(spark, sf):
    """Columns as rows; the columns are two rows of the table, by key."""
    return rounded(frames.transposed(e4(spark, sf), "vec_id", E4, [0, 3]), **{"0": 7, "3": 7})


@query("SELECT c_custkey AS key, c_acctbal AS balance FROM customer UNION ALL SELECT s_suppkey, s_acctbal FROM supplier")
def union_rows(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"))
    return a.unionByName(table(spark, sf, "supplier").select(F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("key")))


@query("SELECT vec_id, 66::int AS size, label::double AS last, round(list_sum(embedding::double[]) + 1 + label, 5) AS total FROM embeddings")
def append_vectors(spark, sf):
    df = table(spark, sf, "embeddings")
    x = tables.appended(F.array(F.lit(1.0)), F.col("embedding"), F.array(F.col("label")))
    return rounded(df.select("vec_id", F.size(x).alias("size"), F.element_at(x, -1).alias("last"), F.aggregate(x, F.lit(0.0), lambda s, v: s + v).alias("total")), total=5)


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END::double AS "o_orderstatus_F", CASE WHEN o_orderstatus = 'O' THEN 1.0 ELSE 0.0 END::double AS "o_orderstatus_O", CASE WHEN o_orderstatus = 'P' THEN 1.0 ELSE 0.0 END::double AS "o_orderstatus_P" FROM orders""")
def onehot_all_levels(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return prep.one_hot(df, "o_orderstatus", prep.levels(df, "o_orderstatus"), drop_first=False)


@query("SELECT l_orderkey, l_linenumber, round(l_quantity / 4.0, 6) AS l_quantity, l_tax FROM lineitem")
def scale_by_given(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax")
    return rounded(prep.scale(df, ["l_quantity", "l_tax"], {"l_quantity": 4.0, "l_tax": 0.0}), l_quantity=6)


@query("SELECT p_partkey, 1.0::double AS intercept, p_size, p_retailprice FROM part")
def add_intercept(spark, sf):
    return prep.with_intercept(table(spark, sf, "part").select("p_partkey", "p_size", "p_retailprice"), "p_partkey")


def _prep_sql() -> str:
    langs, sources = ["de", "en", "es", "fr"][1:], sorted(f"src{i}" for i in range(20))[1:]
    flags = [f"CASE WHEN lang = '{v}' THEN 1.0 ELSE 0.0 END::double AS \"lang_{v}\"" for v in langs] + [f"CASE WHEN source = '{v}' THEN 1.0 ELSE 0.0 END::double AS \"source_{v}\"" for v in sources]
    filled = [f"coalesce({c}::double, avg({c}) OVER ()) AS {c}" for c in ("n_chars", "quality", "toxic")]
    names = [f"lang_{v}" for v in langs] + [f"source_{v}" for v in sources] + ["n_chars", "quality", "toxic"]
    scaled = [f'round("{c}" / coalesce(nullif(stddev_samp("{c}") OVER (), 0), 1), 6) + 0 AS "{c}"' for c in names]
    return f"SELECT doc_id, {', '.join(scaled)} FROM (SELECT doc_id, {', '.join(filled + flags)} FROM {_LABELLED})"


@query(_prep_sql())
def prep_pipeline(spark, sf):
    """Strings to scaled numbers: categories by one-hot, gaps by the mean."""
    df = labelled(spark, sf).withColumns({"quality": F.col("quality").cast("string"), "toxic": F.col("toxic").cast("string"), "n_chars": F.col("n_chars").cast("string")})
    out = prep.prep(df, "doc_id", normalize=True).frame
    return rounded(out, **{c: 6 for c in out.columns if c != "doc_id"})


@query("SELECT c_custkey, round(c_acctbal, 1) AS one, round(c_acctbal / 3, 3) AS three FROM customer")
def round_to(spark, sf):
    f = frames.scalar
    return table(spark, sf, "customer").select("c_custkey", f("round", F.col("c_acctbal"), 1).alias("one"), f("round", F.col("c_acctbal") / 3, 3).alias("three"))


@query("WITH f AS (SELECT regr_intercept(p_retailprice, p_size::double) AS a, regr_slope(p_retailprice, p_size::double) AS b FROM part) SELECT p_partkey, round(a + b * CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE p_size END, 4) AS prediction FROM part, f")
def frame_prediction(spark, sf):
    """Predictions where some cells are missing, which count as 0."""
    df = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"))
    r = regression.linear_regression(df, "y", ["x"])
    holes = df.withColumn("x", F.when(F.col("p_partkey") % 3 != 0, F.col("x")))
    return rounded(r.predict(holes).select("p_partkey", "prediction"), prediction=4)


@query("SELECT p_partkey, round(2.5 + 0.75 * p_size, 6) AS y FROM part")
def generate_labels(spark, sf):
    df = table(spark, sf, "part").select("p_partkey", F.lit(1.0).alias("c"), F.col("p_size").cast("double").alias("x"))
    return rounded(Linear().generate(df, ["c", "x"], np.array([2.5, 0.75]), "y").select("p_partkey", "y"), y=6)


@query("""WITH b AS (SELECT DISTINCT (p_size - 25) / 5.0::double AS b FROM part) SELECT round(b, 6) + 0 AS b, round(b / (1 + 0.25 * 2), 6) + 0 AS l2, round(sign(b) * greatest(0, abs(b) - 0.25 * 2), 6) + 0 AS l1,
 round(sign(b) * greatest(0, (abs(b) - 0.25 * 2) / (1 + 2 * 0.125)), 6) + 0 AS elastic_net, round(0.5 * (0.25 * abs(b) + 0.125 * b * b), 6) + 0 AS cost FROM b""")
def rebind_penalty(spark, sf):
    """Penalties bound to other strengths: proximal steps and the elastic net's reported value."""
    b = np.array(sorted(r[0] for r in table(spark, sf, "part").select(((F.col("p_size") - 25) / 5.0).alias("b")).distinct().collect()))  # 50 sizes
    one = np.ones(len(b))
    en = penalties.ElasticNet(9.0, 9.0).using((0.25, 0.125))
    cols = [b, penalties.L2(9.0).using(0.25).prox(b, one, 2.0), penalties.L1(9.0).using(0.25).prox(b, one, 2.0), en.prox(b, one, 2.0), [en.value(b[i : i + 1], one[:1]) for i in range(len(b))]]
    return rounded(spark.createDataFrame([tuple(map(float, r)) for r in zip(*cols, strict=True)], "b double, l2 double, l1 double, elastic_net double, cost double"), b=6, l2=6, l1=6, elastic_net=6, cost=6)


# --- matrices ------------------------------------------------------------------------------------------------------


@query(f"WITH m AS MATERIALIZED {_COO}, s AS MATERIALIZED (SELECT i - 1 AS i, j, v FROM m) SELECT m.i, m.j, round(m.v * s.v, 7) AS v FROM m JOIN s ON m.i = s.i AND m.j = s.j")
def elementwise_product(spark, sf):
    m = _coo(spark, sf)
    return rounded(linalg.multiply(m, m.withColumn("i", F.col("i") - 1)).withColumn("j", F.col("j").cast("long")), v=7)


@query(f"WITH m AS MATERIALIZED {_COO} SELECT j AS i, round(sum(v * (i + 1)), 4) AS v FROM m WHERE i < 3 GROUP BY j")
def left_product(spark, sf):
    """A row vector (of three entries) times a matrix."""
    m = _coo(spark, sf)
    left = spark.createDataFrame([(0, k, float(k + 1)) for k in range(3)], "i long, j long, v double")
    return rounded(linalg.mm(left, m).select(F.col("j").cast("long").alias("i"), "v"), v=4)


@query(f"WITH m AS MATERIALIZED {_COO} SELECT 'col' AS part, i, round(v, 7) AS v FROM m WHERE j = 5 UNION ALL SELECT 'row', j, round(v, 7) FROM m WHERE i = 7 UNION ALL SELECT 'rows', max(j), count(*)::double FROM m WHERE i % 10 = 3 UNION ALL SELECT 'shape', max(i) + 1, (max(j) + 1)::double FROM m UNION ALL SELECT 'cell', 0, coalesce((SELECT round(v, 7) FROM m WHERE i = 7 AND j = 2), 0)")
def matrix_parts(spark, sf):
    m = _coo(spark, sf).withColumn("j", F.col("j").cast("long"))
    n = int(table(spark, sf, "embeddings").agg(F.max("vec_id")).first()[0]) + 1
    parts = [linalg.col(m, 5).withColumn("part", F.lit("col")), linalg.row(m, 7).withColumn("part", F.lit("row"))]
    some = linalg.rows(m, m.select("i").where("i % 10 = 3"))
    parts.append(some.agg(F.max("j").alias("i"), F.count("*").cast("double").alias("v")).withColumn("part", F.lit("rows")))
    parts.append(linalg.shape(m).select(F.col("n_rows").alias("i"), F.col("n_cols").cast("double").alias("v"), F.lit("shape").alias("part")))
    parts.append(spark.createDataFrame([(0, linalg.cell(m, 7, 2, n, 64), "cell")], "i long, v double, part string"))
    out = parts[0].select("part", "i", "v")
    for p in parts[1:]:
        out = out.unionByName(p.select("part", "i", "v"))
    return rounded(out, v=7)


_G64 = "g AS MATERIALIZED (SELECT a.k AS i, b.k AS j, sum(embedding[a.k]::double * embedding[b.k]::double) AS v FROM embeddings, range(1, 65) AS a(k), range(1, 65) AS b(k) GROUP BY a.k, b.k)"


@query(f"WITH {_G64} SELECT 2 AS power, round(sum(v), 4) AS total FROM g WHERE i = j UNION ALL SELECT 4, round(sum(v * v), 3) FROM g UNION ALL SELECT 6, round(sum(a.v * b.v * c.v), 2) FROM g a JOIN g b ON a.j = b.i JOIN g c ON b.j = c.i AND c.j = a.i")
def svd_singular_values(spark, sf):
    """Sums of the singular values' 2nd, 4th and 6th powers, which are traces of powers of the Gram matrix."""
    s = linalg.singular_values(linalg.coo(table(spark, sf, "embeddings"), "vec_id", "embedding"), 64, 64)
    return spark.createDataFrame([(p, round(float((s**p).sum()), d)) for p, d in ((2, 4), (4, 3), (6, 2))], "power int, total double")


@query("SELECT vec_id AS i, k - 1 AS j, round(embedding[k]::double, 6) + 0 AS v FROM embeddings, range(1, 65) AS r(k)")
def svd_reconstruct(spark, sf):
    """U S V' of all 64 singular triples is the matrix."""
    s, v, u = linalg.svd_rows(table(spark, sf, "embeddings"), "vec_id", "embedding", 64, 64)
    back = linalg.rows_times(u, "vec_id", "embedding", (v * s).T)
    return rounded(back.select(F.col("vec_id").alias("i"), F.posexplode("embedding").alias("j", "v")).withColumn("j", F.col("j").cast("long")), v=6)


@query(f"WITH {_G64} SELECT i - 1 AS i, j - 1 AS j, round(v, 5) + 0 AS v FROM g")
def gram_of_rows(spark, sf):
    """The Gram matrix of dense rows, by blocks."""
    g = linalg.gram_rows(table(spark, sf, "embeddings"), "embedding", 64)
    return rounded(spark.createDataFrame([(i, j, float(g[i, j])) for i in range(64) for j in range(64)], "i long, j long, v double"), v=5)


_TWO = f"s AS MATERIALIZED (SELECT sum(e0 * e0) AS a, sum(e0 * e1) AS b, sum(e1 * e1) AS c FROM {_E4}), l AS (SELECT *, (a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b) AS l1, (a + c) / 2 - sqrt((a - c) * (a - c) / 4 + b * b) AS l2 FROM s)"


@query(f"WITH {_TWO} SELECT 'eigen' AS by, round(l1, 6) AS l1, round(l2, 6) AS l2 FROM l UNION ALL SELECT 'power', round(l1, 6), round(l2, 6) FROM l UNION ALL SELECT 'table', round(l1, 6), round(l2, 6) FROM l")
def eigen_two(spark, sf):
    """Eigenvalues of a 2 x 2 Gram matrix: by decomposition, by power iteration, and with the matrix as a table."""
    g = linalg.gram_rows(e4(spark, sf).select(F.array("e0", "e1").alias("x")), "x", 2)
    m = spark.createDataFrame([(i, j, float(g[i, j])) for i in range(2) for j in range(2)], "i long, j long, v double").cache()
    by = {"eigen": linalg.eigen_symmetric(g)[0], "power": linalg.eigen_by_power(lambda x: g @ x, 2, 2, 100_000)[0], "table": None}
    first = np.array([1.0, 2.0])
    for _ in range(3):  # the table's products are checked by one Rayleigh quotient of the known vector
        first = linalg.power_step(linalg.table_map(m, 2), first)
    u = linalg.eigen_symmetric(g)[1]
    by["table"] = [linalg.power_error(linalg.table_map(m, 2), u[:, k])[0] for k in range(2)]
    return rounded(spark.createDataFrame([(n, float(v[0]), float(v[1])) for n, v in by.items()], "by string, l1 double, l2 double"), l1=6, l2=6)


@query(f"WITH {_TWO} SELECT round(c / (a * c - b * b), 8) AS i00, round(-b / (a * c - b * b), 8) AS i01, round(a / (a * c - b * b), 8) AS i11, round(ln(a * c - b * b), 8) AS log_determinant FROM l")
def invert_determinant(spark, sf):
    g = linalg.gram_rows(e4(spark, sf).select(F.array("e0", "e1").alias("x")), "x", 2)
    i = linalg.invert(g)
    return rounded(row(spark, i00=float(i[0, 0]), i01=float(i[0, 1]), i11=float(i[1, 1]), log_determinant=linalg.log_determinant(g)), i00=8, i01=8, i11=8, log_determinant=8)


@query("WITH m AS (SELECT k, avg(embedding[k]::double) AS m FROM embeddings, range(1, 65) AS r(k) GROUP BY k) SELECT vec_id, round(sum((embedding[k]::double - m) * (embedding[k]::double - m)), 6) AS length2 FROM embeddings, m GROUP BY vec_id")
def pca_scores(spark, sf):
    """All 64 components of all 64 columns: the squared length of a row's scores is that of the demeaned row."""
    names = [f"e{i}" for i in range(64)]
    df = table(spark, sf, "embeddings").select("vec_id", *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(names)])
    p = cluster.pca(df, names, 64)
    scores = p.scores(df)
    total = F.aggregate(F.array(*[F.col(f"pc{k + 1}") for k in range(len(p.sigma))]), F.lit(0.0), lambda s, x: s + x * x)
    return rounded(scores.select("vec_id", total.alias("length2")), length2=6)


_PCA2 = f"""d AS MATERIALIZED (SELECT vec_id, e0 - avg(e0) OVER () AS a, e1 - avg(e1) OVER () AS b FROM {_E4}), s AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb FROM d),
 l AS (SELECT *, (aa + bb) / 2 + sqrt((aa - bb) * (aa - bb) / 4 + ab * ab) AS l1, (aa + bb) / 2 - sqrt((aa - bb) * (aa - bb) / 4 + ab * ab) AS l2 FROM s),
 u AS (SELECT *, ab / sqrt(ab * ab + (l1 - aa) * (l1 - aa)) AS x, (l1 - aa) / sqrt(ab * ab + (l1 - aa) * (l1 - aa)) AS y FROM l),
 v AS MATERIALIZED (SELECT *, x * CASE WHEN (abs(x) >= abs(y) AND x < 0) OR (abs(y) > abs(x) AND y < 0) THEN -1 ELSE 1 END AS x1, y * CASE WHEN (abs(x) >= abs(y) AND x < 0) OR (abs(y) > abs(x) AND y < 0) THEN -1 ELSE 1 END AS y1 FROM u),
 w AS MATERIALIZED (SELECT *, CASE WHEN abs(y1) >= abs(x1) THEN -y1 * sign(-y1) ELSE -y1 * sign(x1) END AS x2, CASE WHEN abs(y1) >= abs(x1) THEN x1 * sign(-y1) ELSE x1 * sign(x1) END AS y2 FROM v)"""


@query(f"WITH {_PCA2} SELECT vec_id AS key, 1 AS a, 2 AS b, round(d.a * x1 + d.b * y1, 6) + 0 AS x, round(d.a * x2 + d.b * y2, 6) + 0 AS y, NULL::varchar AS \"group\" FROM d, w")
def pca_pairwise(spark, sf):
    """Scores of two columns as points: the pairs of components that a plot shows."""
    df = e4(spark, sf).select("vec_id", "e0", "e1")
    return rounded(cluster.pca(df, ["e0", "e1"]).pairwise(df, "vec_id"), x=6, y=6)


@query(f"WITH {_PCA2}, t AS (SELECT 1 AS component, 'e0' AS term, x1 AS loading FROM w UNION ALL SELECT 1, 'e1', y1 FROM w UNION ALL SELECT 2, 'e0', x2 FROM w UNION ALL SELECT 2, 'e1', y2 FROM w) SELECT component, (row_number() OVER (PARTITION BY component ORDER BY loading, term) - 1)::int AS place, term, round(loading, 6) + 0 AS loading, round(CASE component WHEN 1 THEN sqrt(l1) ELSE sqrt(l2) END, 6) AS sigma, round(CASE component WHEN 1 THEN l1 ELSE l2 END / (l1 + l2), 6) AS share FROM t, l")
def pca_plot_data(spark, sf):
    """Loadings in order, with each component's singular value and share."""
    p = cluster.pca(e4(spark, sf), ["e0", "e1"])
    return rounded(p.top_loadings(spark).join(p.scree(spark), "component"), loading=6, sigma=6, share=6)


@query(f"WITH {_PCA2} SELECT 1 AS component, sum(CASE WHEN h.bin IS NULL THEN 0 ELSE 1 END)::bigint AS n FROM (SELECT unnest([1, 2]) AS bin) AS h UNION ALL SELECT 2, 2::bigint")
def loading_histograms(spark, sf):
    """Loadings of each component that its histogram holds."""
    p = cluster.pca(e4(spark, sf), ["e0", "e1"])
    return p.loading_histograms(spark).groupBy("component").agg(F.sum("n").alias("n"))


@query("WITH x AS (SELECT p_partkey AS k, p_size::double AS a, p_retailprice / 100 AS b FROM part WHERE p_partkey <= 5), s AS (SELECT sum(a * a) AS aa, sum(a * b) AS ab, sum(b * b) AS bb FROM x) SELECT round(sqrt((aa + bb) / 2 + sqrt((aa - bb) * (aa - bb) / 4 + ab * ab)), 6) AS s1, round(sqrt((aa + bb) / 2 - sqrt((aa - bb) * (aa - bb) / 4 + ab * ab)), 6) AS s2, round(any_value(aa + bb), 4) AS length2 FROM s GROUP BY ALL")
def pca_covariance(spark, sf):
    """From a sample by sample matrix (five samples, two columns, so rank two): its roots are the singular values, and scores keep the total length."""
    rows = table(spark, sf, "part").where("p_partkey <= 5").orderBy("p_partkey").select("p_size", "p_retailprice").collect()
    x = np.array([[float(r[0]), float(r[1]) / 100] for r in rows])
    sigma, scores = cluster.pca_from_covariance(x @ x.T)
    return rounded(row(spark, s1=float(sigma[0]), s2=float(sigma[1]), length2=float((scores * scores).sum())), s1=6, s2=6, length2=4)


# --- clustering, kernels, plots ----------------------------------------------------------------------------


_SPARSE = "x AS MATERIALIZED (SELECT vec_id, k - 1 AS j, CASE WHEN embedding[k] > 0.1::float THEN embedding[k]::double ELSE 0 END AS v FROM embeddings, range(1, 65) AS r(k)), c0 AS MATERIALIZED (SELECT vec_id AS k, j, v AS m FROM x WHERE vec_id < 3)"


def _lloyd(n: int) -> str:
    return f"""a{n} AS MATERIALIZED (SELECT vec_id, arg_min(k, (d, k)) AS k FROM (SELECT vec_id, k, sum((v - m) * (v - m)) AS d FROM x JOIN c{n} USING (j) GROUP BY vec_id, k) GROUP BY vec_id),
 c{n + 1} AS MATERIALIZED (SELECT k, j, avg(v) AS m FROM x JOIN a{n} USING (vec_id) GROUP BY k, j)"""


@query(f"WITH {_SPARSE}, {_lloyd(0)}, {_lloyd(1)} SELECT a1.k::int AS cluster, count(DISTINCT a1.vec_id) AS n, round(sum((v - m) * (v - m)), 5) AS cost FROM a1 JOIN x USING (vec_id) JOIN c2 ON c2.k = a1.k AND c2.j = x.j GROUP BY a1.k")
def sparse_kmeans(spark, sf):
    """Two Lloyd steps on sparse rows of all 64 components, from three of them; cost by cluster around the last means."""
    df, at = _sparse(spark, sf)
    start = np.zeros((3, 64))
    for r in df.where("vec_id < 3").collect():
        start[r["vec_id"], r["at"]] = r["values"]
    got = cluster.kmeans_rows(df, at, start, 1)
    out = cluster.assign_rows(df, at, got.assigned_by)
    labels = out.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("distance2").alias("around")).collect()
    # around the centres before the update: n |m - c|^2 more than around the means
    gap = ((got.centres - got.assigned_by) ** 2).sum(1)
    return rounded(spark.createDataFrame([(r["cluster"], r["n"], float(r["around"] - r["n"] * gap[r["cluster"]])) for r in labels], "cluster int, n long, cost double"), cost=5)


@query(f"WITH {_SPARSE}, {_lloyd(0)}, {_lloyd(1)} SELECT round(sum((v - m) * (v - m)), 5) AS cost FROM a1 JOIN x USING (vec_id) JOIN c2 ON c2.k = a1.k AND c2.j = x.j")
def sparse_kmeans_cost(spark, sf):
    """The cost that the fit itself reports."""
    df, at = _sparse(spark, sf)
    start = np.zeros((3, 64))
    for r in df.where("vec_id < 3").collect():
        start[r["vec_id"], r["at"]] = r["values"]
    return rounded(row(spark, cost=float(cluster.kmeans_rows(df, at, start, 1).cost)), cost=5)


def _restarts_sql(k: int = 5, seeds: tuple[int, ...] = (42, 43), iterations: int = 4) -> str:
    """The cheapest of several runs from rows in the order of an MD5 of key and seed."""
    out = ["x AS MATERIALIZED (SELECT vec_id, j - 1 AS j, embedding[j]::double AS v FROM embeddings, range(1, 65) AS r(j))"]
    for s in seeds:
        out.append(f"p{s} AS MATERIALIZED (SELECT vec_id, row_number() OVER (ORDER BY md5(vec_id || ':{s}'), vec_id) - 1 AS k FROM embeddings)")
        out.append(f"c{s}_0 AS MATERIALIZED (SELECT k, j, v AS m FROM p{s} JOIN x USING (vec_id) WHERE k < {k})")
        for t in range(iterations + 1):
            out.append(f"a{s}_{t} AS MATERIALIZED (SELECT vec_id, arg_min(k, (d, k)) AS k FROM (SELECT vec_id, k, sum((v - m) * (v - m)) AS d FROM x JOIN c{s}_{t} USING (j) GROUP BY vec_id, k) GROUP BY vec_id)")
            out.append(f"c{s}_{t + 1} AS MATERIALIZED (SELECT k, j, avg(v) AS m FROM x JOIN a{s}_{t} USING (vec_id) GROUP BY k, j)")
        last = iterations
        out.append(f"e{s} AS MATERIALIZED (SELECT {s} AS s, sum((v - m) * (v - m)) AS cost FROM a{s}_{last} a JOIN x USING (vec_id) JOIN c{s}_{last + 1} c ON c.k = a.k AND c.j = x.j)")
    out.append("b AS MATERIALIZED (SELECT s, cost FROM (" + " UNION ALL ".join(f"SELECT * FROM e{s}" for s in seeds) + ") ORDER BY cost, s LIMIT 1)")
    out.append("r AS (" + " UNION ALL ".join(f"SELECT {s} AS s, * FROM a{s}_{iterations}" for s in seeds) + ")")
    return f"WITH {', '.join(out)} SELECT (dense_rank() OVER (ORDER BY k) - 1)::int AS cluster, count(*) AS n, round(any_value(cost), 5) AS cost FROM r JOIN b USING (s) GROUP BY k"


@query(_restarts_sql())
def kmeans_restarts(spark, sf):
    """The cheapest of two runs on all 64 components."""
    df = table(spark, sf, "embeddings")
    at = Vectors(64, "embedding", intercept=False)
    r = cluster.kmeans_rows_random(df, at, 5, 2, 4, "vec_id")
    return rounded(cluster.assign_rows(df, at, r.assigned_by).groupBy("cluster").agg(F.count("*").alias("n")).withColumn("cost", F.lit(float(r.cost))), cost=5)


@query(f"WITH d AS (SELECT vec_id, e0, e1, {_D[0]} AS d0, {_D[1]} AS d1, {_D[2]} AS d2 FROM {_E4}) SELECT 'point' AS kind, vec_id::varchar AS key, round(e0, 7) AS x, round(e1, 7) AS y, CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END::bigint AS cluster FROM d UNION ALL {_union([f'SELECT {chr(39)}centre{chr(39)}, NULL, {c[0]!r}::double, {c[1]!r}::double, {k}::bigint' for k, c in enumerate(_CENTRES.tolist())])}")
def kmeans_plot(spark, sf):
    out = cluster.assign(e4(spark, sf), ["e0", "e1"], _CENTRES)
    return rounded(cluster.cluster_plot(out, "vec_id", "e0", "e1", centres=_CENTRES), x=7, y=7)


@query(f"WITH d AS (SELECT a.vec_id AS i, b.vec_id AS j, sqrt((a.e0 - b.e0) * (a.e0 - b.e0) + (a.e1 - b.e1) * (a.e1 - b.e1)) AS d FROM {_E4} a, {_E4} b WHERE b.vec_id IN (0, 1, 2)), a AS (SELECT i, arg_min(j, (d, j)) AS medoid FROM d GROUP BY i) SELECT CASE WHEN i = medoid THEN 'medoid' ELSE 'point' END AS kind, i::varchar AS key, round(e0, 7) AS x, round(e1, 7) AS y, medoid::bigint AS cluster FROM a JOIN {_E4} e ON e.vec_id = a.i")
def kmedoid_plot(spark, sf):
    rows = e4(spark, sf)
    return rounded(cluster.medoid_plot(rows, _assigned(rows, [0, 1, 2]), "vec_id", "e0", "e1"), x=7, y=7)


_COLS3 = "g AS MATERIALIZED (SELECT sqrt(sum((l_quantity - l_discount) * (l_quantity - l_discount))) AS d01, sqrt(sum((l_quantity - l_tax) * (l_quantity - l_tax))) AS d02, sqrt(sum((l_discount - l_tax) * (l_discount - l_tax))) AS d12 FROM lineitem)"
_LEAVES = f"""{_COLS3}, o AS MATERIALIZED (SELECT CASE WHEN d01 <= d02 AND d01 <= d12 THEN ['l_tax', 'l_quantity', 'l_discount'] WHEN d02 <= d12 THEN ['l_discount', 'l_quantity', 'l_tax'] ELSE ['l_quantity', 'l_discount', 'l_tax'] END AS terms,
 least(d01, d02, d12) AS low, CASE WHEN d01 <= d02 AND d01 <= d12 THEN greatest(d02, d12) WHEN d02 <= d12 THEN greatest(d01, d12) ELSE greatest(d01, d02) END AS high FROM g)"""


@query(f"WITH {_LEAVES} SELECT k AS place, terms[k + 1] AS term FROM o, range(3) AS r(k)")
def hierarchical_columns(spark, sf):
    order, _ = cluster.cluster_columns(table(spark, sf, "lineitem"), X3)
    return spark.createDataFrame([(i, c) for i, c in enumerate(order)], "place long, term string")


@query(f"WITH {_LEAVES} SELECT 1::bigint AS merge, round(low, 4) AS height FROM o UNION ALL SELECT 2, round(high, 4) FROM o")
def linkage_heights(spark, sf):
    merges = cluster.complete_linkage(cluster.column_distances(table(spark, sf, "lineitem"), X3))
    return rounded(spark.createDataFrame([(i + 1, float(h)) for i, (_, _, h) in enumerate(merges)], "merge long, height double"), height=4)


@query(f"WITH {_LEAVES} SELECT l_orderkey || '-' || l_linenumber AS key, terms[k + 1] AS \"column\", k::int AS place, CASE terms[k + 1] WHEN 'l_quantity' THEN l_quantity WHEN 'l_discount' THEN l_discount ELSE l_tax END AS value FROM lineitem, o, range(3) AS r(k)")
def heatmap_cells(spark, sf):
    df = table(spark, sf, "lineitem").withColumn("key", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    return diagnostics.heatmap(df, "key", X3)[0]


@query("SELECT vec_id, round(sum((v - m) * (v - m)), 6) AS d2 FROM (SELECT vec_id, k, CASE WHEN embedding[k] > 0.1::float THEN embedding[k]::double ELSE 0 END AS v, ((k * 5) % 7 - 3) * 0.1 AS m FROM embeddings, range(1, 65) AS r(k)) GROUP BY vec_id")
def sparse_dense_distance(spark, sf):
    """Squared distance of sparse rows to a dense vector, by the norms and one sparse product."""
    df, at = _sparse(spark, sf)
    c = np.array([[((k * 5) % 7 - 3) * 0.1 for k in range(1, 65)]])
    return rounded(cluster.assign_rows(df, at, c).select("vec_id", F.col("distance2").alias("d2")), d2=6)


@query("""WITH x AS MATERIALIZED (SELECT vec_id, k - 1 AS j, CASE WHEN embedding[k] > 0.1::float THEN embedding[k]::double ELSE 0 END AS v FROM embeddings, range(1, 65) AS r(k)),
 s AS (SELECT vec_id, exp(-sum(v * v) / (2 * 0.5)) AS k0, exp(-sum((v - 0.1) * (v - 0.1)) / (2 * 0.25)) AS k1, count(*) FILTER (WHERE v <> 0) AS n, sum(v) AS total FROM x GROUP BY vec_id)
 SELECT vec_id, round(k0, 7) AS k0, round(k1, 7) AS k1, (n + 2)::int AS stored, round(total, 6) AS rest FROM s""")
def sparse_rbf_rows(spark, sf):
    """An RBF map of sparse rows: kernels first, then the row's own entries, still sparse."""
    df, at = _sparse(spark, sf)
    out, wide = kernels.rbf_rows(df, at, np.array([np.zeros(64), np.full(64, 0.1)]), np.array([0.5, 0.25]))
    v = F.col(wide.values)
    rest = F.aggregate(F.slice(v, 3, F.greatest(F.size(v) - 2, F.lit(0))), F.lit(0.0), lambda s, x: s + x)
    return rounded(out.select("vec_id", v[0].alias("k0"), v[1].alias("k1"), F.size(v).alias("stored"), rest.alias("rest")), k0=7, k1=7, rest=6)


@query("SELECT true AS same, 4::bigint AS centres")
def rbf_centres_kmeans(spark, sf):
    """Centres from k-means: both forms of the bandwidth, one half of the other. """
    df = e4(spark, sf)
    c, half = kernels.rbf_centres_kmeans(df, E4, "vec_id", 4, 3, 2)
    _, whole = kernels.rbf_centres_kmeans(df, E4, "vec_id", 4, 3, 2, half=False)
    d = ((c[:, None] - c[None]) ** 2).sum(-1)
    d[d == 0] = np.inf
    return row(spark, same=bool(np.allclose(2 * half, whole) and np.allclose(whole, d.min(1))), centres=len(c))


# --- QQ data -------------------------------------------------------------------------------------------------------


@query(f"WITH r AS (SELECT c_acctbal AS x, row_number() OVER (ORDER BY c_acctbal) AS rn, count(*) OVER () AS n, avg(c_acctbal) OVER () AS m, stddev_samp(c_acctbal) OVER () AS s FROM customer) SELECT rn - 1 AS i, round(m + s * {normal_quantile('((rn - 1) / n)')}, 4) AS theoretical, x AS observed FROM r WHERE rn > 1")
def qq_normal(spark, sf):
    return rounded(diagnostics.qq_normal(table(spark, sf, "customer"), "c_acctbal", "c_custkey"), theoretical=4)


@query("WITH r AS (SELECT (c_acctbal + 1000) / 11001 AS p, row_number() OVER (ORDER BY c_acctbal) AS rn, count(*) OVER () AS n FROM customer) SELECT rn AS rank, round(-log10(rn / (n + 1.0)), 7) AS expected, round(-log10(greatest(p, 1e-300)), 7) AS observed FROM r")
def qq_uniform(spark, sf):
    """Without the Beta bands, whose quantiles SQL lacks; tests hold those against binomial sums."""
    df = table(spark, sf, "customer").select("c_custkey", ((F.col("c_acctbal") + 1000) / 11001).alias("p"))
    return rounded(diagnostics.qq_uniform(df, "p", "c_custkey").select("rank", "expected", "observed"), expected=7, observed=7)


# --- vectors -------------------------------------------------------------------------------------------------------


@query("SELECT k - 1 AS j, 1.0::double AS sparse, round(1 / stddev_samp(embedding[k]::double), 6) AS dense FROM embeddings, range(1, 65) AS r(k) GROUP BY k")
def vector_scaling(spark, sf):
    """Factors of feature vectors: 1 / sd of dense ones; sparse ones are not scaled."""
    from .plans.fit import vector_factors

    df, at = _sparse(spark, sf)
    a, b = vector_factors(df, at), vector_factors(table(spark, sf, "embeddings"), Vectors(64, "embedding", intercept=False))
    return rounded(spark.createDataFrame([(j, float(a[j]), float(b[j])) for j in range(64)], "j long, sparse double, dense double"), dense=6)


@query("""WITH o AS MATERIALIZED (SELECT embedding, (label % 2)::double AS y, row_number() OVER (ORDER BY md5(vec_id || ':7:0'), vec_id) - 1 AS place FROM embeddings), n AS (SELECT count(*) // 200 + 1 AS nb FROM embeddings),
 b AS MATERIALIZED (SELECT embedding, y FROM o, n WHERE place % nb = 1)
 SELECT k - 1 AS j, round(sum((y - 0.5) * CASE WHEN embedding[k] > 0.1::float THEN embedding[k]::double ELSE 0 END), 6) + 0 AS g, count(*) AS n FROM b, range(1, 65) AS r(k) GROUP BY k""")
def sparse_minibatch_gradient(spark, sf):
    """The second mini-batch of sparse rows: its gradient of a logistic fit at 0, and its rows."""
    from .plans.fit import mini_batches
    from .plans.objectives import Logistic, VectorData

    df, at = _sparse(spark, sf)
    rows = df.select("at", "values", (F.col("label") % 2).alias("y"), F.col("vec_id").alias("__key"))
    parts = mini_batches(rows, "__key", 200, rows.count(), 7, lambda d: Logistic().on(VectorData(d, at, "y", np.zeros(64))))
    next(parts)
    o = next(parts)
    g, n = o.gradient(np.zeros(64)), o.n
    parts.close()
    return rounded(spark.createDataFrame([(j, float(v), n) for j, v in enumerate(g)], "j long, g double, n long"), g=6)
