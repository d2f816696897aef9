"""Queries and, beside each, the SQL that gives the same rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions.algebras import BOOLEAN, MAX_TIMES, MIN_PLUS, MIN_TIMES
from ..operators import blocked, graphs, linalg, multilinear, scans, symmetry, tiled, workloads
from ..operators.multigrid import Hierarchy, laplacian
from ..operators.notation import function, function2, transform2
from ..operators.tensor import Tensor, dot, einsum, grid, kron, outer, stack, tensordot
from ..sources import files
from ..sources.checkpoint import checkpointed, shared_folder
from .registry import CELLS, EMB, GRAPH, NATIONS, ORACLE_SQL, QUERIES, TRADE, doubled, graph, one, query, rows
from .tables import Tables

# Contractions


@query(f"WITH {TRADE} SELECT n, s, round(v, 4) AS v FROM trade")
def contract_3way(t: Tables):
    return rows(t.trade(), "ns")


@query("""SELECT n_regionkey::BIGINT AS r, round(sum(l_quantity), 4) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""")
def contract_region(t: Tables):
    k = t.lengths()
    return rows(einsum("ops,oc,cn,nr->r", t.items(shape=k), t.order_customer(k), t.customer_nation(k), t.nation_region()), "r")


@query("""SELECT l_orderkey AS o, l_partkey AS p, l_suppkey AS s, round(sum(l_quantity) * any_value(p_retailprice), 4) AS v
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL""")
def hadamard(t: Tables):
    k = t.lengths()
    return rows(einsum("ops,p->ops", t.items(shape=k, unique=True), t.price(k)), "ops")


@query("SELECT l_suppkey AS s, round(sum(l_quantity * p_retailprice), 2) AS v FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL")
def matvec(t: Tables):
    k = t.lengths()
    return rows(einsum("ops,p->s", t.items(shape=k), t.price(k)), "s", 2)


@query("SELECT a.vec_id AS v1, b.vec_id AS v2, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 3) + 0.0 AS v FROM embeddings a CROSS JOIN embeddings b")
def matmat(t: Tables):
    e = t.embedding()
    return rows(linalg.product(e, e.T), "vw", 3, True).toDF("v1", "v2", "v")


@query(f"WITH {EMB} SELECT a.k AS k, b.k AS l, round(sum(a.x * b.x), 4) + 0.0 AS v FROM e a JOIN e b USING (i) GROUP BY ALL")
def gram(t: Tables):
    g = linalg.gram(t.embedding())
    return rows(Tensor.from_numpy(t.spark, g), "kl")


@query(f"WITH {NATIONS} SELECT round(sum(a.v * b.v), 0) AS v FROM w a JOIN w b ON a.m = b.n AND a.n = b.m")
def trace_of_product(t: Tables):
    w = t.nations()
    return rows(einsum("nm,mn->", w, w), "", 0)


@query(f"WITH {NATIONS} SELECT a.n AS i, a.m AS j, b.n AS k, round(a.v * b.v, 2) AS v FROM w a CROSS JOIN (SELECT n, v FROM w WHERE m = 0) b")
def outer_product(t: Tables):
    w = t.nations()
    return rows(outer(w, w[:, 0]), "ijk", 2)


@query(f"WITH {NATIONS} SELECT a.n_regionkey * 25 + b.n AS i, a.n_nationkey * 25 + b.m AS j, round(b.v, 2) AS v FROM nation a CROSS JOIN w b")
def kronecker(t: Tables):
    return rows(kron(t.nation_region().T, t.nations()), "ij", 2)


@query(f"WITH {TRADE} SELECT a.n AS n, b.n AS m, round(sum(a.v * b.v), 2) AS v FROM trade a JOIN trade b USING (s) GROUP BY ALL")
def tensordot_trade(t: Tables):
    n = t.trade()
    return rows(tensordot(n, n, ([1], [1])), "nm", 2)


@query(f"WITH {NATIONS} SELECT a.n AS n, b.m AS m, round(sum(a.v * b.v), 2) AS v FROM w a JOIN w b ON a.m = b.n GROUP BY ALL")
def dot_nations(t: Tables):
    w = t.nations()
    return rows(dot(w, w), "nm", 2)


@query(f"WITH {NATIONS} SELECT n, round(sum(v), 4) AS v FROM w WHERE n = m GROUP BY ALL")
def einsum_diagonal(t: Tables):
    return rows(einsum("nn->n", t.nations()), "n")


@query(f"WITH {NATIONS} SELECT n, m, z, round(v, 4) AS v FROM w CROSS JOIN range(3) r(z)")
def einsum_broadcast(t: Tables):
    return rows(einsum("nm->nmz", t.nations(), sizes={"z": 3}), "nmz")


@query(f"WITH {NATIONS} SELECT n, m, round(sum(v), 4) AS v FROM (SELECT n, m, 2 * v AS v FROM w UNION ALL SELECT m, n, -0.5 * v FROM w) GROUP BY ALL")
def sum_expression(t: Tables):
    w = t.nations()
    return rows((w.i("nm") * 2 - w.i("mn") * 0.5).to("nm"), "nm")


@query(f"WITH {NATIONS} SELECT n, m, round(sum(v), 4) AS v FROM (SELECT n, m, 3 * v AS v FROM w UNION ALL SELECT m, n, v FROM w) GROUP BY ALL")
def accumulate(t: Tables):
    w = t.nations()
    return rows(w.i("nm").accumulate(w.i("mn"), beta=3.0), "nm")


@query(f"WITH {NATIONS} SELECT n, m, round(CASE WHEN n = m THEN v * 10 ELSE v END, 4) AS v FROM w")
def scale_diagonal_labels(t: Tables):
    return rows(t.nations().i("nn").scale(10.0), "nm")


@query(f"WITH {NATIONS} SELECT n, m, round(v, 4) AS v FROM w WHERE n <> m UNION ALL SELECT i, i, 1.5 FROM range(25) r(i)")
def fill_diagonal(t: Tables):
    return rows(t.nations().i("nn").fill(1.5), "nm")


# Elementwise


@query(f"WITH {NATIONS} SELECT n, m, round(sum(v), 4) AS v FROM (SELECT n, m, v FROM w UNION ALL SELECT m, n, v FROM w) GROUP BY ALL")
def add(t: Tables):
    w = t.nations()
    return rows(w + w.T, "nm")


@query(f"WITH {NATIONS} SELECT n, m, round(sum(v), 4) + 0.0 AS v FROM (SELECT n, m, v FROM w UNION ALL SELECT m, n, -v FROM w) GROUP BY ALL")
def subtract(t: Tables):
    w = t.nations()
    return rows(w - w.T, "nm")


@query(f"WITH {NATIONS} SELECT a.n AS n, a.m AS m, round(a.v * b.v, 2) AS v FROM w a JOIN w b ON a.n = b.m AND a.m = b.n")
def multiply(t: Tables):
    w = t.nations()
    return rows(w * w.T, "nm", 2)


@query(f"WITH {NATIONS} SELECT a.n AS n, a.m AS m, round(a.v / b.v, 6) AS v FROM w a JOIN w b ON a.n = b.m AND a.m = b.n")
def divide(t: Tables):
    w = t.nations()
    return rows(w / w.T, "nm", 6)


@query("""SELECT p_partkey AS p, round(pow(p_retailprice, 2), 2) AS squared, round(exp(p_retailprice / 1000), 4) AS e, floor(p_retailprice)::DOUBLE AS f,
ceil(p_retailprice)::DOUBLE AS c, round(p_retailprice * 2)::DOUBLE AS r, round(least(greatest(p_retailprice, 950.0), 1200.0), 4) AS clipped, round(abs(p_retailprice - 1000), 4) AS a FROM part""")
def ufuncs(t: Tables):
    p = t.price({"p": t.length("part", "p_partkey")})
    p.sparse = True
    parts = {"squared": (p**2, 2), "e": ((p * 0.001).exp(), 4), "f": (p.floor(), 4), "c": (p.ceil(), 4), "r": ((p * 2.0).rint(), 4), "clipped": (p.clip(950.0, 1200.0), 4), "a": (abs(p.map(lambda v: v - 1000)), 4)}
    out = None
    for name, (x, digits) in parts.items():
        part = x.df.select("i0", F.round("v", digits).alias(name))
        out = part if out is None else out.join(part, "i0")
    return out.withColumnRenamed("i0", "p")


@query(f"WITH {NATIONS}, {CELLS} SELECT a.n AS n, a.m AS m, a.v < b.v AS lt, a.v <= b.v AS le, a.v = b.v AS eq, a.v <> b.v AS ne FROM cells a JOIN cells b ON a.n = b.m AND a.m = b.n")
def compare(t: Tables):
    w = t.nations()
    w = w._with(checkpointed(w.densify().df))
    u, out = w.T, grid(t.spark, (25, 25))
    for name, x in {"lt": w < u, "le": w <= u, "eq": w.equal(u), "ne": w.differs(u)}.items():
        out = out.join(x.df.withColumnRenamed("v", name), ["i0", "i1"])
    return out.toDF("n", "m", "lt", "le", "eq", "ne")


@query("SELECT p_partkey AS p, trunc(p_retailprice)::INTEGER AS v FROM part")
def cast_int32(t: Tables):
    return rows(t.price({"p": t.length("part", "p_partkey")}).astype("int32"), "p")


@query(f"WITH {NATIONS} SELECT n, m, round(v * v + 1, 2) AS v FROM w")
def univariate_function(t: Tables):
    return rows(function(lambda v: v * v + 1, t.nations().i("nm"), "nm"), "nm", 2)


@query(f"WITH {NATIONS} SELECT a.n AS n, round(sum(abs(a.v - b.v)), 2) AS v FROM w a JOIN w b ON a.m = b.n GROUP BY ALL")
def bivariate_function(t: Tables):
    w = t.nations()
    return rows(function2(lambda a, b: F.abs(a - b), w.i("nm"), w.i("mk"), "n"), "n", 2)


@query(f"WITH {NATIONS}, d AS (SELECT n, v FROM w WHERE n = m) SELECT w.n, w.m, round(CASE WHEN d.v IS NULL THEN w.v ELSE w.v / d.v END, 6) AS v FROM w LEFT JOIN d ON w.n = d.n")
def transform_by_diagonal(t: Tables):
    w = t.nations()
    return rows(transform2(lambda a, b: b / a, w.diagonal().i("n"), w.i("nm")), "nm", 6)


@query("SELECT round(sum(2 * l_quantity - 3 * l_tax), 2) AS re, round(sum(3 * l_quantity + 2 * l_tax), 2) AS im FROM lineitem")
def complex_sum(t: Tables):
    z = Tensor(t.read("lineitem").select(F.monotonically_increasing_id().alias("i0"), F.struct(F.col("l_quantity").alias("re"), F.col("l_tax").alias("im")).alias("v")), (1 << 40,), "complex128")
    return (z * (2 + 3j)).sum().df.select(F.round("v.re", 2).alias("re"), F.round("v.im", 2).alias("im"))


# Reductions


@query("""SELECT round(sum(v), 2) AS total, round(sum(abs(v)), 2) AS norm1, round(sqrt(sum(v * v)), 2) AS norm2, max(v) AS largest, min(v) AS smallest, max(abs(v)) AS norm_inf,
count(*) FILTER (v <> 0) AS nnz FROM (SELECT l_orderkey * 8 + l_linenumber AS i, l_extendedprice AS v FROM lineitem)""")
def reductions(t: Tables):
    x = Tensor(t.read("lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("i0"), F.col("l_extendedprice").alias("v")), (1 << 40,))
    figures = x.figures("sum", "norm1", "norm2", "max", "min", "norm_inf", "nnz")
    return figures.select(F.round("sum", 2).alias("total"), F.round("norm1", 2).alias("norm1"), F.round("norm2", 2).alias("norm2"), F.col("max").alias("largest"), F.col("min").alias("smallest"), "norm_inf", "nnz")


@query("SELECT l_orderkey AS o, round(sum(l_quantity), 4) AS v FROM lineitem GROUP BY ALL")
def sum_axes(t: Tables):
    return rows(t.items().sum(axis=(1, 2)), "o")


@query("SELECT 0::BIGINT AS o, 0::BIGINT AS p, l_suppkey AS s, round(sum(l_quantity), 4) AS v FROM lineitem GROUP BY ALL")
def sum_keepdims(t: Tables):
    return rows(t.items().sum(axis=(0, 1), keepdims=True), "ops")


@query(f"WITH {NATIONS}, {CELLS} SELECT n, max(v) AS hi, min(v) AS lo, bool_or(v <> 0) AS some, bool_and(v <> 0) AS every FROM cells GROUP BY ALL")
def row_extremes(t: Tables):
    w = t.nations()
    out = w.max(axis=1).df.withColumnRenamed("v", "hi")
    for name, x in {"lo": w.min(axis=1), "some": w.any(axis=1), "every": w.all(axis=1)}.items():
        out = out.join(x.df.withColumnRenamed("v", name), "i0")
    return out.withColumnRenamed("i0", "n")


@query(f"WITH {NATIONS}, {CELLS} SELECT round(max(c), 4) AS norm_1, (SELECT round(max(r), 4) FROM (SELECT sum(v) AS r FROM cells GROUP BY n)) AS norm_inf, (SELECT round(sqrt(sum(v * v)), 4) FROM cells) AS fro FROM (SELECT sum(v) AS c FROM cells GROUP BY m)")
def matrix_norms(t: Tables):
    w = t.nations()
    w = w._with(checkpointed(w.df))
    return one(t.spark, norm_1=round(w.norm(1), 4), norm_inf=round(w.norm(np.inf), 4), fro=round(w.norm(), 4))


@query("SELECT l_extendedprice AS v FROM lineitem ORDER BY abs(l_extendedprice) DESC LIMIT 20")
def top_k(t: Tables):
    x = Tensor(t.read("lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("i0"), F.col("l_extendedprice").alias("v")), (1 << 40,))
    return t.spark.createDataFrame([(v,) for v in x.largest(20)], "v double")


@query(f"WITH {NATIONS} SELECT round(sum(v), 4) AS v FROM w WHERE n = m")
def trace(t: Tables):
    return rows(t.nations().trace(), "")


@query("""WITH d AS (SELECT date_diff('day', DATE '1992-01-01', l_shipdate::DATE) AS i, sum(l_extendedprice) AS v FROM lineitem GROUP BY ALL),
g AS (SELECT i, coalesce(v, 0) AS v FROM range((SELECT max(i) + 1 FROM d)) r(i) LEFT JOIN d USING (i))
SELECT i, round(coalesce(sum(v) OVER (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 2) AS v FROM g""")
def running_revenue(t: Tables):
    day = F.datediff(F.to_date("l_shipdate"), F.lit("1992-01-01").cast("date"))
    days = t.read("lineitem").agg(F.max(day)).first()[0] + 1
    x = Tensor.from_df(t.read("lineitem"), [day], "l_extendedprice", (days,))
    return rows(scans.prefix(x, block=512), "i", 2)


@query("SELECT row_number() OVER (ORDER BY p_retailprice) - 1 AS i, p_retailprice AS v FROM part")
def sort_vector(t: Tables):
    return rows(scans.sort(t.price({"p": t.length("part", "p_partkey")})), "i", None)


# Structure


@query(f"WITH {TRADE} SELECT s, n, round(v, 4) AS v FROM trade")
def transpose(t: Tables):
    return rows(t.trade().T, "sn")


@query(f"WITH {TRADE} SELECT n - 5 AS n, (s - 1) // 3 AS s, round(v, 4) AS v FROM trade WHERE n BETWEEN 5 AND 14 AND s >= 1 AND s < 40 AND (s - 1) % 3 = 0")
def slice_stride(t: Tables):
    return rows(t.trade()[5:15, 1:40:3], "ns")


@query(f"WITH {TRADE} SELECT 24 - n AS n, s, round(v, 4) AS v FROM trade")
def slice_reverse(t: Tables):
    return rows(t.trade()[::-1, :], "ns")


@query(f"WITH {NATIONS} SELECT n, m, round(v, 4) AS v FROM w WHERE NOT (n BETWEEN 2 AND 4 AND m < 10) UNION ALL SELECT a.i, b.i, 7.0 FROM range(2, 5) a(i) CROSS JOIN range(10) b(i)")
def assign_region(t: Tables):
    return rows(t.nations().assign((slice(2, 5), slice(0, 10)), 7.0), "nm")


@query(f"WITH {NATIONS} SELECT k::BIGINT AS n, m, round(v, 4) AS v FROM w JOIN (VALUES (3, 0), (24, 1), (3, 2)) x(i, k) ON n = i")
def take(t: Tables):
    return rows(t.nations().take([3, -1, 3], 0), "nm")


@query(f"WITH {NATIONS} SELECT 24 - n AS n, m, round(v, 4) AS v FROM w WHERE n <> 0")
def permute(t: Tables):
    return rows(t.nations().permute([[-1, *range(23, -1, -1)], None]), "nm")


@query(f"WITH {NATIONS} SELECT (n * 25 + m) // 125 AS a, (n * 25 + m) % 125 AS b, round(v, 4) AS v FROM w")
def reshape(t: Tables):
    return rows(t.nations().reshape(5, -1), "ab")


@query(f"WITH {NATIONS} SELECT n AS i, round(v, 4) AS v FROM w WHERE m - n = 2")
def diag_offset(t: Tables):
    return rows(t.nations().diag(2), "i")


@query(f"WITH {NATIONS} SELECT 'l' AS side, n, m, round(v, 4) AS v FROM w WHERE m - n <= -1 UNION ALL SELECT 'u', n, m, round(v, 4) FROM w WHERE m - n >= 1")
def triangles(t: Tables):
    w = t.nations()
    lower, upper = rows(w.tril(-1), "nm"), rows(w.triu(1), "nm")
    return lower.select(F.lit("l").alias("side"), "*").unionByName(upper.select(F.lit("u").alias("side"), "*"))


@query(f"WITH {NATIONS} SELECT n, m, round(v, 4) AS v FROM w UNION ALL SELECT n + 25, m, round(2 * v, 4) FROM w")
def vstack_nations(t: Tables):
    w = t.nations()
    return rows(stack([w, w * 2.0], 0), "nm")


@query("SELECT l_orderkey AS o, l_partkey AS p, l_suppkey AS s, sum(l_quantity) AS v FROM lineitem GROUP BY ALL HAVING sum(l_quantity) > 45")
def sparsify(t: Tables):
    k = t.lengths()
    x = Tensor.from_df(t.read("lineitem"), ["l_orderkey", "l_partkey", "l_suppkey"], "l_quantity", (k["o"], k["p"], k["s"]))
    return rows(x.sparsify(45.0), "ops", None)


@query(f"WITH {NATIONS}, {CELLS} SELECT n, m, round(v, 4) AS v FROM cells")
def densify(t: Tables):
    return rows(t.nations().densify(), "nm")


@query(f"WITH {NATIONS} SELECT w.n, w.m, round(w.v, 4) AS v FROM w JOIN nation a ON w.n = a.n_nationkey JOIN nation b ON w.m = b.n_nationkey WHERE a.n_regionkey = b.n_regionkey")
def mask(t: Tables):
    r = t.nation_region()
    return rows(t.nations() * einsum("nr,mr->nm", r, r), "nm")


# Points


@query("""WITH u AS (SELECT user_id AS u, event_id % 7 AS t, sum(value) AS v FROM events WHERE value IS NOT NULL GROUP BY ALL), n AS (SELECT user_id AS u, event_id % 7 AS t, sum(value) AS v FROM events WHERE event_type = 'purchase' AND value IS NOT NULL GROUP BY ALL)
SELECT coalesce(u.u, n.u) AS u, coalesce(u.t, n.t) AS t, round(CASE WHEN n.v IS NULL THEN u.v ELSE n.v END, 4) AS v FROM u FULL JOIN n ON u.u = n.u AND u.t = n.t""")
def point_write(t: Tables):
    e = t.read("events").select("user_id", (F.col("event_id") % 7).alias("t"), "value", "event_type")
    n = t.length("events", "user_id")
    x = Tensor.from_df(e, ["user_id", "t"], "value", (n, 7))
    new = e.where("event_type = 'purchase' and value is not null").select(F.col("user_id").alias("i0"), F.col("t").alias("i1"), F.col("value").alias("v"))
    return rows(x.write(new), "ut")


@query(f"WITH {NATIONS} SELECT i.n, i.m, round(coalesce(v, 0), 4) AS v FROM (SELECT i AS n, (i * 7) % 25 AS m FROM range(25) r(i)) i LEFT JOIN w ON i.n = w.n AND i.m = w.m")
def point_read(t: Tables):
    asked = t.spark.range(25).select(F.col("id").alias("i0"), (F.col("id") * 7 % 25).alias("i1"), F.lit(None).cast("double").alias("v"))
    return t.nations().read(asked).select(F.col("i0").alias("n"), F.col("i1").alias("m"), F.round("v", 4).alias("v"))


@query(f"WITH {TRADE} SELECT n, s, round(v, 2) AS v FROM trade WHERE v <> 0")
def coo_text(t: Tables):
    import uuid

    n = t.trade()
    path = f"{shared_folder(t.spark)}/coo-{uuid.uuid4().hex}"
    files.write_text(n, path)
    return rows(files.read_text(t.spark, path, n.shape), "ns", 2)


# Algebras


@query(f"WITH {NATIONS} SELECT a.n AS n, b.m AS m, round(min(a.v + b.v), 4) AS v FROM w a JOIN w b ON a.m = b.n GROUP BY ALL")
def min_plus(t: Tables):
    w = t.nations()
    return rows(einsum("nm,mk->nk", w, w, algebra=MIN_PLUS), "nm")


@query(f"WITH {NATIONS} SELECT a.n AS n, b.m AS m, round(max(a.v * b.v), 2) AS v FROM w a JOIN w b ON a.m = b.n GROUP BY ALL")
def max_times(t: Tables):
    w = t.nations()
    return rows(einsum("nm,mk->nk", w, w, algebra=MAX_TIMES), "nm", 2)


@query("""WITH g AS (SELECT DISTINCT c_nationkey::BIGINT AS n, s_nationkey::BIGINT AS m FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity > 49) SELECT a.n AS n, b.m AS m, true AS v FROM g a JOIN g b ON a.m = b.n GROUP BY ALL""")
def boolean_reach(t: Tables):
    big = t.read("lineitem").where("l_quantity > 49").join(t.read("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t.read("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t.read("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    g = Tensor.from_df(big, ["c_nationkey", "s_nationkey"], None, (25, 25), "bool", BOOLEAN)
    return rows(einsum("nm,mk->nk", g, g, algebra=BOOLEAN), "nm", None)


@query(f"WITH {NATIONS} SELECT a.n AS n, b.m AS m, round(min(a.v * b.v), 2) AS v FROM w a JOIN w b ON a.m = b.n GROUP BY ALL")
def min_times(t: Tables):
    w = t.nations()
    return rows(einsum("nm,mk->nk", w, w, algebra=MIN_TIMES), "nm", 2)


# Graphs


@query(f"WITH {GRAPH}, {doubled(7)} SELECT m AS i, v::DOUBLE AS v FROM d7 WHERE n = 0")
def sssp(t: Tables):
    return rows(graphs.shortest_paths(graph(t), 0)[0], "i")


@query(f"WITH {GRAPH}, {doubled(7)} SELECT n, m, v::DOUBLE AS v FROM d7")
def apsp(t: Tables):
    return rows(graphs.all_shortest_paths(graph(t)), "nm", many=True)


@query(f"""WITH {GRAPH}, h0 AS (SELECT n, m, min(v * 1000 + 1) AS v FROM g GROUP BY ALL), {", ".join(f"h{k + 1} AS (SELECT n, m, min(v) AS v FROM (SELECT a.n, b.m, a.v + b.v AS v FROM h{k} a JOIN h{k} b ON a.m = b.n UNION ALL FROM h{k}) GROUP BY ALL)" for k in range(7))}
SELECT n AS i0, m AS i1, (v::BIGINT // 1000)::DOUBLE AS w, (v::BIGINT % 1000)::INTEGER AS h FROM h7""")
def apsp_hops(t: Tables):
    """Until no pair's path gets less; the SQL's seven doublings reach paths of 128 edges, more than there are suppliers at its scale."""
    return graphs.path_hops(graph(t).df)


PATHS = f"""{GRAPH}, {doubled(7)}, dag AS (SELECT a.n AS s, g.n AS u, g.m AS x FROM d7 a JOIN g ON a.m = g.n JOIN d7 b ON b.n = a.n AND b.m = g.m WHERE a.v + g.v = b.v),
walk(s, x, c, k) AS (SELECT s_suppkey, s_suppkey, 1::DOUBLE, 0 FROM supplier UNION ALL SELECT walk.s, dag.x, sum(c), any_value(k) + 1 FROM walk JOIN dag ON walk.s = dag.s AND walk.x = dag.u GROUP BY walk.s, dag.x),
sigma AS (SELECT s, x, sum(c) AS c FROM walk GROUP BY ALL)"""


@query(f"WITH RECURSIVE {PATHS} SELECT 0::BIGINT AS s, x, c AS v FROM sigma WHERE s = 0")
def path_multiplicity(t: Tables):
    counts = graphs.path_counts(graph(t).df, 0)
    return counts.select(F.lit(0).cast("bigint").alias("s"), F.col("i").alias("x"), F.col("m").cast("double").alias("v"))


@query(f"""WITH RECURSIVE {PATHS} SELECT b.x AS i, round(sum(b.c * e.c / a.c), 3) AS v FROM sigma a JOIN sigma b ON a.s = b.s JOIN sigma e ON b.x = e.s AND e.x = a.x
JOIN d7 p ON p.n = a.s AND p.m = a.x JOIN d7 q ON q.n = b.s AND q.m = b.x JOIN d7 r ON r.n = e.s AND r.m = e.x WHERE a.s <> a.x AND b.x <> a.s AND b.x <> a.x AND q.v + r.v = p.v GROUP BY ALL""")
def betweenness(t: Tables):
    return rows(graphs.betweenness(graph(t)).sparsify(), "i", 3)


def _set_holds(t: Tables, distance: int):
    """Whether no two chosen vertices are within the distance, and every other vertex is within it of one."""
    a = graph(t)
    chosen = checkpointed(graphs.independent_set(a, distance).df.select(F.col("i0").alias("i")))
    edges = graphs._symmetric(a).select(F.col("i0").alias("i"), F.col("i1").alias("j"))
    near = edges if distance == 1 else edges.unionByName(edges.join(edges.toDF("j", "k"), "j").where("i != k").select("i", F.col("k").alias("j")))
    near = near.distinct()
    inside = near.join(chosen, "i").join(chosen.select(F.col("i").alias("j")), "j").limit(1).count()
    covered = chosen.unionByName(near.join(chosen, "i").select(F.col("j").alias("i"))).distinct().count()
    return one(t.spark, independent=inside == 0, maximal=covered == t.length("supplier", "s_suppkey"))


@query("SELECT true AS independent, true AS maximal")
def maximal_independent_set(t: Tables):
    return _set_holds(t, 1)


@query("SELECT true AS independent, true AS maximal")
def maximal_independent_set_2(t: Tables):
    return _set_holds(t, 2)


# Symmetry


@query(f"WITH {NATIONS} SELECT least(n, m) AS n, greatest(n, m) AS m, round(sum(CASE WHEN n > m THEN -v ELSE v END), 4) + 0.0 AS v FROM w WHERE n <> m GROUP BY ALL")
def antisymmetrize(t: Tables):
    half = symmetry.symmetrize(t.nations(), "AS")
    return rows(half._with(half.stored), "nm")


@query(f"""WITH {NATIONS}, p AS (SELECT least(n, m) AS n, greatest(n, m) AS m, sum(v) AS v FROM w GROUP BY ALL)
SELECT n, m, round(v, 4) AS v FROM p UNION ALL SELECT m, n, round(v, 4) FROM p WHERE n <> m""")
def desymmetrize(t: Tables):
    return rows(symmetry.desymmetrize(symmetry.symmetrize(t.nations(), "SY")), "nm")


# Multilinear kernels


def _spread(t: Tables, size: int, n: int) -> Tensor:
    """Row x of a factor is the start of embedding x modulo their number."""
    rows_ = t.spark.range(size).withColumn("vec_id", F.col("id") % n).join(t.read("embeddings"), "vec_id")
    flat = rows_.select("id", F.posexplode(F.slice("embedding", 1, 4)).alias("k", "x"))
    return Tensor(flat.select(F.col("id").alias("i0"), F.col("k").cast("bigint").alias("i1"), F.col("x").cast("double").alias("v")), (size, 4), rows=4.0 * size)


FACTORS = "f AS (SELECT vec_id AS i, embedding[1:4]::DOUBLE[] AS u FROM embeddings)"
COUNT = "(SELECT count(*) FROM embeddings)"
CUBE = "x AS (SELECT l_suppkey AS s, c_nationkey::BIGINT AS n, sum(l_quantity) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"


@query(f"""WITH {CUBE}, {FACTORS} SELECT s, n, round(v * list_dot_product(a.u, b.u), 4) + 0.0 AS v FROM x JOIN f a ON a.i = s % {COUNT} JOIN f b ON b.i = n % {COUNT}""")
def tttp(t: Tables):
    k = t.lengths()
    n = t.length("embeddings", "vec_id")
    return rows(multilinear.tttp(t.trade(k).T, [_spread(t, k["s"], n), _spread(t, 25, n)]), "sn")


@query(f"""WITH {CUBE}, {FACTORS} SELECT n, r, round(sum(v * a.u[r + 1]), 3) + 0.0 AS v FROM x JOIN f a ON a.i = s % {COUNT} CROSS JOIN range(4) q(r) GROUP BY ALL""")
def mttkrp(t: Tables):
    k = t.lengths()
    n = t.length("embeddings", "vec_id")
    return rows(multilinear.mttkrp(t.trade(k).T, [_spread(t, k["s"], n), None], 1), "nr", 3)


@query(f"""WITH {CUBE}, {FACTORS} SELECT n, r, round(sum(v * a.u[r + 1]), 2) + 0.0 AS v FROM x JOIN f a ON a.i = s % {COUNT} CROSS JOIN range(4) q(r) GROUP BY ALL""")
def solve_factor(t: Tables):
    """The normal equations' matrices times what solves them: the right-hand side again."""
    k = t.lengths()
    u = _spread(t, k["s"], t.length("embeddings", "vec_id"))
    u = u._with(checkpointed(u.df))
    x = t.trade(k).T
    x = x._with(checkpointed(x.df))
    ones = x.map(lambda v: F.lit(1.0))
    solved = multilinear.solve_factor(ones, [u, None], multilinear.mttkrp(x, [u, None], 1), 1, 1e-9)
    return rows(einsum("sn,sr,sq,nq->nr", ones, u, u, solved), "nr", 2)


def _regression(name: str, mode: str, others: tuple[tuple[str, str], tuple[str, str]]) -> str:
    """CTE of a mode's factor (i, u): two unknowns a row, by Cramer's rule, with a ridge of 1."""
    (p, f), (q, g) = others
    return f"""{name}_u AS (SELECT x.{mode} AS i, v, f.u[1] * g.u[1] AS a, f.u[2] * g.u[2] AS b FROM known x JOIN {f} f ON f.i = x.{p} JOIN {g} g ON g.i = x.{q}),
{name}_s AS (SELECT i, sum(a * a) + 1 AS aa, sum(a * b) AS ab, sum(b * b) + 1 AS bb, sum(v * a) AS va, sum(v * b) AS vb FROM {name}_u GROUP BY i),
{name} AS (SELECT i, [(va * bb - vb * ab) / (aa * bb - ab * ab), (vb * aa - va * ab) / (aa * bb - ab * ab)] AS u FROM {name}_s)"""


def _completion_sql(rounds: int) -> str:
    own = {"n": "start", "l": "start"}
    parts = []
    for r in range(rounds):
        for mode, (p, q) in {"s": "nl", "n": "sl", "l": "sn"}.items():
            parts.append(_regression(f"{mode}{r}", mode, ((p, own[p]), (q, own[q]))))
            own[mode] = f"{mode}{r}"
    return f"""WITH x AS (SELECT l_suppkey AS s, c_nationkey::BIGINT AS n, l_linenumber::BIGINT AS l, sum(l_quantity) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
known AS (SELECT * FROM x WHERE (s + n + l) % 10 <> 0), start AS (SELECT i.i, embedding[1:2]::DOUBLE[] AS u FROM range(25) i(i) JOIN embeddings ON vec_id = i.i % {COUNT}), {", ".join(parts)}
SELECT x.s, x.n, x.l, (x.s + x.n + x.l) % 10 = 0 AS left_out, round(coalesce(list_dot_product(a.u, [b.u[1] * c.u[1], b.u[2] * c.u[2]]), 0), 3) + 0.0 AS v
FROM x LEFT JOIN {own["s"]} a ON a.i = x.s LEFT JOIN {own["n"]} b ON b.i = x.n LEFT JOIN {own["l"]} c ON c.i = x.l"""


@query(_completion_sql(2))
def completion(t: Tables):
    """Quantity by supplier, customer nation and line number, completed at rank 2 from nine tenths of the places: what the factors say of all places."""
    k = t.lengths()
    lines = t.read("lineitem").join(t.read("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t.read("customer"), F.col("o_custkey") == F.col("c_custkey"))
    x = Tensor.from_df(lines, ["l_suppkey", "c_nationkey", "l_linenumber"], "l_quantity", (k["s"], 25, t.length("lineitem", "l_linenumber")))
    x = x._with(checkpointed(x.df))
    left_out = (F.col("i0") + F.col("i1") + F.col("i2")) % 10 == 0
    n = t.length("embeddings", "vec_id")
    start = [None, *(_spread(t, size, n)[:, :2] for size in x.shape[1:])]
    factors = multilinear.completion(x._with(x.df.where(~left_out)), 2, rounds=2, regularise=1.0, start=start)
    said = multilinear.tttp(x.map(lambda v: F.lit(1.0)), factors)
    every = x.df.select(*x.keys).join(said.df, x.keys, "left").withColumn("v", F.coalesce("v", F.lit(0.0)))
    return every.select(F.col("i0").alias("s"), F.col("i1").alias("n"), F.col("i2").alias("l"), left_out.alias("left_out"), (F.round("v", 3) + F.lit(0.0)).alias("v"))


# Linear algebra: invariants in SQL


SAME = f"WITH {EMB} SELECT i AS v, k, round(x, 4) + 0.0 AS x FROM e"


@query(SAME)
def svd_product(t: Tables):
    u, s, vt = linalg.svd(t.embedding())
    return rows(linalg.product(u, Tensor.from_numpy(t.spark, s[:, None] * vt.to_numpy())), "vk").toDF("v", "k", "x")


@query(f"WITH {EMB} SELECT a.k AS k, b.k AS l, round(CASE WHEN a.k = b.k THEN 1.0 ELSE 0.0 END, 4) AS v FROM range(64) a(k) CROSS JOIN range(64) b(k)")
def svd_orthogonal(t: Tables):
    """The left singular vectors' products with each other."""
    u, _, _ = linalg.svd(t.embedding())
    return rows(Tensor.from_numpy(t.spark, linalg.gram(u)), "kl")


@query("SELECT true AS smallest")
def svd_rank8(t: Tables):
    """What eight singular triples leave of the matrix is, in squares, what the other singular values have."""
    e = t.embedding()
    e = e._with(checkpointed(e.df))
    _, every, _ = linalg.svd(e)
    u, s, vt = linalg.svd(e, rank=8)
    left = (e - linalg.product(u, Tensor.from_numpy(t.spark, s[:, None] * vt.to_numpy()))).sumsq()
    return one(t.spark, smallest=bool(abs(left - (every[8:] ** 2).sum()) < 1e-6 * (every**2).sum()))


@query(SAME)
def svd_random_product(t: Tables):
    u, s, vt = linalg.svd_rand(t.embedding(), 64)
    return rows(linalg.product(u, Tensor.from_numpy(t.spark, s[:, None] * vt.to_numpy())), "vk").toDF("v", "k", "x")


@query(f"WITH {EMB} SELECT i AS v, k, round(x, 4) + 0.0 AS x FROM e")
def qr_product(t: Tables):
    q, r = linalg.qr(t.embedding())
    return rows(linalg.product(q, r), "vk").toDF("v", "k", "x")


@query(f"WITH {EMB} SELECT a.k AS k, b.k AS l, round(sum(a.x * b.x), 4) + 0.0 AS v FROM e a JOIN e b USING (i) GROUP BY ALL")
def cholesky_product(t: Tables):
    """The factor, in tiles of 32, times itself again."""
    e = blocked.Blocked.from_tensor(t.embedding(), (512, 32))
    low = tiled.cholesky(blocked.einsum("vk,vl->kl", e, e), 32)
    return rows(blocked.einsum("ik,jk->ij", low, low).to_tensor(), "kl")


@query(f"WITH {EMB} SELECT a.k AS k, b.k AS l, round(sum(a.x * b.x), 3) + 0.0 AS v FROM e a JOIN e b USING (i) GROUP BY ALL")
def eigh_product(t: Tables):
    """Vectors times values times vectors again."""
    d, u = linalg.eigh(Tensor.from_numpy(t.spark, linalg.gram(t.embedding())))
    return rows(einsum("ik,k,jk->ij", u, Tensor.from_numpy(t.spark, d), u), "kl", 3)


@query(f"""WITH {NATIONS}, x AS (SELECT n_regionkey AS r, sum(v) AS v FROM w JOIN nation ON n = n_nationkey GROUP BY ALL)
SELECT a.n_nationkey::BIGINT AS n, b.n_nationkey::BIGINT AS m, CASE WHEN a.n_regionkey = b.n_regionkey THEN round(v, 2) ELSE 0 END AS v FROM nation a CROSS JOIN nation b JOIN x ON r = a.n_regionkey""")
def eigenpairs_product(t: Tables):
    """A matrix of rank 5, nations by nations with what their region ordered, from its five leading eigenpairs."""
    r = t.nation_region()
    ordered = einsum("nm,nr->r", t.nations(), r)
    d, u = linalg.eigenpairs(einsum("nr,r,mr->nm", r, ordered, r), 5, 10)
    u = u._with(checkpointed(u.df))
    return rows(einsum("ik,k,jk->ij", u, Tensor.from_numpy(t.spark, d), u), "nm", 2)


@query(f"WITH {NATIONS} SELECT a.n, b.m, round(sum(a.v * b.v), 2) AS v FROM w a JOIN w b ON a.m = b.n GROUP BY ALL")
def dot_blocked(t: Tables):
    """A dense product in blocks of 8 of 25, the last ones of 1."""
    w = blocked.Blocked.from_tensor(t.nations(), 8).written()
    return rows(blocked.dot(w, w).to_tensor(), "nm", 2)


@query(f"WITH {EMB} SELECT a.k AS k, b.k AS l, round(sum(a.x * b.x), 4) + 0.0 AS v FROM e a JOIN e b USING (i) GROUP BY ALL")
def gram_blocked(t: Tables):
    """Storage is chosen by density: embeddings go into blocks."""
    e = t.embedding()
    return rows(blocked.contracted("vk,vl->kl", e, e, block=100), "kl")


@query(f"WITH {EMB} SELECT k, i AS v, round(x, 4) + 0.0 AS x FROM e")
def solve_tri_product(t: Tables):
    """The triangle times what solves for the transposed embeddings."""
    e = blocked.Blocked.from_tensor(t.embedding(), (512, 32))
    low = tiled.cholesky(blocked.einsum("vk,vl->kl", e, e) + blocked.eye(t.spark, 64, 32) * 10.0, 32).written()
    return rows(blocked.dot(low, tiled.solve_tri(low, e.T, tile=512)).to_tensor(), "kv").toDF("k", "v", "x")


@query(f"WITH {EMB} SELECT i AS v, k, round(x, 4) + 0.0 AS x FROM e")
def solve_spd_product(t: Tables):
    e = blocked.Blocked.from_tensor(t.embedding(), (512, 32))
    g = (blocked.einsum("vk,vl->kl", e, e) + blocked.eye(t.spark, 64, 32) * 10.0).written()
    return rows(blocked.dot(tiled.solve_spd(g, e, 32), g).to_tensor(), "vk").toDF("v", "k", "x")


@query(f"WITH {NATIONS}, {CELLS} SELECT n // 5 AS a, n % 5 AS b, m AS c, round(v, 3) + 0.0 AS v FROM cells")
def hosvd_product(t: Tables):
    """The core times all factors: the tensor again."""
    factors, core = multilinear.hosvd(t.nations().reshape(5, 5, 25), (5, 5, 25))
    return rows(einsum("abc,ia,jb,kc->ijk", core, *factors), "abc", 3)


@query(f"WITH {NATIONS}, {CELLS} SELECT n // 5 AS a, n % 5 AS b, m AS c, round(v, 3) + 0.0 AS v FROM cells")
def tensor_svd_product(t: Tables):
    u, s, v = t.nations().reshape(5, 5, 25).i("ijk").svd("ija", "ak")
    return rows(einsum("ija,a,ak->ijk", u, Tensor.from_numpy(t.spark, s), v), "abc", 3)


@query(f"WITH {NATIONS}, {CELLS} SELECT n // 5 AS a, n % 5 AS b, m AS c, round(v, 3) + 0.0 AS v FROM cells")
def svd_batch_product(t: Tables):
    u, s, v = linalg.svd_batch(t.nations().reshape(5, 5, 25))
    return rows(einsum("bik,bk,bkj->bij", u, s, v), "abc", 3)


@query(f"WITH {NATIONS} SELECT n, r, round(sum(v * (1 + (m * r) % 7)), 2) AS v FROM w CROSS JOIN range(4) q(r) GROUP BY ALL")
def ttm(t: Tables):
    m = np.array([[1.0 + (k * r) % 7 for r in range(4)] for k in range(25)])
    return rows(multilinear.ttm(t.nations(), m, 1), "nr", 2)


# Workloads


@query("SELECT i, round(1.0 + i % 3, 4) AS v FROM range(25) r(i)")
def jacobi(t: Tables):
    """The matrix, each nation's trade over its total plus 2 on the diagonal, times what solves for a right-hand side."""
    w = t.nations()
    share = w / w.sum(axis=1).reshape(25, 1)
    a = share + Tensor.eye(t.spark, 25, sparse=True) * 2.0
    a = a._with(checkpointed(a.df))
    b = Tensor(t.spark.range(25).select(F.col("id").alias("i0"), (F.lit(1.0) + F.col("id") % 3).alias("v")), (25,))
    return rows(einsum("ij,j->i", a, workloads.jacobi(a, b, 1e-7)), "i")


def _padded(t: Tables) -> Tensor:
    """Prices of all parts, zeros up to the next power of two."""
    n = t.length("part", "p_partkey")
    return t.price({"p": 1 << max(0, n - 1).bit_length()})


SPECTRUM = """WITH n AS (SELECT 2 ** ceil(log2(max(p_partkey) + 1))::BIGINT AS n FROM part), x AS (SELECT p_partkey AS i, p_retailprice AS v FROM part)
SELECT k, round(sum(v * cos(-2 * pi() * ((i * k) % n) / n)), 3) + 0.0 AS re, round(sum(v * sin(-2 * pi() * ((i * k) % n) / n)), 3) + 0.0 AS im FROM x, n, LATERAL (SELECT unnest(range(n::BIGINT)) AS k) GROUP BY k"""


def _spectrum(x: Tensor):
    return x.df.select(F.col("i0").alias("k"), (F.round("v.re", 3) + F.lit(0.0)).alias("re"), (F.round("v.im", 3) + F.lit(0.0)).alias("im"))


@query(SPECTRUM)
def fft(t: Tables):
    return _spectrum(workloads.fft(_padded(t)))


@query(SPECTRUM)
def fft_split(t: Tables):
    x = _padded(t)
    return _spectrum(workloads.fft_split(x, 1 << (x.shape[0].bit_length() // 2)))


@query(f"""WITH {NATIONS}, x AS (SELECT n // 5 AS a, n % 5 AS b, m AS c, v FROM w), p AS (SELECT i, j, k, v, 2 * pi() * (a * i / 5.0 + b * j / 5.0 + c * k / 25.0) AS p FROM x CROSS JOIN range(5) i(i) CROSS JOIN range(5) j(j) CROSS JOIN range(25) k(k))
SELECT i, j, k, round(sum(v * cos(p)), 2) + 0.0 AS re, round(-sum(v * sin(p)), 2) + 0.0 AS im FROM p GROUP BY ALL""")
def dft_3d(t: Tables):
    z = workloads.dft(t.nations().reshape(5, 5, 25))
    return z.df.select(F.col("i0").alias("i"), F.col("i1").alias("j"), F.col("i2").alias("k"), (F.round("v.re", 2) + F.lit(0.0)).alias("re"), (F.round("v.im", 2) + F.lit(0.0)).alias("im"))


@query(f"""WITH {NATIONS} SELECT (n + a) % 25 AS n, (m + b) % 25 AS m, round(sum(v * (1 + a * 2 + b)), 4) AS v FROM w CROSS JOIN range(2) p(a) CROSS JOIN range(2) q(b) GROUP BY ALL""")
def convolution(t: Tables):
    return rows(workloads.convolve(t.nations(), Tensor.from_numpy(t.spark, np.array([[1.0, 2.0], [3.0, 4.0]]))), "nm")


@query("""SELECT a.s_suppkey AS i, round(sum((a.s_acctbal - b.s_acctbal) / (1 + abs(a.s_acctbal - b.s_acctbal))), 6) + 0.0 AS v FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey GROUP BY ALL""")
def particle_forces(t: Tables):
    n = t.length("supplier", "s_suppkey")
    x = Tensor.from_unique(t.read("supplier"), ["s_suppkey"], "s_acctbal", (n,))
    found = workloads.grouped(x.df, t.supplier_nation({"s": n}).df.select("i0", F.col("i1").alias("g")), lambda a, b: (a - b) / (1 + F.abs(a - b)))
    return rows(x._with(found), "i", 6)


@query("""SELECT a.c_custkey AS i, round(sum((a.c_acctbal - b.c_acctbal) / (1 + abs(a.c_acctbal - b.c_acctbal))), 4) + 0.0 AS v FROM customer a JOIN customer b
ON b.c_acctbal BETWEEN a.c_acctbal - 150 AND a.c_acctbal + 150 WHERE a.c_custkey <> b.c_custkey AND sqrt((a.c_acctbal - b.c_acctbal) ** 2 + (100.0 * (a.c_nationkey - b.c_nationkey)) ** 2) <= 150 GROUP BY 1""")
def particles_within(t: Tables):
    """Customers are points by balance and nation, those within 150 of each other act on each other; neighbours are found by cells."""
    points = t.read("customer").select(F.col("c_custkey").alias("i0"), F.col("c_acctbal").alias("x"), (F.col("c_nationkey") * 100.0).alias("y"))
    force = lambda a, b: (a - b) / (1 + F.abs(a - b))
    return rows(workloads.within(points, ["x", "y"], 150.0, force, "x", t.length("customer", "c_custkey")), "i")


@query(f"WITH {NATIONS} SELECT a.n_regionkey::BIGINT AS a, b.n_regionkey::BIGINT AS b, round(sum(v), 2) AS v FROM w JOIN nation a ON w.n = a.n_nationkey JOIN nation b ON w.m = b.n_nationkey GROUP BY ALL")
def galerkin(t: Tables):
    return rows(workloads.galerkin(t.nations(), t.nation_region()), "ab", 2)


@query("SELECT s_suppkey AS i, floor(s_acctbal / 1000) AS v FROM supplier")
def multigrid_suppliers(t: Tables):
    """The Laplacian of the suppliers' graph, plus one: what solves it for their balances in thousands, times it again. Levels follow from the matrix."""
    a = laplacian(graph(t), 1.0)
    b = Tensor.from_unique(t.read("supplier"), ["s_suppkey"], F.floor(F.col("s_acctbal") / 1000), a.shape[:1])
    found = Hierarchy.of(a, 24)
    x = found.solve(b._with(checkpointed(b.df)), 1e-4, rounds=1)
    return rows(einsum("ij,j->i", found.levels[0], x), "i", 1)


@query("SELECT i, round((i + 1) * (15 - i) / 2.0, 3) AS v FROM range(15) r(i)")
def multigrid(t: Tables):
    """Cycles on a Poisson problem whose solution is known."""
    a = workloads.poisson(t.spark, 15)
    p = np.zeros((15, 7))
    for j in range(7):
        p[2 * j : 2 * j + 3, j] = [0.5, 1, 0.5]
    pt = Tensor.from_numpy(t.spark, p, sparse=True)
    b = Tensor.ones(t.spark, (15,))
    levels, x = [a._with(checkpointed(a.df)), workloads.galerkin(a, pt)], b * 0.0
    for _ in range(6):
        x = workloads.v_cycle(levels, [pt], b, x)
    return rows(x, "i", 3)


@query("SELECT row_number() OVER (ORDER BY v) - 1 AS i, v FROM (SELECT p_retailprice AS v FROM part UNION ALL SELECT 0 FROM (SELECT unnest(range((2 ** ceil(log2(max(p_partkey) + 1)) - count(*))::BIGINT)) FROM part))")
def bitonic(t: Tables):
    return rows(workloads.bitonic_sort(_padded(t)), "i", None)


@query("SELECT coalesce(l_suppkey, -1) AS s, coalesce(n_regionkey, -1)::BIGINT AS r, round(sum(l_quantity), 4) AS v, grouping(l_suppkey)::BIGINT AS gs, grouping(n_regionkey)::BIGINT AS gr FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY CUBE (l_suppkey, n_regionkey)")
def label_cube(t: Tables):
    """Sums over every subset of labels at once."""
    k = t.lengths()
    x = einsum("ops,oc,cn,nr->sr", t.items(shape=k), t.order_customer(k), t.customer_nation(k), t.nation_region())
    cube = x.df.cube("i0", "i1").agg(F.round(F.sum("v"), 4).alias("v"), F.grouping("i0").cast("bigint").alias("gs"), F.grouping("i1").cast("bigint").alias("gr"))
    return cube.select(F.coalesce("i0", F.lit(-1)).cast("bigint").alias("s"), F.coalesce("i1", F.lit(-1)).cast("bigint").alias("r"), "v", "gs", "gr")


@query("SELECT user_id AS u, round(sum(value), 4) AS v FROM events WHERE value IS NOT NULL GROUP BY ALL")
def streamed_sums(t: Tables):
    """Point writes from a stream of the events."""
    import uuid

    from ..streaming.upserts import StreamedTensor

    path = f"{shared_folder(t.spark)}/stream-{uuid.uuid4().hex}"
    source = t.read("events")
    stream = t.spark.readStream.schema(source.schema).parquet(f"{t.dir}/events.parquet*" if not t.dir.startswith("viewfs") else f"{t.dir}/events.parquet")
    points = stream.where("value is not null").select(F.col("user_id").alias("i0"), F.col("value").alias("v"))
    target = StreamedTensor(t.spark, f"{path}/data", 1)
    target.start(points, f"{path}/checkpoint").awaitTermination()
    return target.read().select(F.col("i0").alias("u"), F.round("v", 4).alias("v"))


from . import handles, kernels  # noqa: E402, F401
