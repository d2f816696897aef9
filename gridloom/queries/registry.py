"""Where queries are registered, each with the SQL that gives the same rows, and the SQL that many share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.algebras import MIN_PLUS
from ..operators.tensor import Tensor, einsum
from ..sources.checkpoint import checkpointed
from .tables import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def rounded(v: Column, digits: int) -> Column:
    """v to so many digits as the SQL's engine rounds, halves of v * 10^digits away from zero: by arithmetic, where Spark's round goes through decimal numbers for each row. Numbers too large for that, and those that aren't finite, go by Spark's."""
    scaled = F.abs(v) * F.lit(float(10**digits))
    down = F.floor(scaled).cast("double")
    near = (down + F.when(scaled - down >= 0.5, 1.0).otherwise(0.0)) / F.lit(float(10**digits))
    return F.when(scaled < float(1 << 52), F.when(v < 0, -near).otherwise(near)).otherwise(F.round(v, digits)) + F.lit(0.0)


def rows(t: Tensor, names: str, digits: int | None = 4, many: bool = False) -> DataFrame:
    """A tensor's rows under readable names; doubles rounded, so that sums in any order agree. many: rows are so many that rounding must be cheap."""
    v = F.col("v")
    if digits is not None and t.dtype.startswith("float"):
        v = rounded(v, digits) if many else F.round(v, digits) + F.lit(0.0)
    return t.df.select(*(F.col(f"i{k}").alias(n) for k, n in enumerate(names)), v.alias("v"))


def one(spark: SparkSession, **values) -> DataFrame:
    kinds = {float: "double", int: "bigint", bool: "boolean"}
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()))


TRADE = """trade AS (SELECT c_nationkey::BIGINT AS n, l_suppkey AS s, sum(l_quantity) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey GROUP BY ALL)"""
NATIONS = """w AS (SELECT c_nationkey::BIGINT AS n, s_nationkey::BIGINT AS m, sum(l_quantity) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey
JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)"""
CELLS = "cells AS (SELECT a.i AS n, b.i AS m, coalesce(v, 0) AS v FROM range(25) a(i) CROSS JOIN range(25) b(i) LEFT JOIN w ON w.n = a.i AND w.m = b.i)"
EMB = "e AS (SELECT vec_id AS i, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS k FROM embeddings)"
REGIONS = f"{NATIONS}, r AS (SELECT a.n_regionkey::BIGINT AS x, b.n_regionkey::BIGINT AS y, sum(v) AS v FROM w JOIN nation a ON w.n = a.n_nationkey JOIN nation b ON w.m = b.n_nationkey GROUP BY ALL), q AS (SELECT x, y, v / (SELECT max(v) FROM r) AS v FROM r)"
#: Suppliers on neighbouring lines of an order, both of over 40 pieces; the weight is what the lighter such pair has beyond 80.
GRAPH = """g AS (SELECT a.l_suppkey AS n, b.l_suppkey AS m, min(a.l_quantity + b.l_quantity - 80) AS v FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
WHERE a.l_quantity > 40 AND b.l_quantity > 40 AND a.l_suppkey <> b.l_suppkey GROUP BY ALL)"""


def doubled(rounds: int) -> str:
    """CTEs d0 .. of least path weights over up to 2^k edges of g, zero from each vertex to itself."""
    first = "d0 AS (SELECT n, m, min(v) AS v FROM (SELECT n, m, v FROM g UNION ALL SELECT s_suppkey, s_suppkey, 0 FROM supplier) GROUP BY ALL)"
    return ", ".join([first, *(f"d{k + 1} AS (SELECT a.n, b.m, min(a.v + b.v) AS v FROM d{k} a JOIN d{k} b ON a.m = b.n GROUP BY ALL)" for k in range(rounds))])


def graph(t: Tables) -> Tensor:
    """The graph of GRAPH."""
    line = t.read("lineitem").where("l_quantity > 40")
    a = line.select("l_orderkey", F.col("l_suppkey").alias("a"), (F.col("l_linenumber") + 1).alias("at"), F.col("l_quantity").alias("x"))
    b = line.select("l_orderkey", F.col("l_suppkey").alias("b"), F.col("l_linenumber").alias("at"), F.col("l_quantity").alias("y"))
    edges = a.join(b, ["l_orderkey", "at"]).where("a != b")
    n = t.length("supplier", "s_suppkey")
    return Tensor.from_df(edges, ["a", "b"], F.col("x") + F.col("y") - 80, (n, n), algebra=MIN_PLUS)


def regions(t: Tables) -> Tensor:
    """Trade between regions, divided by the largest."""
    r = t.nation_region()
    x = einsum("nm,nr,ms->rs", t.nations(), r, r)
    return checkpointed_tensor(x * (1.0 / x.norm_inf()))


def checkpointed_tensor(x: Tensor) -> Tensor:
    return x._with(checkpointed(x.df))
