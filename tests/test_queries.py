"""A cross-section of the catalogue against DuckDB on the smallest tables, and what the planner decides."""

import os

import pytest

from gridloom.plans import planner, subscripts
from gridloom.queries import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()
SOME = ["contract_3way", "contract_region", "hadamard", "einsum_broadcast", "sum_expression", "ufuncs", "row_extremes", "running_revenue", "slice_stride", "assign_region", "take", "point_write", "min_plus", "desymmetrize", "tttp", "convolution", "complex_sum", "label_cube", "reductions", "top_k", "sssp", "betweenness", "qr_product", "fft", "mp3_energy", "product_storages", "dense_binary", "packed_matvec", "constructors"]


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no tables here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, bool):
        return v
    return float(v) if isinstance(v, (int, float)) else v


@pytest.mark.parametrize("name", SOME)
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    key = lambda r: tuple(map(repr, r))
    assert sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=key) == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=key)


def test_entry_lists_queries_with_unique_columns():
    import __spark_entry__

    assert set(catalog.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_order_keeps_intermediates_small():
    sizes = {"o": 10**6, "p": 10**4, "s": 10**3, "c": 10**5, "n": 25, "r": 5}
    leaves = [(frozenset("os"), 4e6), (frozenset("oc"), 1e6), (frozenset("cn"), 1e5), (frozenset("nr"), 25.0)]
    steps = planner.order(leaves, {"r"}, sizes)
    # The largest operand loses its orders at once: 4e6 rows joined, 1e5 customers kept.
    assert set(steps[0]) == {0, 1}
    assert len(planner.order([(frozenset((chr(97 + i), chr(98 + i))), 64.0) for i in range(12)], {"a", "m"}, dict.fromkeys("abcdefghijklm", 8))) == 11


def test_labels_are_summed_before_joins(spark):
    from gridloom.operators.tensor import Tensor, einsum

    df = spark.range(100).selectExpr("id as i0", "id % 7 as i1", "1.0D as v")
    a, b = Tensor(df, (100, 7)), Tensor(df.selectExpr("i1 as i0", "i0 as i1", "v"), (7, 100))
    plan = einsum("ij,jk->j", a, b).df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.rindex("Aggregate")
    assert plan.count("Aggregate") >= 2


def test_parse():
    assert subscripts.parse("ij,jk", 2) == (["ij", "jk"], "ik")
    with pytest.raises(ValueError):
        subscripts.sizes(["ij", "jk"], [(2, 3), (4, 5)])
