"""The provided tables as tensors. Keys are 0-based and dense, so they are modes as they are."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tensor import Tensor

_LARGEST: dict[tuple[str, str], dict[tuple[str, str], int]] = {}


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def length(self, table: str, key: str) -> int:
        """One more than the largest key."""
        return self._largest([(table, key)])[0] + 1

    def _largest(self, columns: list[tuple[str, str]]) -> list[int]:
        """The largest value of each column, all in one job. Remembered for a folder while the application runs."""
        known = _LARGEST.setdefault((self.spark.sparkContext.applicationId, self.dir), {})
        if missing := [c for c in columns if c not in known]:
            parts = [self.read(t).agg(F.max(k).cast("long").alias("most")).select(F.lit(n).alias("n"), "most") for n, (t, k) in enumerate(missing)]
            for r in reduce(DataFrame.unionByName, parts).collect():
                known[missing[r["n"]]] = r["most"] or 0
        return [known[c] for c in columns]

    def lengths(self) -> dict[str, int]:
        o, p, s, c = self._largest([("orders", "o_orderkey"), ("part", "p_partkey"), ("supplier", "s_suppkey"), ("customer", "c_custkey")])
        return {"o": o + 1, "p": p + 1, "s": s + 1, "c": c + 1, "n": 25, "r": 5}

    def items(self, value: str = "l_quantity", shape=None, unique: bool = False) -> Tensor:
        """L(o, p, s): quantity. Places may repeat: rows are left as they are for queries that sum over a mode, which sums repeats too, and summed first where unique is set."""
        k = shape or self.lengths()
        rows = self.read("lineitem")
        make = Tensor.from_df if unique else Tensor.from_unique
        t = make(rows, ["l_orderkey", "l_partkey", "l_suppkey"], value, (k["o"], k["p"], k["s"]), rows=4.0 * k["o"])
        return t

    def order_customer(self, k) -> Tensor:
        return Tensor.from_unique(self.read("orders"), ["o_orderkey", "o_custkey"], None, (k["o"], k["c"]), rows=k["o"])

    def customer_nation(self, k) -> Tensor:
        return Tensor.from_unique(self.read("customer"), ["c_custkey", "c_nationkey"], None, (k["c"], 25), rows=k["c"])

    def supplier_nation(self, k) -> Tensor:
        return Tensor.from_unique(self.read("supplier"), ["s_suppkey", "s_nationkey"], None, (k["s"], 25), rows=k["s"])

    def nation_region(self) -> Tensor:
        return Tensor.from_unique(self.read("nation"), ["n_nationkey", "n_regionkey"], None, (25, 5), rows=25)

    def price(self, k) -> Tensor:
        return Tensor.from_unique(self.read("part"), ["p_partkey"], "p_retailprice", (k["p"],), rows=k["p"])

    def trade(self, k=None) -> Tensor:
        """N(n, s): quantity by customer nation and supplier."""
        from ..operators.tensor import einsum

        k = k or self.lengths()
        return einsum("ops,oc,cn->ns", self.items(shape=k), self.order_customer(k), self.customer_nation(k))

    def nations(self) -> Tensor:
        """W(n, m): quantity by customer nation and supplier nation. Written once, as its 625 places are read by most queries several times."""
        from ..operators.tensor import einsum
        from ..sources.checkpoint import checkpointed

        k = self.lengths()
        w = einsum("ops,oc,cn,sm->nm", self.items(shape=k), self.order_customer(k), self.customer_nation(k), self.supplier_nation(k))
        return w._with(checkpointed(w.df))

    def embedding(self, most: int | None = None) -> Tensor:
        rows = self.read("embeddings")
        if most is not None:
            rows = rows.where(F.col("vec_id") < most)
        n = most or self.length("embeddings", "vec_id")
        flat = rows.select("vec_id", F.posexplode("embedding").alias("k", "x"))
        return Tensor.from_unique(flat, ["vec_id", "k"], "x", (n, 64), rows=64.0 * n)

    def factor(self, n: int, rank: int = 4):
        """An n x rank factor from the first embeddings."""
        return self.embedding(n)[:, :rank]
