"""Connected components of an edge table, by contraction in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import drop, written


#: Share of all rows from which a key is hot; at most its inverse of keys are.
HOT_SHARE = 1 / 1000


def join_spread(rows: DataFrame, table: DataFrame, key: str, count: str) -> DataFrame:
    """``rows`` joined by ``key`` with a written table of one row a key, whose ``count`` is the number of rows that have it.

    The few hot keys are broadcast and their rows stay where they are; the others meet by a shuffle.
    """
    n = table.agg(F.sum(count)).first()[0] or 0
    hot, others = table.filter(F.col(count) >= n * HOT_SHARE), table.filter(F.col(count) < n * HOT_SHARE)
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(others, key)
    return rows.join(F.broadcast(hot), key).unionByName(cold)


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of the edges (a, b), longs; root is the least node of its component.

    In each round every node goes to the least of itself and its neighbours in an order that
    a new mask gives, and the edges between what is left go on.  Each round takes away a
    constant share of the nodes in expectation, also along paths and around hubs.  Rounds are
    written to the shared folder, so lineage stays short; no more than a count is collected.
    Null ends are passed over; an empty table gives none.
    """
    spark = edges.sparkSession
    left = written(edges.filter("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    chain = None
    for k in range(most_rounds):
        if left.limit(1).count() == 0:
            break
        mask = F.lit(0 if k == 0 else ((0x9E3779B97F4A7C15 * k) & 0x7FFFFFFFFFFFFFFF))
        both = left.select("a", "b").unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(F.col("b").bitwiseXOR(mask)).alias("m"))
        step = written(least.select(F.col("a").alias("from"), F.least("m", F.col("a").bitwiseXOR(mask)).bitwiseXOR(mask).alias("to")), "step")
        ends = left.join(step.select(F.col("from").alias("a"), F.col("to").alias("x")), "a").join(step.select(F.col("from").alias("b"), F.col("to").alias("y")), "b")
        after = written(ends.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
        drop(left.written_to)
        left = after
        if chain is None:
            chain = step.select(F.col("from").alias("node"), F.col("to").alias("root"))
        else:
            moved = chain.join(step.select(F.col("from").alias("root"), F.col("to").alias("next")), "root", "left")
            chain = written(moved.select("node", F.coalesce("next", "root").alias("root")), "chain")
    else:
        raise RuntimeError(f"components are not complete after {most_rounds} rounds")
    if chain is None:
        return spark.createDataFrame([], "node long, root long")
    least = written(chain.groupBy("root").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("n")), "roots")
    return written(join_spread(chain, least, "root", "n").select("node", F.col("least").alias("root")), "components")
