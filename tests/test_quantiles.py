"""Exact quantiles and leading counts against plain restatements."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairwright.operators import candidates, quantiles


@pytest.mark.parametrize("few", [0, 5, 4096])
def test_quantiles_equal_numpy(spark, monkeypatch, few):
    monkeypatch.setattr(quantiles, "FEW", few)
    g = np.random.default_rng(3)
    columns = {
        "normal": g.normal(size=500), "ties": np.rint(g.normal(size=500)), "one": np.full(500, -2.5), "zeros": np.where(g.random(500) < 0.5, 0.0, -0.0),
        "wide": g.normal(size=500) * 10.0 ** g.integers(-300, 300, 500), "close": 1 + np.arange(500) * 2.0**-52, "signs": np.concatenate([np.full(250, -1e-320), np.full(250, 1e-320)]),
    }
    rows = [tuple(float(c[k]) for c in columns.values()) for k in range(500)]
    table = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in columns))
    wanted = {f"{c} {q}": (F.col(c), q) for c in columns for q in (0.0, 0.25, 0.5, 0.613, 1.0)}
    for name, got in quantiles.exact_quantiles(table, wanted).items():
        c, q = name.split()
        x = np.sort(columns[c])
        at = float(q) * 499
        low, high = x[math.floor(at)], x[math.ceil(at)]
        assert got == (low if low == high else (math.ceil(at) - at) * low + (at - math.floor(at)) * high), name


def test_quantiles_of_little(spark):
    table = spark.createDataFrame([(1.0, None, None), (None, None, float("nan")), (3.0, None, float("inf"))], "a double, b double, c double")
    assert quantiles.exact_quantiles(table, {"a": (F.col("a"), 0.5), "b": (F.col("b"), 0.5), "c": (F.col("c"), 0.5)}) == {"a": 2.0, "b": None, "c": float("inf")}
    assert quantiles.exact_quantiles(table.limit(0), {"a": (F.col("a"), 0.5)}) == {"a": None}
    assert quantiles.exact_quantiles(table, {}) == {}


def test_no_task_gives_more_than_its_counters(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "FEW", 0)
    monkeypatch.setattr(quantiles, "_some", None)  # values themselves never travel
    table = spark.range(0, 20_000, 1, 3).select((F.col("id") % 17).cast("double").alias("x"))
    assert quantiles.exact_quantiles(table, {"m": (F.col("x"), 0.5)}) == {"m": 8.0}


def test_leading_counts_equal_plain_loops(spark):
    r = random.Random(2)
    row = lambda k: (k, *(r.choice([None, 1, 2, 3]) for _ in range(3)))
    target, pool = [row(k) for k in range(40)], [row(k) for k in range(60)]
    kinds = "id long, a int, b int, c int"
    got = {(x["id"], x["k"]): x["n"] for x in candidates.leading_counts(spark.createDataFrame(target, kinds), spark.createDataFrame(pool, kinds), "id", ["a", "b", "c"]).collect()}
    want = {(t[0], k): sum(all(t[c] is not None and t[c] == p[c] for c in range(1, k + 1)) for p in pool) for t in target for k in (1, 2, 3)}
    assert got == want


def test_groups_of_duplicates_do_not_multiply(spark):
    kinds = "id long, a int, b int"
    target, pool = [(k, 1, k % 2) for k in range(50)] + [(99, None, 1)], [(k, 1, k % 3) for k in range(60)] + [(98, 7, 7), (97, None, 1)]
    found, members = candidates.duplicate_groups(spark.createDataFrame(target, kinds), spark.createDataFrame(pool, kinds), "id", "id", ["a", "b"], [1, 2])
    found, members = found.collect(), members.collect()
    assert len(found) == 100 and len(members) == 60 + 40  # not 50 times 60
    by = {}
    for r in members:
        by.setdefault((r["k_variables"], r["group_id"]), []).append(r["id"])
    for r in found:
        own = next(t for t in target if t[0] == r["id"])
        assert sorted(by[r["k_variables"], r["group_id"]]) == [p[0] for p in pool if p[1 : 1 + r["k_variables"]] == own[1 : 1 + r["k_variables"]]] and r["n_matching"] == len(by[r["k_variables"], r["group_id"]])
