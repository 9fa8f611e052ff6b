"""Queries against their SQL on tables whose results hang on a half or on a tie."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from pairwright.operators import standardize
from pairwright.plans import registry


def tables(folder, balances, suppliers):
    g = np.random.default_rng(4)
    n, m = len(balances), len(suppliers)
    key = np.arange(n)
    pd.DataFrame({"c_custkey": key, "c_name": [f"c{k}" for k in key], "c_nationkey": g.integers(0, 3, n).astype(np.int32), "c_acctbal": balances, "c_mktsegment": "S"}).to_parquet(f"{folder}/customer.parquet")
    pd.DataFrame({"s_suppkey": np.arange(m), "s_name": [f"s{k}" for k in range(m)], "s_nationkey": g.integers(0, 3, m).astype(np.int32), "s_acctbal": suppliers}).to_parquet(f"{folder}/supplier.parquet")
    return str(folder)


def both(spark, folder, name):
    c = duckdb.connect()
    for t in ("customer", "supplier"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    frame = registry.queries()[name](spark, folder)
    wanted = c.sql(f"SELECT {', '.join(frame.columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    return sorted(map(str, (tuple(r) for r in frame.collect()))), sorted(map(str, wanted))


def test_halves_are_rounded_as_in_sql(spark, tmp_path):
    found, wanted = both(spark, tables(tmp_path, np.arange(70) - 10.5, [1.0]), "clean_values")
    assert found == wanted


@pytest.mark.parametrize("name", ["match", "explained_match", "scenario_json"])
def test_ties_do_not_hang_on_the_last_bits_of_a_deviation(spark, tmp_path, name):
    """Customers in the middle between two suppliers, to the cent."""
    g = np.random.default_rng(7)
    suppliers = np.round(g.random(60) * 9000, 1)
    pairs = g.integers(0, 60, (600, 2))
    found, wanted = both(spark, tables(tmp_path, np.round(suppliers[pairs].mean(axis=1), 2), suppliers), name)
    assert found == wanted


def test_scales_do_not_depend_on_the_order_of_rows(spark):
    x = np.random.default_rng(3).normal(4500, 3100, 3000).round(2)
    found = set()
    for seed in range(6):
        order = np.random.default_rng(seed).permutation(len(x))
        table = spark.createDataFrame(pd.DataFrame({"cells": [[v] for v in x[order].tolist()]}), "cells array<double>").repartition(1 + seed)
        figures = standardize.pooled_figures(table, table, 1)
        found.add((figures.scales[0].mean, figures.scales[0].deviation))
    assert len(found) == 1
    assert abs(found.pop()[1] / x.std() - 1) < 1e-9
