"""Numbers as text, against Python's own."""

import csv
import glob
import json

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from pairwright.functions.texts import number_text
from pairwright.plans.coordinate import coordinate_text, results
from pairwright.sources.tables import write_csv


def test_numbers_as_python_writes_them(spark):
    g = np.random.default_rng(1)
    x = np.concatenate([g.integers(0, 2**64, 5000, dtype=np.uint64).view(float), g.normal(size=3000), np.round(g.normal(size=2000), 3), 10.0 ** np.arange(-20, 20), 2.0 ** np.arange(-1074, 1023, 7), [0.0, -0.0, np.inf, -np.inf, 1e-5, 1e16, 9999999999999998.0]])
    x = x[~np.isnan(x)]
    found = spark.createDataFrame(pd.DataFrame({"x": x})).select("x", number_text(F.col("x")).alias("s")).collect()
    assert [(r["x"], r["s"]) for r in found if str(float(r["x"])) != r["s"]] == []
    assert spark.createDataFrame([(None,)], "x double").select(number_text(F.col("x"))).first()[0] is None


def test_results_and_files_have_that_text(spark, tmp_path):
    table = spark.createDataFrame([(1, 1e-05, 0.1), (2, None, 1e16)], "id long, a double, b double")
    write_csv(table, f"file://{tmp_path}/out")
    rows = {r["id"]: (r["a"], r["b"]) for p in glob.glob(f"{tmp_path}/out/*.csv") for r in csv.DictReader(open(p, encoding="utf-8"))}
    assert rows == {"1": ("1e-05", "0.1"), "2": ("", "1e+16")}
    found = results(coordinate_text(spark, "pid,a\n1,10\n2,20\n3,\n", "geo,a\nx,10.00001\ny,20\n"))
    distances = [r["euc_distance"] for r in found["linked_rows"].orderBy("pid").collect()]
    assert distances[1:] == ["0.0", ""] and "e-0" in distances[0]


def test_scenarios_are_json(spark):
    found = coordinate_text(spark, "pid,a,b\n1,10,1\n2,20,\n3,,\n", "geo,a,b\nx,11,1\ny,21,2\n")
    rows = {r["target_idx"]: json.loads(r["scenario"]) for r in found.scenarios(5).collect()}
    assert [c["row"] for c in rows[0]["candidates"]] == [0, 1] and rows[2]["candidates"] == [] and rows[2]["no_match"]
    assert [t["feature"] for t in rows[1]["candidates"][0]["terms"]] == ["a", "b"] and rows[1]["candidates"][0]["terms"][1]["target"] is None
    best = rows[0]["candidates"][0]
    assert abs(sum(t["term"] for t in best["terms"]) - best["distance"] ** 2) < 1e-5
