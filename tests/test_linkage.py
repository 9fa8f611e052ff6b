import csv
import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairwright.functions import signals
from pairwright.operators import candidates, diagnostics
from pairwright.operators.linking import ColumnLink
from pairwright.plans import coordinate, registry
from pairwright.plans.coordinate import coordinate_text, coordinator, write_package
from pairwright.sources.shared import names_in, shared_folder
from pairwright.sources.tables import load_csv, parse_csv_text, with_row_index
from pairwright.streaming.match_stream import StreamMatcher

TARGET = "pid,a,b\nt1,10,100\nt2,20,200\nt3,,300\nt4,,\nt5,31,310\nt6,10,100\n"
SUPPLEMENTAL = "geo,a,b,extra\ng1,10,100,x\ng2,10,100,y\ng3,20,200,z\ng4,30,300,w\ng5,,,v\n"


@pytest.fixture(scope="module")
def found(spark):
    return coordinate_text(spark, TARGET, SUPPLEMENTAL)


def rows(found):
    return {r["target_idx"]: r for r in found.per_target.collect()}


def test_ties_missing_cells_and_no_match(found):
    r = rows(found)
    assert [r[i]["match_idx"] for i in range(6)] == [0, 2, 3, None, 3, 0]
    assert [r[i]["repeats"] for i in range(6)] == [2, 1, 1, 0, 1, 2]
    assert [r[i]["mnn_confirmed"] for i in range(6)] == [True, True, False, False, True, True]
    assert r[2]["best_distance"] == pytest.approx(1.414214, abs=1e-6) and r[2]["nndr"] == pytest.approx(0.7828, abs=1e-4)
    assert r[4]["contributions"] == pytest.approx([0.5236, 0.4764], abs=1e-4)
    assert r[3]["contributions"] == [0.0, 0.0] and r[3]["match_missing"] is None
    assert found.smd == pytest.approx([0.22486, 0.019745], abs=1e-5)


def test_flags(found):
    r = rows(found)
    assert r[0]["flags"] == "ambiguous match — NNDR 1.00 (>= 0.80) | 1 near-miss row(s) within distance ratio threshold | 2 exact-distance tie(s) | feature imbalance — a (|SMD| > 0.10)"
    assert r[2]["flags"].startswith("MNN not confirmed") and "target row missing 1 of 2 shared feature(s)" in r[2]["flags"]
    assert r[3]["flag_list"] == ["WARNING: no valid match — target shares no observed features with any supplemental row", "target row missing 2 of 2 shared feature(s); match uses observed features only"]


def test_ratios_are_rounded_by_their_exact_value(spark):
    values = [k / 1000 for k in range(63, 1001)] + [0.125, 0.375, 0.625, 0.875, 1.0, 0.0, 0.8049999999999999, 0.9949999999999999, 0.9999999999999999]
    table = spark.createDataFrame([(v,) for v in values], "x double").select("x", signals.two_places(F.col("x")).alias("s"))
    assert [(r["x"], r["s"]) for r in table.collect() if r["s"] != f"{r['x']:.2f}"] == []


def test_summary_and_statistics(found):
    s = found.summary().first()
    assert (s["total"], s["no_match"], s["mnn_confirmed"], s["flagged"]) == (6, 1, 4, 6)
    stats = {r["metric"]: r["value"] for r in found.match_stats().collect()}
    assert len(stats) == 19 and stats["rows_with_ties"] == 2 and stats["no_match_count"] == 1 and stats["min_best_distance"] == 0
    assert [r["flag"] for r in found.feature_smd().collect()] == ["warning", "ok"]


def test_linked_and_detail(found):
    linked = {r["pid"]: r for r in found.linked().collect()}
    assert linked["t2"]["geo"] == "g3" and linked["t2"]["extra"] == "z" and linked["t4"]["geo"] is None and linked["t4"]["repeats"] == 0
    assert found.linked().columns == ["target_index", "pid", "a", "b", "geo", "extra", "euc_distance", "repeats", "nndr", "near_miss_count", "mnn_confirmed", "flags"]
    detail = {r["target_index"]: r for r in found.detail().collect()}
    assert detail[4]["contrib_a"] == pytest.approx(0.5236, abs=1e-4) and detail[3]["contrib_a"] is None and detail[3]["nndr"] is None


def test_views_and_ablation(found):
    raw = {(r["target_idx"], r["feature"]): (r["target_raw"], r["match_raw"]) for r in found.raw_pairs().collect()}
    assert raw[2, "a"] == ("", "30") and raw[3, "b"] == ("", "")
    best = [r for r in found.explained(1).collect() if r["target_idx"] == 4]
    assert {r["supp_idx"] for r in best} == {3} and len(best) == 2
    assert found.without_feature("a").names == ["b"]
    page = diagnostics.results_page(found.per_target, "best_distance", descending=True, size=2).collect()
    assert page[0]["no_match"] and page[1]["target_idx"] == 2


def test_mutual_confirmation(spark):
    found = coordinate_text(spark, "a\n10\n11\n30\n50\n70\n", "a,tag\n10,p\n31,q\n51,r\n71,s\n")
    r = rows(found)
    assert [r[i]["match_idx"] for i in range(5)] == [0, 0, 1, 2, 3]
    assert [r[i]["mnn_confirmed"] for i in range(5)] == [True, False, True, True, True]


def test_missing_feature_is_charged(spark):
    r = rows(coordinate_text(spark, "a,b\n10,\n20,200\n", "a,b\n10,100\n20,200\n90,900\n"))
    assert r[0]["best_distance"] == pytest.approx(2**0.5) and r[0]["near_miss"] == 1 and not r[0]["mnn_confirmed"]
    assert all("poor feature balance — b" in r[i]["flags"] for i in (0, 1))


def test_errors(spark):
    with pytest.raises(ValueError, match="No shared columns"):
        coordinate_text(spark, "a\n1\n", "b\n1\n")
    with pytest.raises(ValueError, match="target dataset has no rows"):
        coordinate_text(spark, "a\n", "a\n1\n")
    with pytest.raises(ValueError, match="line 3, column 'a': cannot parse 'oops'"):
        coordinate_text(spark, "a\n1\noops\n", "a\n1\n")


def test_explicit_links(spark):
    r = rows(coordinate_text(spark, "x,y\n1,5\n2,6\n", "p,q\n6,9\n5,8\n", links=[ColumnLink("v", 1, 0)]))
    assert [r[0]["match_idx"], r[1]["match_idx"]] == [1, 0]


def test_csv_files(spark, tmp_path):
    a, b = tmp_path / "a.csv", tmp_path / "b.csv"
    a.write_bytes("﻿id,Total ,note\r\n1,\"1,000\",\"x\r\ny\"\r\n\r\n2,$2,é\r\n".encode())
    b.write_text("Total,code\n1000,04019\n2,007\n")
    t = load_csv(spark, str(a))
    assert t.headers == ["id", "Total ", "note"] and [r["row_index"] for r in t.rows.orderBy("row_index").collect()] == [0, 1]
    assert t.rows.orderBy("row_index").first()["c2"].replace("\r", "") == "x\ny"
    assert coordinator(spark, str(a), str(b), str(tmp_path / "out.csv")) == []
    written = [r for p in glob.glob(f"{tmp_path}/out.csv/*.csv") for r in csv.DictReader(open(p, encoding="utf-8"))]
    assert {r["id"]: r["code"] for r in written} == {"1": "04019", "2": "007"}
    assert glob.glob(f"{tmp_path}/out_detail.csv/*.csv")
    write_package(coordinate.link_tables(t, load_csv(spark, str(b))), f"file://{tmp_path}/package")
    assert {p.split("/")[-1] for p in glob.glob(f"{tmp_path}/package/*")} == {"linked_dataset", "results", "diagnostics", "inputs", "readme"}
    write_package(coordinate.link_tables(t, load_csv(spark, str(b))), f"file://{tmp_path}/exact", [f"file://{a}", f"file://{b}"])
    assert all((tmp_path / "exact" / "inputs" / x.name).read_bytes() == x.read_bytes() for x in (a, b))


def test_csv_faults(spark, tmp_path):
    empty, ragged, header = tmp_path / "e.csv", tmp_path / "r.csv", tmp_path / "h.csv"
    empty.write_text("")
    ragged.write_text("a,b\n1,2\n3\n")
    header.write_text("a,b\n")
    with pytest.raises(ValueError, match="empty"):
        load_csv(spark, str(empty))
    with pytest.raises(ValueError, match="line 3"):
        load_csv(spark, str(ragged))
    assert load_csv(spark, str(header)).rows.count() == 0
    with pytest.raises(ValueError, match="line 2"):
        parse_csv_text(spark, "a,b\n1\n", "t")


def test_row_index_has_no_gaps(spark):
    df = spark.range(0, 100, 1, 7).withColumnRenamed("id", "v")
    got = with_row_index(df).collect()
    assert all(r["row_index"] == r["v"] for r in got) and len(got) == 100


def test_column_statistics(spark):
    table = spark.createDataFrame([("1",), ("2",), ("abc",), ("NA",), ("3x",)], "c string")
    r = diagnostics.data_stats(table, "target").first()
    assert (r["count_nonmissing"], r["missing"], r["mean"], r["std"], r["min"], r["max"]) == (4, 1, 2.0, 1.0, 1.0, 3.0)
    one = diagnostics.data_stats(table.limit(1), "target").first()
    assert one["std"] == 0.0


def test_uniqueness_accuracy_and_noise(spark):
    t = spark.createDataFrame([(1, 1, 1), (2, 1, 2), (3, 9, 9)], "id int, a int, b int")
    p = spark.createDataFrame([(7, 1, 1), (8, 1, 5), (9, 1, 1)], "pid int, a int, b int")
    g = candidates.candidate_gradient(t, p, "id", ["a", "b"]).orderBy("k_variables").collect()
    assert (g[0]["mean_candidates"], g[0]["max_candidates"], g[1]["max_candidates"]) == (2.0, 3, 2)
    d = candidates.duplicate_detail(t, p, "id", "pid", ["a", "b"], [2]).collect()
    assert [(r["id"], r["matching_ids"]) for r in d] == [(1, "7;9")]
    r = spark.createDataFrame([("clean", 1, 1, "", False), ("clean", 2, 3, "x", False), ("missing_all", None, 3, "w", False)], "scenario string, matched int, truth int, flags string, no_match boolean")
    failures = candidates.floor_failures(candidates.scenario_accuracy(r))
    assert any("clean_accuracy" in f for f in failures) and any("missing_all" in f for f in failures)
    noisy = candidates.perturbed(spark.createDataFrame([(1.0,), (None,), (3.0,)], "v double"), ["v"], 0.1).collect()
    assert noisy[1]["v"] is None and noisy[0]["v"] != 1.0


def test_stream(spark, tmp_path):
    source, out = tmp_path / "in", {}
    targets = spark.createDataFrame([(1, 1.0, 1.0), (2, 5.0, 5.0), (3, None, None)], "id long, a double, b double")
    targets.write.parquet(str(source))
    pool = spark.createDataFrame([(10, 1.1, 1.0), (11, 5.0, 5.2)], "sid long, a double, b double")
    matcher = StreamMatcher(targets, pool, "sid", ["a", "b"])
    query = matcher.start(spark.readStream.schema(targets.schema).parquet(str(source)), "id", lambda df, n: out.update({r["target_idx"]: r["match_idx"] for r in df.collect()}), str(tmp_path / "check"))
    query.awaitTermination()
    assert out == {1: 10, 2: 11, 3: None}


def _stream_tables(spark, n=60):
    g = np.random.default_rng(4)
    targets = [(k, *(None if g.random() < 0.1 else float(g.integers(0, 6)) for _ in range(3))) for k in range(n)]
    pool = [(1000 + k, *(None if g.random() < 0.1 else float(g.integers(0, 6)) for _ in range(3))) for k in range(25)]
    return spark.createDataFrame(targets, "id long, a double, b double, c double"), spark.createDataFrame(pool, "sid long, a double, b double, c double")


@pytest.mark.parametrize("cuts", [[30], [7, 8, 40], list(range(6, 60, 6))])
def test_any_split_of_a_stream_ends_with_the_answer_of_one_batch(spark, tmp_path, cuts):
    targets, pool = _stream_tables(spark)
    features = ["a", "b", "c"]
    whole = {r["target_idx"]: r.asDict() for r in StreamMatcher(targets, pool, "sid", features).match_batch(targets, "id").collect()}
    stream, out = StreamMatcher(targets, pool, "sid", features, state=f"file://{tmp_path}/state"), []
    folder = shared_folder(spark)
    before = len(names_in(spark, folder))
    bounds = [0, *cuts, 60]
    for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
        batch = targets.filter((F.col("id") >= a) & (F.col("id") < b))
        for _ in range(1 + (k == 1)):  # one batch comes twice, as after a failure
            got = []
            stream.take(batch, "id", k, lambda df, n, got=got: got.extend(r.asDict() for r in df.collect()))
        out += got
        assert len(names_in(spark, folder)) == before and len(names_in(spark, f"file://{tmp_path}/state")) <= 2
    kinds = "target_idx long, match_idx long, no_match boolean, best_distance double, second_distance double, repeats long, nndr double, near_miss long, mnn_confirmed boolean, reverse_repeat_count long, batch_id int"
    rows = spark.createDataFrame([tuple(r[c.split()[0]] for c in kinds.split(", ")) for r in out], kinds)
    final = {r["target_idx"]: r.asDict() for r in stream.confirmed(rows).drop("batch_id").collect()}
    assert final == whole
    revoked = {r["target_idx"] for r in stream.revoked(rows).collect()}
    assert revoked == {r["target_idx"] for r in out if r["mnn_confirmed"] and not whole[r["target_idx"]]["mnn_confirmed"]}


SAME = sorted(registry.oracle_sql())


@pytest.mark.parametrize("name", SAME)
def test_same_as_sql(spark, small, name):
    import duckdb

    con = duckdb.connect()
    for t in "customer supplier part orders lineitem embeddings".split():
        con.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    df = registry.queries()[name](spark, small)
    columns = sorted(df.columns)
    want = con.sql(registry.oracle_sql()[name])
    assert sorted(want.columns) == columns

    def norm(v):
        return round(v, 5) + 0.0 if isinstance(v, float) else v

    got = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=str)
    at = [want.columns.index(c) for c in columns]
    assert got == sorted((tuple(norm(r[k]) for k in at) for r in want.fetchall()), key=str)


def test_entry_imports_without_the_optional_part():
    import __spark_entry__

    assert __spark_entry__._additional("pairwright.no_such_part") is None
    assert "match" in __spark_entry__.queries() and F is not None


def test_cascading_ratio_of_lists(spark):
    inf = float("inf")
    lists = [[1.0, 1.0, 1.1, 1.2, 5.0], [1.0, 1.1, 2.0, 1.05], [0.0, 0.0, 0.0, 1.0], [0.0, 2.0], [3.0], [], [inf, inf], [1.0, inf], [4.0, 5.0]]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(lists)], "k long, d array<double>")
    got = {r["k"]: (r["x"]["nndr"], r["x"]["near_misses"]) for r in rows.select("k", signals.cascading_ratio(F.col("d")).alias("x")).collect()}
    assert [got[k] for k in range(9)] == [(1.0, 3), (1 / 1.1, 1), (1.0, 2), (0.0, 0), (0.0, 0), (0.0, 0), (1.0, 0), (0.0, 0), (0.8, 1)]


def test_perturbed_files(spark, tmp_path):
    table = spark.createDataFrame([("a", "1,000", "2", "x", "3"), ("b", "$5", "4", "7", "")], "id string, p string, q string, r string, s string")
    assert candidates.numeric_columns(table, ["id "]) == ["p", "q"]
    first, *_ = paths = candidates.write_perturbed(table, str(tmp_path / "noise"), "id")
    assert [p.rsplit("/", 1)[-1] for p in paths] == ["noise_010pct", "noise_025pct", "noise_050pct"]
    got = {r["id"]: r for r in spark.read.option("header", True).csv(first).collect()}
    assert got["a"]["r"] == "x" and 0 < abs(float(got["a"]["p"]) - 1000) < 500
    again = candidates.perturbed(spark.range(1000).withColumn("v", F.col("id").cast("double")), ["v"], 0.5, key="id")
    noise = again.select(((F.col("v") - F.col("id")) / (0.5 * 288.67)).alias("z")).agg(F.avg("z"), F.stddev("z")).first()
    assert abs(noise[0]) < 0.15 and abs(noise[1] - 1) < 0.1


def test_results_by_name(spark):
    target = spark.createDataFrame([(0, 1.0, "x"), (1, 5.0, None)], "i long, v double, note string")
    supplemental = spark.createDataFrame([(0, 1.0), (1, 4.0), (2, None)], "i long, w double")
    found = coordinate.results(coordinate.coordinate(target, supplemental, [("v", "v", "w")], "i", "i", fast=True))
    assert found["feature_names"] == ["v"] and found["summary"]["total"] == 2 and found["linked_headers"] == found["linked_rows"].columns
    assert all(isinstance(x, str) for r in found["linked_rows"].collect() + found["detail_rows"].collect() for x in r)
