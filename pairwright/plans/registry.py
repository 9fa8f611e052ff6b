"""The queries over the given tables, by name, and their SQL twins.

Doubles are rounded on both sides; discrete results are compared as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cleaning, signals
from ..operators import candidates, diagnostics, standardize
from . import fixtures, oracle
from .fixtures import linkage, read

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[name or f.__name__] = f
        if sql is not None:
            _SQL[name or f.__name__] = sql
        return f

    return add


def six(c: str | Column, name: str | None = None) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name or c)


# Cells of raw tables -------------------------------------------------------------------------

_CELLS_SQL = (
    "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'N/A' WHEN c_custkey % 7 = 1 THEN ' $' || CAST(CAST(c_acctbal AS BIGINT) AS VARCHAR) || ' ' WHEN c_custkey % 7 = 2 THEN '-' "
    "WHEN c_custkey % 7 = 3 THEN c_name WHEN c_custkey % 7 = 4 THEN '1,' || CAST(100 + c_nationkey AS VARCHAR) WHEN c_custkey % 7 = 5 THEN CAST(c_nationkey AS VARCHAR) || 'e2' ELSE CAST(c_nationkey AS VARCHAR) || 'x' END AS cell FROM customer"
)
_BARE = "trim(replace(replace(cell, ',', ''), '$', ''))"
_MISSING = f"lower({_BARE}) IN ({', '.join(repr(t) for t in cleaning.MISSING_TOKENS)})"
_NUMBER = f"regexp_matches({_BARE}, '{cleaning.NUMBER}')"


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, nation = F.col("c_custkey") % 7, F.col("c_nationkey").cast("string")
    cell = (
        F.when(key == 0, "N/A").when(key == 1, F.concat(F.lit(" $"), F.rint("c_acctbal").cast("long").cast("string"), F.lit(" "))).when(key == 2, "-").when(key == 3, F.col("c_name"))
        .when(key == 4, F.concat(F.lit("1,"), (F.col("c_nationkey") + 100).cast("string"))).when(key == 5, F.concat(nation, F.lit("e2"))).otherwise(F.concat(nation, F.lit("x")))
    )
    return read(spark, sf_dir, "customer").select("c_custkey", cell.alias("cell"))


@query(f"WITH cells AS ({_CELLS_SQL}) SELECT c_custkey, {_MISSING} AS missing, CASE WHEN NOT {_MISSING} AND {_NUMBER} THEN CAST({_BARE} AS DOUBLE) END AS value, NOT {_MISSING} AND NOT {_NUMBER} AS invalid FROM cells")
def clean_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with signs, commas, tokens and text as numbers, missing or invalid."""
    cell = F.col("cell")
    return _cells(spark, sf_dir).select("c_custkey", cleaning.is_missing(cell).alias("missing"), cleaning.clean_value(cell).alias("value"), cleaning.is_invalid(cell).alias("invalid"))


@query(
    f"WITH t AS ({oracle._TABLES['accounts'][0]}), s AS ({oracle._TABLES['accounts'][1]}) SELECT 'target' AS side, idx, CASE WHEN f0 IS NULL THEN 1 ELSE 0 END + CASE WHEN f1 IS NULL THEN 1 ELSE 0 END AS missing FROM t "
    "UNION ALL SELECT 'supplemental', idx, CASE WHEN f0 IS NULL THEN 1 ELSE 0 END + CASE WHEN f1 IS NULL THEN 1 ELSE 0 END FROM s"
)
def missing_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing features of every row of both tables."""
    x = linkage(spark, sf_dir, "accounts")

    def side(table: DataFrame, index: str, name: str) -> DataFrame:
        return table.select(F.lit(name).alias("side"), F.col(index).alias("idx"), cleaning.missing_count([F.col(c) for c in x.cells]).alias("missing"))

    return side(x.target_features, "target_idx", "target").unionByName(side(x.supplemental_features, "supp_idx", "supplemental"))


# Standardization -----------------------------------------------------------------------------


@query(oracle.base("accounts") + " SELECT 'target' AS side, idx, round(z0, 6) AS z0, round(z1, 6) AS z1 FROM tz UNION ALL SELECT 'supplemental', idx, round(z0, 6), round(z1, 6) FROM sz")
def joint_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both tables in pooled standard scores."""
    x = linkage(spark, sf_dir, "accounts")
    both = x.target_z.withColumnRenamed("target_idx", "idx").withColumn("side", F.lit("target")).unionByName(x.supplemental_z.withColumnRenamed("supp_idx", "idx").withColumn("side", F.lit("supplemental")))
    return both.select("side", "idx", six("f0", "z0"), six("f1", "z1"))


@query(
    oracle.base("profiles")
    + ", e AS (SELECT 'count' AS feature, (SELECT stddev_pop(f0) FROM t) AS a, (SELECT stddev_pop(f0) FROM s) AS c UNION ALL SELECT 'largest', (SELECT stddev_pop(f1) FROM t), (SELECT stddev_pop(f1) FROM s)) "
    "SELECT feature, round(a, 4) AS target_std, round(c, 4) AS supplemental_std, a / nullif(c, 0) > 50 OR a / nullif(c, 0) < 1e0 / 50 AS mismatch FROM e"
)
def scale_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spreads of both sides, and whether they differ beyond the limit."""
    x = linkage(spark, sf_dir, "profiles")
    report = standardize.scale_report(x.target_features, x.supplemental_features, x.cells)
    name = F.create_map(*[F.lit(v) for c, n in zip(x.cells, x.names, strict=True) for v in (c, n)])[F.col("feature")]
    return report.select(name.alias("feature"), F.round("target_std", 4).alias("target_std"), F.round("supplemental_std", 4).alias("supplemental_std"), "mismatch")


# Matching ------------------------------------------------------------------------------------

_MATCH = "target_idx, match_idx, no_match, round(best_distance, 6) AS best_distance, round(second_distance, 6) AS second_distance, repeats, round(nndr, 6) AS nndr, near_miss, mnn_confirmed, reverse_repeat_count"


def _matches(fixture: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _rounded(linkage(spark, sf_dir, fixture).matches)

    return run


def _rounded(found: DataFrame) -> DataFrame:
    return found.select("target_idx", "match_idx", "no_match", six("best_distance"), six("second_distance"), "repeats", six("nndr"), "near_miss", "mnn_confirmed", "reverse_repeat_count")


for _name, _fixture in (("match", "accounts"), ("match_ties", "nations"), ("match_overlap", "overlap"), ("match_profiles", "profiles"), ("match_vectors", "vectors")):
    query(f"{oracle.matched(_fixture)} SELECT {_MATCH} FROM m", _name)(_matches(_fixture))


@query(f"{oracle.matched('profiles' + oracle.BY_CORRELATION)} SELECT {_MATCH} FROM m")
def match_mahalanobis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order profiles to line profiles by Mahalanobis' distance."""
    return _rounded(linkage(spark, sf_dir, "profiles", "mahalanobis").matches)


@query(f"{oracle.judged('accounts' + oracle.BY_CORRELATION)} SELECT target_idx, round(best_distance, 6) AS best_distance, round(c0, 6) AS share_balance, round(c1, 6) AS share_nation, flags FROM j")
def flags_mahalanobis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers to suppliers by Mahalanobis' distance, some cells missing: shares of what each feature adds, and flags."""
    found = linkage(spark, sf_dir, "accounts", "mahalanobis").per_target
    return found.select("target_idx", six("best_distance"), six(F.col("contributions")[0], "share_balance"), six(F.col("contributions")[1], "share_nation"), "flags")


@query(oracle.base("overlap") + ", k AS (SELECT ti, si, d, row_number() OVER (PARTITION BY ti ORDER BY d, si) AS rank FROM p WHERE d IS NOT NULL) SELECT ti AS target_idx, rank, si AS supp_idx, round(d, 6) AS distance FROM k WHERE rank <= 5")
def top_k_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest rows of each target, with ids."""
    return linkage(spark, sf_dir, "overlap").matcher.candidates(5).select("target_idx", "rank", "supp_idx", six("distance"))


@query(oracle.base("accounts") + ", k AS (SELECT ti, d, row_number() OVER (PARTITION BY ti ORDER BY d, si) AS r FROM p WHERE d IS NOT NULL) SELECT ti AS target_idx, r AS rank, round(d, 6) AS distance FROM k WHERE r <= 50")
def top_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty least distances of each target, one by one; a target without any has no row."""
    lists = linkage(spark, sf_dir, "accounts").matcher.top_distances(50)
    each = lists.select("target_idx", F.posexplode("top_k_distances").alias("place", "d"))
    return each.select("target_idx", (F.col("place") + 1).cast("long").alias("rank"), six("d", "distance"))


@query(
    oracle.base("accounts")
    + ", x AS (SELECT ti, min(d) AS lo0, max(d) AS hi0 FROM p GROUP BY ti), e AS (SELECT ti, CASE WHEN lo0 = hi0 THEN lo0 - 0.5e0 ELSE lo0 END AS lo, CASE WHEN lo0 = hi0 THEN hi0 + 0.5e0 ELSE hi0 END AS hi FROM x WHERE lo0 IS NOT NULL), "
    "i AS (SELECT p.ti, d, lo, hi, least(CAST(floor((d - lo) / (hi - lo) * 30) AS INTEGER), 29) AS i FROM p JOIN e ON p.ti = e.ti WHERE d IS NOT NULL), "
    "c AS (SELECT ti, CASE WHEN d < lo + i * ((hi - lo) / 30) THEN i - 1 WHEN i <> 29 AND d >= lo + (i + 1) * ((hi - lo) / 30) THEN i + 1 ELSE i END AS bin FROM i), "
    "n AS (SELECT ti, bin, count(*) AS n FROM c GROUP BY ti, bin) SELECT e.ti AS target_idx, r.bin AS bin, coalesce(n.n, 0) AS count, round(lo + r.bin * ((hi - lo) / 30), 6) AS low FROM e CROSS JOIN (SELECT CAST(range AS BIGINT) AS bin FROM range(30)) AS r LEFT JOIN n ON n.ti = e.ti AND n.bin = r.bin"
)
def distance_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty equal bins of each target's distances."""
    return linkage(spark, sf_dir, "accounts").matcher.histograms(30).select("target_idx", "bin", "count", six("low"))


# Signals and assembly ------------------------------------------------------------------------


@query(oracle.judged("accounts") + " SELECT target_idx, 'balance' AS feature, round(c0, 6) AS share FROM h UNION ALL SELECT target_idx, 'nation', round(c1, 6) FROM h")
def feature_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each feature's share of the squared distance to the match."""
    x = linkage(spark, sf_dir, "accounts")
    shares = F.arrays_zip(F.array(*(F.lit(n) for n in x.names)).alias("feature"), F.col("contributions").alias("share"))
    return x.per_target.select("target_idx", F.explode(shares).alias("x")).select("target_idx", F.col("x.feature").alias("feature"), six(F.col("x.share"), "share"))


_SMD_FLAG = "CASE WHEN smd > 0.25e0 THEN 'poor' WHEN smd > 0.10e0 THEN 'warning' ELSE 'ok' END AS flag"


def _balance(fixture: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return linkage(spark, sf_dir, fixture).feature_smd().select("feature", six("smd"), "flag")

    return run


for _name, _fixture in (("dataset_smd", "accounts"), ("feature_smd", "profiles")):
    query(f"{oracle.judged(_fixture)} SELECT feature, round(smd, 6) AS smd, {_SMD_FLAG} FROM g", _name)(_balance(_fixture))


def _flags(fixture: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return linkage(spark, sf_dir, fixture).per_target.select("target_idx", "target_missing", "match_missing", "flags")

    return run


for _name, _fixture in (("flags", "accounts"), ("flags_ties", "nations"), ("flags_profiles", "profiles")):
    query(f"{oracle.judged(_fixture)} SELECT target_idx, target_missing, match_missing, flags FROM j", _name)(_flags(_fixture))


@query(
    oracle.judged("accounts")
    + " SELECT j.target_idx AS target_index, c.c_mktsegment, c.c_name, t.f0 AS c_acctbal, t.f1 AS c_nationkey, x.s_name, round(best_distance, 6) AS euc_distance, repeats, CASE WHEN NOT no_match THEN round(nndr, 4) END AS nndr, near_miss AS near_miss_count, CAST(mnn_confirmed AS INTEGER) AS mnn_confirmed, flags "
    "FROM j JOIN customer AS c ON c.c_custkey = j.target_idx JOIN t ON t.idx = j.target_idx LEFT JOIN supplier AS x ON x.s_suppkey = j.match_idx"
)
def linked_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The linked table: target columns, the match's other columns, and its figures."""
    table = linkage(spark, sf_dir, "accounts").linked()
    return table.withColumn("euc_distance", F.round("euc_distance", 6))


@query(
    oracle.judged("accounts")
    + " SELECT target_idx AS target_index, round(best_distance, 6) AS euc_distance, CASE WHEN NOT no_match THEN round(nndr, 4) END AS nndr, near_miss AS near_miss_count, CAST(mnn_confirmed AS INTEGER) AS mnn_confirmed, target_missing, match_missing, "
    "CASE WHEN NOT no_match THEN round(c0, 6) END AS contrib_balance, CASE WHEN NOT no_match THEN round(c1, 6) END AS contrib_nation, flags FROM j"
)
def detail_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detail table of the same linkage."""
    return linkage(spark, sf_dir, "accounts").detail().withColumn("euc_distance", F.round("euc_distance", 6))


@query(
    oracle.judged("accounts")
    + ", y AS (SELECT j.target_idx, t.f0 AS a0, t.f1 AS a1, s.f0 AS b0, s.f1 AS b1 FROM j JOIN t ON t.idx = j.target_idx LEFT JOIN s ON s.idx = j.match_idx) "
    "SELECT target_idx, 'balance' AS feature, coalesce(CAST(CAST(a0 AS DECIMAL(18, 2)) AS VARCHAR), '') AS target_raw, coalesce(CAST(CAST(b0 AS DECIMAL(18, 2)) AS VARCHAR), '') AS match_raw FROM y "
    "UNION ALL SELECT target_idx, 'nation', coalesce(CAST(CAST(a1 AS DECIMAL(18, 2)) AS VARCHAR), ''), coalesce(CAST(CAST(b1 AS DECIMAL(18, 2)) AS VARCHAR), '') FROM y"
)
def raw_feature_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw cells of target and match side by side, to two places."""

    def two(c: str) -> Column:
        return F.coalesce(F.when(F.col(c) != "", F.col(c)).cast("decimal(18,2)").cast("string"), F.lit("")).alias(c)

    return linkage(spark, sf_dir, "accounts").raw_pairs().select("target_idx", "feature", two("target_raw"), two("match_raw"))


# Statistics ----------------------------------------------------------------------------------


@query(
    f"WITH cells AS ({_CELLS_SQL}), v AS (SELECT {_MISSING} AS missing, CASE WHEN NOT {_MISSING} THEN TRY_CAST(nullif(regexp_extract({_BARE}, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?', 0), '') AS DOUBLE) END AS x FROM cells) "
    "SELECT 'target' AS dataset, 'cell' AS \"column\", count(*) FILTER (NOT missing) AS count_nonmissing, count(*) FILTER (missing) AS missing, round(avg(x), 6) AS mean, round(CASE WHEN count(x) = 1 THEN 0 ELSE stddev_samp(x) END, 6) AS std, min(x) AS min, max(x) AS max FROM v "
    "UNION ALL SELECT 'supplemental', 's_acctbal', count(s_acctbal), count(*) - count(s_acctbal), round(avg(s_acctbal), 6), round(stddev_samp(s_acctbal), 6), min(s_acctbal), max(s_acctbal) FROM supplier"
)
def data_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column statistics of raw cells and of a plain number column."""
    both = diagnostics.data_stats(_cells(spark, sf_dir), "target", ["cell"]).unionByName(diagnostics.data_stats(read(spark, sf_dir, "supplier"), "supplemental", ["s_acctbal"]))
    return both.withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


# Names of the figures, which results are read by.
_METRICS = {
    "total_rows": "count(*)", "no_match_count": "count(*) FILTER (no_match)", "flagged_count": "count(*) FILTER (flags <> '')", "flagged_pct": "100e0 * count(*) FILTER (flags <> '') / count(*)",
    "mnn_confirmed_count": "count(*) FILTER (mnn_confirmed)", "mnn_confirmed_pct": "100e0 * count(*) FILTER (mnn_confirmed) / count(*)", "rows_with_near_miss": "count(*) FILTER (near_miss > 0)",
    "rows_with_near_miss_pct": "100e0 * count(*) FILTER (near_miss > 0) / count(*)", "rows_with_ties": "count(*) FILTER (repeats > 1)", "rows_with_ties_pct": "100e0 * count(*) FILTER (repeats > 1) / count(*)", "threshold_nndr": "max(0.8e0)",
    "mean_best_distance": "avg(best_distance)", "median_best_distance": "quantile_cont(best_distance, 0.5)", "p25_best_distance": "quantile_cont(best_distance, 0.25)", "p75_best_distance": "quantile_cont(best_distance, 0.75)",
    "min_best_distance": "min(best_distance)", "max_best_distance": "max(best_distance)", "mean_nndr": "avg(nndr) FILTER (NOT no_match)", "median_nndr": "quantile_cont(nndr, 0.5) FILTER (NOT no_match)",
}


@query(oracle.judged("accounts") + " " + " UNION ALL ".join(f"SELECT '{k}' AS metric, round(coalesce(CAST({v} AS DOUBLE), 0e0), 5) AS value FROM j" for k, v in _METRICS.items()))
def match_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nineteen figures of a finished linkage."""
    return linkage(spark, sf_dir, "accounts").match_stats().withColumn("value", F.round("value", 5))


@query(oracle.judged("overlap") + " SELECT count(*) AS total, count(*) FILTER (flags <> '') AS flagged, count(*) FILTER (mnn_confirmed) AS mnn_confirmed, count(*) FILTER (no_match) AS no_match, round(coalesce(avg(nndr) FILTER (NOT no_match), 0), 6) AS mean_nndr, round(coalesce(avg(best_distance), 0), 6) AS mean_best_distance, 0.8e0 AS threshold FROM j")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one-row summary of a linkage."""
    return linkage(spark, sf_dir, "overlap").summary().withColumns({"mean_nndr": F.round("mean_nndr", 6), "mean_best_distance": F.round("mean_best_distance", 6)})


@query(oracle.judged("accounts") + " SELECT target_idx, round(best_distance, 6) AS best_distance, round(nndr, 6) AS nndr, near_miss FROM j ORDER BY CASE WHEN no_match THEN 1 ELSE 0 END, j.nndr, target_idx LIMIT 10 OFFSET 20")
def sorted_results_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of results by ratio."""
    page = diagnostics.results_page(linkage(spark, sf_dir, "accounts").per_target, "nndr", page=2, size=10)
    return page.select("target_idx", six("best_distance"), six("nndr"), "near_miss")


# Uniqueness and accuracy ---------------------------------------------------------------------

_HALVES = "WITH t AS (SELECT * FROM part WHERE p_partkey < (SELECT count(*) // 2 FROM part)), s AS (SELECT * FROM part WHERE p_partkey >= (SELECT count(*) // 2 FROM part))"
_VARIABLES = ["p_size", "p_brand", "p_type"]


def _halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    table = read(spark, sf_dir, "part")
    half = table.agg(F.count(F.lit(1))).first()[0] // 2
    return table.filter(F.col("p_partkey") < half), table.filter(F.col("p_partkey") >= half)


def _gradient_sql(k: int) -> str:
    keys = _VARIABLES[:k]
    on = " AND ".join(f"t.{v} = c.{v}" for v in keys)
    return (
        f"SELECT {k} AS k_variables, '{' + '.join(keys)}' AS variables, round(avg(n), 6) AS mean_candidates, quantile_cont(n, 0.5) AS median_candidates, max(n) AS max_candidates, round(100e0 * count(*) FILTER (n = 1) / count(*), 6) AS pct_unique, "
        f"round(100e0 * count(*) FILTER (n > 1) / count(*), 6) AS pct_ambiguous FROM (SELECT coalesce(c.n, 0) AS n FROM t LEFT JOIN (SELECT {', '.join(keys)}, count(*) AS n FROM s GROUP BY {', '.join(keys)}) AS c ON {on}) AS x"
    )


@query(_HALVES + " " + " UNION ALL ".join(_gradient_sql(k) for k in (1, 2, 3)))
def candidate_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows of one half of the parts agree with those of the other on one, two and three variables."""
    found = candidates.candidate_gradient(*_halves(spark, sf_dir), "p_partkey", _VARIABLES)
    return found.withColumns({c: F.round(c, 6) for c in ("mean_candidates", "pct_unique", "pct_ambiguous")})


def _detail_sql(k: int) -> str:
    on = " AND ".join(f"t.{v} = s.{v}" for v in _VARIABLES[:k])
    return f"SELECT t.p_partkey, {k} AS k_variables, count(*) AS n_matching, string_agg(CAST(s.p_partkey AS VARCHAR), ';' ORDER BY CAST(s.p_partkey AS VARCHAR)) AS matching_ids FROM t JOIN s ON {on} GROUP BY t.p_partkey"


@query(f"{_HALVES} {_detail_sql(2)} UNION ALL {_detail_sql(3)}")
def duplicate_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which parts agree on two and on three variables."""
    return candidates.duplicate_detail(*_halves(spark, sf_dir), "p_partkey", "p_partkey", _VARIABLES, [2, 3])


@query(
    oracle.judged("overlap")
    + " SELECT c_mktsegment AS scenario, count(*) AS n, count(*) FILTER (x.truth IS NOT NULL AND coalesce(x.truth = j.match_idx, false)) AS correct, count(*) FILTER (flags <> '') AS flagged, count(*) FILTER (NOT coalesce(x.truth = j.match_idx, false) AND flags <> '') AS wrong_flagged, count(*) FILTER (no_match) AS no_match "
    "FROM j JOIN customer ON c_custkey = j.target_idx LEFT JOIN (SELECT idx AS truth FROM s) AS x ON x.truth = j.target_idx GROUP BY c_mktsegment"
)
def scenario_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches against the truth, by market segment: a customer in both tables should find itself."""
    return candidates.scenario_accuracy(_scenarios(spark, sf_dir))


@query(
    oracle.matched("overlap")
    + " SELECT c_mktsegment AS scenario, count(*) AS n, round(100e0 * count(*) FILTER (best_distance = 0) / count(*), 6) AS pct_exact, round(100e0 * count(*) FILTER (best_distance > 0) / count(*), 6) AS pct_fuzzy, "
    "round(100e0 * count(*) FILTER (match_idx = target_idx) / count(*), 6) AS pct_correct_top1 FROM m JOIN customer ON c_custkey = target_idx GROUP BY c_mktsegment"
)
def scenario_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of exact, fuzzy and right matches, by market segment."""
    found = candidates.scenario_summary(_scenarios(spark, sf_dir))
    return found.withColumns({c: F.round(c, 6) for c in ("pct_exact", "pct_fuzzy", "pct_correct_top1")})


def _scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of customers linked to themselves, with their truth."""
    x = linkage(spark, sf_dir, "overlap")
    truth = x.supplemental.select(F.col("c_custkey").alias("truth"))
    segments = x.target.select(F.col("c_custkey").alias("target_idx"), F.col("c_mktsegment").alias("scenario"))
    return x.per_target.join(truth, F.col("target_idx") == F.col("truth"), "left").join(segments, "target_idx").withColumnRenamed("match_idx", "matched")


def _stability_sql(name: str) -> str:
    x, y = (f"({oracle.matched(fixture)} SELECT target_idx, match_idx FROM m)" for fixture in ("overlap", f"overlap without {name}"))
    return f"SELECT '{name}' AS left_out, count(*) AS n, count(*) FILTER (x.match_idx IS NOT DISTINCT FROM y.match_idx) AS same FROM {x} AS x JOIN {y} AS y ON x.target_idx = y.target_idx"


@query(" UNION ALL ".join(_stability_sql(name) for name in oracle.names("overlap")))
def match_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many customers keep their match if one feature is left out."""
    return linkage(spark, sf_dir, "overlap").stability()


@query(" UNION ALL ".join(f"SELECT * FROM ({oracle.matched(f'noise {level}')} SELECT {level}e0 AS level, count(*) AS n, count(*) FILTER (target_idx = match_idx) AS correct FROM m)" for level in oracle.LEVELS))
def perturbed_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with noise linked back to suppliers: the share that finds itself, by level of noise."""
    table = read(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").cast("double").alias("s_acctbal"), F.col("s_nationkey").cast("double").alias("s_nationkey"))
    features = [("balance", "s_acctbal", "s_acctbal"), ("nation", "s_nationkey", "s_nationkey")]
    out = None
    for level in oracle.LEVELS:
        noisy = candidates.perturbed(table, ["s_acctbal", "s_nationkey"], level, key="s_suppkey")
        found = fixtures.Linkage(noisy, table, features, "s_suppkey", "s_suppkey").matches
        row = found.agg(F.lit(level).alias("level"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("target_idx") == F.col("match_idx")).alias("correct"))
        out = row if out is None else out.unionByName(row)
    return out


@query(
    oracle.base("accounts")
    + ", k AS (SELECT ti, d, row_number() OVER (PARTITION BY ti ORDER BY d, si) AS r FROM p WHERE d IS NOT NULL), x AS (SELECT ti, min(CASE WHEN r = 1 THEN d END) AS d1, min(CASE WHEN r = 2 THEN d END) AS d2 FROM k GROUP BY ti), "
    "y AS (SELECT k.ti, count(CASE WHEN r > 1 AND (CASE WHEN d1 = 0 THEN d = 0 ELSE d1 / nullif(d, 0e0) >= 0.8e0 END) THEN 1 END) AS n FROM k JOIN x ON x.ti = k.ti WHERE r <= 50 GROUP BY k.ti) "
    "SELECT idx AS target_idx, round(CASE WHEN d2 IS NULL THEN 0e0 WHEN d1 = 0 THEN CASE WHEN d2 = 0 THEN 1e0 ELSE 0e0 END ELSE d1 / nullif(d2, 0e0) END, 6) AS nndr, coalesce(n, 0) AS near_misses FROM t LEFT JOIN x ON x.ti = idx LEFT JOIN y ON y.ti = idx"
)
def cascading_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratio and near misses of the lists of the fifty least distances."""
    lists = linkage(spark, sf_dir, "accounts").matcher.top_distances(50)
    found = lists.select("target_idx", signals.cascading_ratio(F.col("top_k_distances")).alias("x"))
    return found.select("target_idx", six(F.col("x.nndr"), "nndr"), F.col("x.near_misses").alias("near_misses"))


@query(oracle.base("accounts") + ", k AS (SELECT ti, si, d, row_number() OVER (PARTITION BY ti ORDER BY d, si) AS rank FROM p WHERE d IS NOT NULL), y AS (SELECT k.*, a.z0 AS a0, a.z1 AS a1, c.z0 AS c0, c.z1 AS c1 FROM k JOIN tz AS a ON a.idx = ti JOIN sz AS c ON c.idx = si WHERE rank <= 3) SELECT ti AS target_idx, rank, si AS supp_idx, 'balance' AS feature, round(coalesce((a0 - c0) * (a0 - c0), 2e0), 6) AS term FROM y UNION ALL SELECT ti, rank, si, 'nation', round(coalesce((a1 - c1) * (a1 - c1), 2e0), 6) FROM y")
def explained_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three nearest rows of each target, feature by feature."""
    return linkage(spark, sf_dir, "accounts").explained(3).select("target_idx", "rank", "supp_idx", "feature", six("term"))


_SCENARIO_TERM = "struct_pack(feature := '{name}', target := CAST(a{k} AS DECIMAL(20, 6)), \"row\" := CAST(c{k} AS DECIMAL(20, 6)), term := CAST(coalesce((a{k} - c{k}) * (a{k} - c{k}), 2e0) AS DECIMAL(20, 6)))"
_SCENARIO_TERMS = ", ".join(_SCENARIO_TERM.format(name=name, k=k) for k, name in enumerate(oracle.names("accounts")))


@query(
    oracle.matched("accounts")
    + ", k AS (SELECT ti, si, d, row_number() OVER (PARTITION BY ti ORDER BY d, si) AS rank FROM p WHERE d IS NOT NULL), "
    "y AS (SELECT k.*, a.z0 AS a0, a.z1 AS a1, c.z0 AS c0, c.z1 AS c1 FROM k JOIN tz AS a ON a.idx = ti JOIN sz AS c ON c.idx = si WHERE rank <= 3), "
    f"l AS (SELECT ti, list(struct_pack(rank := rank, \"row\" := si, distance := CAST(d AS DECIMAL(20, 6)), terms := [{_SCENARIO_TERMS}]) ORDER BY rank) AS candidates FROM y GROUP BY ti) "
    "SELECT target_idx, CAST(to_json(struct_pack(target := target_idx, no_match := no_match, near_miss := near_miss, mnn_confirmed := mnn_confirmed, candidates := coalesce(candidates, []))) AS VARCHAR) AS scenario FROM m LEFT JOIN l ON ti = target_idx"
)
def scenario_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each target with its three nearest rows, as JSON."""
    return linkage(spark, sf_dir, "accounts").scenarios(3)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
