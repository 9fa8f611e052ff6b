"""Statistics of the input columns and of a finished linkage, and the sorted page of its rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import cleaning
from .quantiles import exact_quantiles


def data_stats(table: DataFrame, dataset: str, columns: Sequence[str] | None = None) -> DataFrame:
    """(dataset, column, count_nonmissing, missing, mean, std, min, max) of raw columns.

    ``count_nonmissing`` has text too; the figures are of cells that begin with a number, the
    deviation is the sample's (0 for one cell), all null without such a cell.  One aggregate
    over the table, without a shuffle of its rows.
    """
    columns = list(columns or table.columns)
    figures = []
    for k, c in enumerate(columns):
        cell = F.col(f"`{c}`")
        value = cleaning.numeric_prefix(cell)
        missing = F.count_if(cleaning.is_missing(cell))
        figures += [
            F.struct(
                F.lit(c).alias("column"), (F.count(F.lit(1)) - missing).alias("count_nonmissing"), missing.alias("missing"), F.avg(value).alias("mean"),
                F.when(F.count(value) == 1, 0.0).otherwise(F.stddev_samp(value)).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"),
            ).alias(f"c{k}")
        ]
    row = table.agg(*figures)
    return row.select(F.explode(F.array(*(f"c{k}" for k in range(len(columns))))).alias("x")).select(F.lit(dataset).alias("dataset"), "x.*")


def run_summary(per_target: DataFrame, threshold: float) -> DataFrame:
    """One row: total, flagged, mnn_confirmed, no_match, mean_nndr, mean_best_distance, threshold."""
    matched = ~F.col("no_match")
    return per_target.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("flags") != "").alias("flagged"),
        F.count_if("mnn_confirmed").alias("mnn_confirmed"),
        F.count_if("no_match").alias("no_match"),
        F.coalesce(F.avg(F.when(matched, F.col("nndr"))), F.lit(0.0)).alias("mean_nndr"),
        F.coalesce(F.avg(F.when(matched, F.col("best_distance"))), F.lit(0.0)).alias("mean_best_distance"),
        F.lit(threshold).alias("threshold"),
    )


def match_stats(per_target: DataFrame, threshold: float) -> DataFrame:
    """(metric, value): counts, shares in percent, and spread of distances and ratios of matched rows.

    Quantiles are exact and come from passes of their own, so the table should be a written one.
    """
    matched = ~F.col("no_match")
    distance, ratio = F.when(matched, F.col("best_distance")), F.when(matched, F.col("nndr"))
    n = F.count(F.lit(1))

    def share(count):
        return F.coalesce(F.lit(100.0) * count / F.nullif(n, F.lit(0)), F.lit(0.0))

    flagged, mutual = F.count_if(F.col("flags") != ""), F.count_if("mnn_confirmed")
    near, tied = F.count_if(F.col("near_miss") > 0), F.count_if(F.col("repeats") > 1)
    quantiles = exact_quantiles(per_target, {"median_best_distance": (distance, 0.5), "p25_best_distance": (distance, 0.25), "p75_best_distance": (distance, 0.75), "median_nndr": (ratio, 0.5)})
    spread = {k: F.lit(v).cast("double") for k, v in quantiles.items()}
    figures = {
        "total_rows": n, "no_match_count": F.count_if("no_match"), "flagged_count": flagged, "flagged_pct": share(flagged), "mnn_confirmed_count": mutual, "mnn_confirmed_pct": share(mutual),
        "rows_with_near_miss": near, "rows_with_near_miss_pct": share(near), "rows_with_ties": tied, "rows_with_ties_pct": share(tied), "threshold_nndr": F.lit(threshold),
        "mean_best_distance": F.avg(distance), **{k: spread[k] for k in ("median_best_distance", "p25_best_distance", "p75_best_distance")},
        "min_best_distance": F.min(distance), "max_best_distance": F.max(distance), "mean_nndr": F.avg(ratio), "median_nndr": spread["median_nndr"],
    }
    row = per_target.agg(*(F.coalesce(v.cast("double"), F.lit(0.0)).alias(k) for k, v in figures.items()))
    return row.unpivot([], list(figures), "metric", "value")


#: Columns that a result page can be sorted by.
SORTABLE = ("target_idx", "best_distance", "nndr", "near_miss", "flags")


def results_page(per_target: DataFrame, by: str = "target_idx", descending: bool = False, page: int = 0, size: int = 10) -> DataFrame:
    """A page of results; missing values count as the greatest, ``flags`` puts flagged rows first, ties keep their order."""
    if by not in SORTABLE:
        raise ValueError(f"cannot sort by {by}")
    key = (F.col("flags") == "").cast("int") if by == "flags" else F.when(~F.col("no_match") | (F.lit(by) == "target_idx"), F.col(by)) if by in ("nndr", "best_distance") else F.col(by)
    order = key.desc_nulls_first() if descending else key.asc_nulls_last()
    return per_target.orderBy(order, "target_idx").offset(page * size).limit(size)
