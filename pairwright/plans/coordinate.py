"""Linkages of files, of pasted text and of DataFrames, and the results package."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.texts import number_text
from ..operators import diagnostics
from ..operators.linking import ColumnLink, common_links, personal_headers, validated
from ..sources.shared import copy
from ..sources.tables import INDEX, RawTable, load_csv, parse_csv_text, write_csv
from .linkage import Linkage

README = """Results of a linkage

linked_dataset               target rows with the columns and figures of their matches
results/match_detail         figures of each match: distance, ratio, mutual confirmation, shares, flags
diagnostics/data_stats       statistics of the columns of both inputs
diagnostics/match_stats      figures of the whole linkage
diagnostics/feature_smd      standardized mean difference of each feature, and whether it is balanced
inputs/target, inputs/supplemental   the inputs as they were read
"""


def link_tables(target: RawTable, supplemental: RawTable, links: Sequence[ColumnLink] | None = None, exclude: Iterable[str] = (), threshold: float = 0.8, labels: tuple[str, str] = ("target", "supplemental"), fast: bool | None = None) -> Linkage:
    """A linkage of two raw tables: shared headers, or explicit links (then ``exclude`` is not used)."""
    chosen = validated(links) if links is not None else common_links(target.headers, supplemental.headers, exclude)
    if not chosen:
        raise ValueError("No shared columns to match on.")
    if target.rows.isEmpty():
        raise ValueError(f"{labels[0]}: target dataset has no rows.")
    if supplemental.rows.isEmpty():
        raise ValueError(f"{labels[1]}: supplemental dataset has no rows.")
    left, right = target.named(), supplemental.named()
    features = [(x.name, left.columns[x.target + 1], right.columns[x.supplemental + 1]) for x in chosen]
    return Linkage(left, right, features, INDEX, INDEX, threshold, fast).check_cells(*labels)


def coordinate_text(spark: SparkSession, target: str, supplemental: str, links: Sequence[ColumnLink] | None = None, exclude: Iterable[str] = (), threshold: float = 0.8) -> Linkage:
    """A linkage of two tables given as CSV text."""
    return link_tables(parse_csv_text(spark, target, "target"), parse_csv_text(spark, supplemental, "supplemental"), links, exclude, threshold)


def coordinator(spark: SparkSession, target: str, supplemental: str, output: str, exclude: Iterable[str] = (), threshold: float = 0.8, fast: bool | None = None) -> list[str]:
    """Link two CSV files; writes the linked table to ``output`` and the detail beside it, and gives the warnings.

    ``fast``: by matrix products; by default where that pays.  Results are the same either way.
    """
    found = link_tables(load_csv(spark, target), load_csv(spark, supplemental), None, exclude, threshold, (target, supplemental), fast)
    base = output.removesuffix(".csv")
    write_csv(found.linked(), output, [f"{INDEX}", "target_index"])
    write_csv(found.detail(), f"{base}_detail.csv")
    return found.warnings


def coordinate(target: DataFrame, supplemental: DataFrame, features: Sequence[tuple[str, str, str]], target_index: str, supplemental_index: str, threshold: float = 0.8, fast: bool | None = None, metric: str = "euclidean") -> Linkage:
    """A linkage of two DataFrames, such as Parquet tables, by features (name, target column, supplemental column).

    ``fast``: by matrix products; by default where that pays.  Results are the same either way.
    """
    return Linkage(target, supplemental, features, target_index, supplemental_index, threshold, fast, metric)


def results(found: Linkage) -> dict:
    """A finished linkage by name: short lists and the summary as values, tables as DataFrames, rows of the first two as text."""

    def text(table: DataFrame) -> DataFrame:
        return table.select(*(F.coalesce(number_text(F.col(f"`{c}`")) if kind in ("double", "float") else F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c, kind in table.dtypes))

    linked, detail = text(found.linked()), text(found.detail())
    return {
        "feature_names": list(found.names), "smd": list(found.smd), "threshold": found.threshold, "warnings": found.warnings, "linked_headers": linked.columns, "linked_rows": linked,
        "detail_headers": detail.columns, "detail_rows": detail, "per_target": found.per_target, "summary": found.summary().first().asDict(),
    }


def personal_data_warnings(target: RawTable, supplemental: RawTable) -> list[tuple[str, str, str]]:
    return personal_headers(target.headers, "target") + personal_headers(supplemental.headers, "supplemental")


def write_package(found: Linkage, folder: str, inputs: Sequence[str] = ()) -> None:
    """All tables of a finished linkage below one folder, each as CSV.

    ``inputs``, the paths of the target's and the supplemental's file, are copied byte for byte; without them
    the tables are written anew.
    """
    spark = found.target.sparkSession
    write_csv(found.linked(), f"{folder}/linked_dataset", ["target_index"])
    write_csv(found.detail(), f"{folder}/results/match_detail")
    sides = ((found.target, "target", found.target_index), (found.supplemental, "supplemental", found.supplemental_index))
    stats = [diagnostics.data_stats(table, name, [c for c in table.columns if c != index]) for table, name, index in sides]
    write_csv(stats[0].unionByName(stats[1]), f"{folder}/diagnostics/data_stats")
    write_csv(found.match_stats(), f"{folder}/diagnostics/match_stats")
    write_csv(found.feature_smd(), f"{folder}/diagnostics/feature_smd")
    for table, name, index in [] if inputs else sides:
        write_csv(table, f"{folder}/inputs/{name}", [index])
    for path in inputs:
        copy(spark, path, f"{folder}/inputs/{path.rsplit('/', 1)[-1]}")
    spark.createDataFrame([(README,)], "value string").write.mode("overwrite").text(f"{folder}/readme")
