"""A whole linkage of two tables: clean, standardize, match, judge, assemble."""

from __future__ import annotations

import logging
from collections.abc import Sequence
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cleaning, signals
from ..operators import diagnostics, standardize
from ..operators.linking import ColumnLink, validated
from ..operators.match import Matcher, checked_threshold
from ..sources.shared import Kept

log = logging.getLogger("pairwright")


class Linkage:
    """Links of a target table to a supplemental table.

    ``target`` and ``supplemental`` have an index column (the row's place; ties go to the lesser)
    and any other columns.  Each feature is a name with a column of either side; text columns are
    cleaned as cells of raw tables, numbers are taken as they are.  Nothing but a few numbers a
    feature comes to the driver.  ``metric`` ``mahalanobis`` takes the features' correlations into account:
    scores, shares and balance are then those of what each feature tells beyond the ones before it.
    """

    def __init__(
        self,
        target: DataFrame,
        supplemental: DataFrame,
        features: Sequence[tuple[str, str, str]],
        target_index: str,
        supplemental_index: str,
        threshold: float = 0.8,
        fast: bool | None = None,
        metric: str = "euclidean",
    ) -> None:
        self.threshold = checked_threshold(threshold)
        if metric not in ("euclidean", "mahalanobis"):
            raise ValueError(f"there is no metric {metric}")
        if not features:
            raise ValueError("No shared columns to match on.")
        self.metric = metric
        self.kept = Kept()
        self.fast = fast
        self.names = [f[0] for f in features]
        self.cells = [f"f{k}" for k in range(len(features))]
        self.target, self.supplemental = target, supplemental
        self.target_index, self.supplemental_index = target_index, supplemental_index
        self.links = list(features)
        # One aggregate over both tables: rows, means and deviations.
        self.target_cells, self.supplemental_cells = self._cells(1), self._cells(2)
        self.figures = standardize.pooled_figures(self.target_cells.select("cells"), self.supplemental_cells.select("cells"), len(features))
        if not self.figures.n_target:
            raise ValueError("target dataset has no rows.")
        if not self.figures.n_supplemental:
            raise ValueError("supplemental dataset has no rows.")

    def _side(self, side: int) -> tuple[DataFrame, Column, list[Column]]:
        """A table, its index and its features' values; ``side`` is the place of its column in a link."""
        table, index, name = (self.target, self.target_index, "target_idx") if side == 1 else (self.supplemental, self.supplemental_index, "supp_idx")
        kinds = dict(table.dtypes)  # asked for once, as each question goes to the planner

        def value(column: str) -> Column:
            return cleaning.clean_value(F.col(f"`{column}`")) if kinds[column] == "string" else cleaning.number_or_null(F.col(f"`{column}`"))

        return table, F.col(f"`{index}`").cast("long").alias(name), [value(link[side]) for link in self.links]

    def _cells(self, side: int) -> DataFrame:
        """(index, cells): the features as one array, so that plans of wide tables stay small."""
        table, index, values = self._side(side)
        return table.select(index, F.array(*(v.cast("double") for v in values)).alias("cells"))

    def _features(self, side: int) -> DataFrame:
        table, index, values = self._side(side)
        return table.select(index, *(v.alias(cell) for v, cell in zip(values, self.cells, strict=True)))

    @cached_property
    def target_features(self) -> DataFrame:
        return self._features(1)

    @cached_property
    def supplemental_features(self) -> DataFrame:
        return self._features(2)

    def forget(self) -> None:
        """Remove what the linkage has written to the shared folder; its results end with it."""
        self.kept.forget()

    def __enter__(self) -> Linkage:
        return self

    def __exit__(self, *_) -> None:
        self.forget()

    def check_cells(self, target_label: str = "target", supplemental_label: str = "supplemental") -> Linkage:
        """Raise on the first cell (by row, then feature) that is neither missing nor a number."""
        for table, index, side, label in ((self.target, self.target_index, 1, target_label), (self.supplemental, self.supplemental_index, 2, supplemental_label)):
            found = []
            for k, link in enumerate(self.links):
                column = link[side]
                if table.schema[column].dataType.simpleString() == "string":
                    raw = F.col(f"`{column}`")
                    found.append(F.when(cleaning.is_invalid(raw), F.struct(F.col(f"`{index}`").cast("long").alias("row"), F.lit(k).alias("place"), raw.alias("raw"))))
            if found:
                first = table.agg(F.min(F.least(*found) if len(found) > 1 else found[0]).alias("first")).first()["first"]
                if first is not None:
                    raise ValueError(f"{label}: line {first['row'] + 2}, column '{self.names[first['place']]}': cannot parse '{first['raw']}' as a number")
        return self

    @cached_property
    def warnings(self) -> list[str]:
        """Scale warnings, with the features' own names."""
        found = standardize.scale_warnings(self.target_features, self.supplemental_features, self.cells)
        found = [w.replace(f"'{c}'", f"'{n}'") for w in found for c, n in zip(self.cells, self.names, strict=True) if f"'{c}'" in w]
        for w in found:
            log.warning(w)
        return found

    @property
    def scales(self) -> list[standardize.Scale]:
        return self.figures.scales

    @cached_property
    def whitener(self) -> standardize.Whitener | None:
        if self.metric == "euclidean":
            return None
        return standardize.Whitener(standardize.positive_definite(standardize.pooled_covariance(self.target_cells, self.supplemental_cells, self.scales)))

    @cached_property
    def target_z(self) -> DataFrame:
        if self.whitener:
            return standardize.whitened(self.target_cells, "target_idx", self.scales, self.whitener, self.cells)
        return standardize.standardized(self.target_features, self.cells, self.scales)

    @cached_property
    def supplemental_z(self) -> DataFrame:
        if self.whitener:
            return standardize.whitened(self.supplemental_cells, "supp_idx", self.scales, self.whitener, self.cells)
        return standardize.standardized(self.supplemental_features, self.cells, self.scales)

    @cached_property
    def matcher(self) -> Matcher:
        figures = self.figures
        return Matcher(
            self.target_cells, "target_idx", self.supplemental_cells, "supp_idx", "cells", self.threshold, scales=[(s.mean, s.deviation) for s in figures.scales], counts=(figures.n_target, figures.n_supplemental),
            fast=self.fast, kept=self.kept, turn=self.whitener,
        )

    @cached_property
    def matches(self) -> DataFrame:
        return self.kept(self.matcher.matches())

    @cached_property
    def pairs(self) -> DataFrame:
        """Matches with the standardized features of both rows: t_f0..., m_f0...; nulls where there is no match."""
        left = self.target_z.select("target_idx", *(F.col(c).alias(f"t_{c}") for c in self.cells))
        right = self.supplemental_z.select(F.col("supp_idx").alias("match_idx"), *(F.col(c).alias(f"m_{c}") for c in self.cells))
        return self.matches.join(left, "target_idx").join(right, "match_idx", "left")

    @cached_property
    def smd(self) -> list[float]:
        """Standardized mean difference of each feature over the matched pairs."""
        figures = [F.count(F.lit(1)).alias("n")]
        for c in self.cells:
            for side in ("t", "m"):
                figures += [F.avg(f"{side}_{c}").alias(f"mean_{side}_{c}"), F.coalesce(F.var_samp(f"{side}_{c}"), F.lit(0.0)).alias(f"var_{side}_{c}")]
        row = self.pairs.filter("not no_match").agg(*figures).first()
        found = []
        for c in self.cells:
            a, b = row[f"mean_t_{c}"], row[f"mean_m_{c}"]
            spread = ((row[f"var_t_{c}"] + row[f"var_m_{c}"]) / 2) ** 0.5
            found.append(abs(a - b) / spread if row["n"] >= 2 and a is not None and b is not None and spread > 0 else 0.0)
        return found

    @cached_property
    def per_target(self) -> DataFrame:
        """A row for each target: the match's figures, missing counts, contributions and flags."""
        missing = [cleaning.missing_count([F.col(f"{side}_{c}") for c in self.cells]) for side in ("t", "m")]
        shares = signals.contributions([F.col(f"t_{c}") for c in self.cells], [F.col(f"m_{c}") for c in self.cells])
        zeros = F.array(*[F.lit(0.0)] * len(self.cells))
        rows = self.pairs.select(
            *self.matches.columns,
            missing[0].alias("target_missing"),
            F.when(~F.col("no_match"), missing[1]).alias("match_missing"),
            F.when(F.col("no_match"), zeros).otherwise(shares).alias("contributions"),
        )
        return self.kept(rows.withColumn("flags", signals.flags(self.names, self.smd, self.threshold)).withColumn("flag_list", F.split("flags", r" \| ")))

    def detail(self) -> DataFrame:
        """The detail table: a row for each target, contributions as columns; blanks (nulls) where there is no match."""
        matched = ~F.col("no_match")
        shares = [F.when(matched, F.round(F.element_at("contributions", k + 1), 6)).alias(f"contrib_{n}") for k, n in enumerate(self.names)]
        return self.per_target.select(
            F.col("target_idx").alias("target_index"), F.col("best_distance").alias("euc_distance"), F.when(matched, F.round("nndr", 4)).alias("nndr"),
            F.col("near_miss").alias("near_miss_count"), F.col("mnn_confirmed").cast("int").alias("mnn_confirmed"), "target_missing", "match_missing", *shares, "flags",
        )

    def linked(self) -> DataFrame:
        """Target columns, supplemental columns that no feature uses, and the match's figures; repeated names get a number."""
        used = {link[2] for link in self.links} | {self.supplemental_index}
        extra = [c for c in self.supplemental.columns if c not in used]
        left = self.target.select(F.col(f"`{self.target_index}`").cast("long").alias("__t"), F.struct(*(F.col(f"`{c}`") for c in self.target.columns if c != self.target_index)).alias("__target"))
        right = self.supplemental.select(F.col(f"`{self.supplemental_index}`").cast("long").alias("__s"), F.struct(F.lit(1).alias("__one"), *(F.col(f"`{c}`") for c in extra)).alias("__supplemental"))
        figures = self.per_target.select(
            F.col("target_idx").alias("__t"), F.col("match_idx").alias("__s"), F.col("best_distance").alias("euc_distance"), "repeats",
            F.when(~F.col("no_match"), F.round("nndr", 4)).alias("nndr"), F.col("near_miss").alias("near_miss_count"), F.col("mnn_confirmed").cast("int").alias("mnn_confirmed"), "flags",
        )
        tail = ["euc_distance", "repeats", "nndr", "near_miss_count", "mnn_confirmed", "flags"]
        joined = left.join(figures, "__t").join(right, "__s", "left")
        wanted = [("__target", c) for c in self.target.columns if c != self.target_index] + [("__supplemental", c) for c in extra]
        names: list[str] = []
        columns = []
        for side, c in wanted + [("", c) for c in tail]:
            name, k = c, 2
            while name in names:
                name, k = f"{c} ({k})", k + 1
            names.append(name)
            columns.append((F.col(side)[c] if side else F.col(c)).alias(name))
        return joined.select(F.col("__t").alias("target_index"), *columns)

    def feature_smd(self) -> DataFrame:
        """(feature, smd, flag), a row a feature."""
        spark = self.target.sparkSession
        rows = spark.createDataFrame(list(zip(self.names, self.smd, strict=True)), "feature string, smd double")
        return rows.withColumn("flag", signals.smd_flag(F.col("smd")))

    def summary(self) -> DataFrame:
        return diagnostics.run_summary(self.per_target, self.threshold)

    def match_stats(self) -> DataFrame:
        return diagnostics.match_stats(self.per_target, self.threshold)

    def raw_pairs(self) -> DataFrame:
        """(target_idx, feature, target_raw, match_raw): cells as text, the match's "" where there is none."""

        def cells(table: DataFrame, index: str, name: str, side: int, value: str) -> DataFrame:
            each = F.array(*(F.struct(F.lit(link[0]).alias("feature"), F.coalesce(F.col(f"`{link[side]}`").cast("string"), F.lit("")).alias(value)) for link in self.links))
            return table.select(F.col(f"`{index}`").cast("long").alias(name), F.explode(each).alias("x")).select(name, "x.*")

        left = cells(self.target, self.target_index, "target_idx", 1, "target_raw").join(self.matches.select("target_idx", "match_idx"), "target_idx")
        right = cells(self.supplemental, self.supplemental_index, "match_idx", 2, "match_raw")
        return left.join(right, ["match_idx", "feature"], "left").select("target_idx", "feature", "target_raw", F.coalesce("match_raw", F.lit("")).alias("match_raw"))

    def explained(self, k: int = 50) -> DataFrame:
        """(target_idx, rank, supp_idx, distance, feature, target_z, supp_z, term): the k nearest rows feature by feature."""

        def long(table: DataFrame, index: str, value: str) -> DataFrame:
            each = F.array(*(F.struct(F.lit(n).alias("feature"), F.col(c).alias(value)) for n, c in zip(self.names, self.cells, strict=True)))
            return table.select(index, F.explode(each).alias("x")).select(index, "x.*")

        near = self.matcher.candidates(k)
        rows = near.join(long(self.target_z, "target_idx", "target_z"), "target_idx").join(long(self.supplemental_z, "supp_idx", "supp_z"), ["supp_idx", "feature"])
        gap = F.col("target_z") - F.col("supp_z")
        return rows.withColumn("term", F.coalesce(gap * gap, F.lit(2.0)))

    def scenarios(self, k: int = 3) -> DataFrame:
        """(target_idx, scenario): each target with its k nearest rows, feature by feature, as JSON; numbers to six places, null where missing."""

        def six(c: str) -> Column:
            return F.col(c).cast("decimal(20,6)")

        place = F.array_position(F.array(*(F.lit(n) for n in self.names)), F.col("feature"))
        term = F.struct(place.alias("place"), "feature", six("target_z").alias("target"), six("supp_z").alias("row"), six("term").alias("term"))
        terms = F.transform(F.array_sort(F.collect_list(term)), lambda x: x.dropFields("place"))
        near = self.explained(k).groupBy("target_idx", "rank", "supp_idx", "distance").agg(terms.alias("terms"))
        near = near.select("target_idx", F.struct("rank", F.col("supp_idx").alias("row"), six("distance").alias("distance"), "terms").alias("x"))
        lists = near.groupBy("target_idx").agg(F.array_sort(F.collect_list("x")).alias("candidates"))  # k a target
        every = self.matches.select("target_idx", "no_match", "near_miss", "mnn_confirmed").join(lists, "target_idx", "left")
        told = F.struct(F.col("target_idx").alias("target"), "no_match", "near_miss", "mnn_confirmed", F.coalesce("candidates", F.array().cast(lists.schema["candidates"].dataType)).alias("candidates"))
        return every.select("target_idx", F.to_json(told, {"ignoreNullFields": "false"}).alias("scenario"))

    def without_feature(self, name: str) -> Linkage:
        """The same linkage with one feature left out."""
        return Linkage(self.target, self.supplemental, [x for x in self.links if x[0] != name], self.target_index, self.supplemental_index, self.threshold, self.fast, self.metric)

    def stability(self) -> DataFrame:
        """(left_out, n, same): for each feature, of n targets how many keep their match without it; none stays none.

        All reduced matches come from one pass over the pairs.
        """
        if self.whitener:
            raise ValueError("without a feature the others are turned in another way: use without_feature")
        other = self.matcher.without_each().withColumnRenamed("match_idx", "other_idx")
        name = F.element_at(F.array(*(F.lit(n) for n in self.names)), (F.col("k") + 1).cast("int"))
        same = F.count_if(F.col("match_idx").eqNullSafe(F.col("other_idx")))
        return self.matches.select("target_idx", "match_idx").join(other, "target_idx").groupBy(name.alias("left_out")).agg(F.count(F.lit(1)).alias("n"), same.alias("same"))


def from_links(links: Sequence[ColumnLink], target: Sequence[str], supplemental: Sequence[str]) -> list[tuple[str, str, str]]:
    """Features for ``Linkage`` from links by place; ``target`` and ``supplemental`` name the tables' columns."""
    return [(x.name, target[x.target], supplemental[x.supplemental]) for x in validated(links)]
