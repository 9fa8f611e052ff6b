"""Joint standardization of two tables and the check that their scales agree."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scale:
    """Mean and population deviation of a feature over both tables' observed cells."""

    mean: float
    deviation: float


def rounded(x: float, size: float) -> float:
    """A figure to 31 binary places of its size: the last bits of a sum depend on the order of additions, and must not decide ties."""
    step = 2.0 ** (math.floor(math.log2(size)) - 30)
    return round(x / step) * step


def pooled_scales(target: DataFrame, supplemental: DataFrame, features: Sequence[str]) -> list[Scale]:
    """One aggregate over both tables; a constant feature has deviation 1, one without cells mean 0."""
    both = target.select(*features).unionByName(supplemental.select(*features))
    figures = []
    for k, f in enumerate(features):
        figures += [F.avg(f).alias(f"mean{k}"), F.stddev_pop(f).alias(f"dev{k}"), (F.min(f) == F.max(f)).alias(f"flat{k}")]
    row = both.agg(*figures).first()  # three numbers a feature
    scales = []
    for k in range(len(features)):
        flat = row[f"flat{k}"] or not row[f"dev{k}"]
        scales.append(Scale(row[f"mean{k}"] if row[f"mean{k}"] is not None else 0.0, 1.0 if flat else row[f"dev{k}"]))
    return scales


@dataclass(frozen=True)
class Figures:
    """Rows of either table, and the scales of their features."""

    n_target: int
    n_supplemental: int
    scales: list[Scale]


_MOMENTS = "side int, n long, counts array<double>, means array<double>, squares array<double>, least array<double>, most array<double>"


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    """Counts, means, squared deviations, least and greatest of parts (5, features), one after the other."""
    total = parts[0].copy()
    for p in parts[1:]:
        n = total[0] + p[0]
        with np.errstate(invalid="ignore", divide="ignore"):
            gap = np.where((total[0] > 0) & (p[0] > 0), p[1] - total[1], 0.0)
            mean = np.where(total[0] > 0, np.where(p[0] > 0, total[1] + gap * p[0] / n, total[1]), p[1])
            square = total[2] + p[2] + np.where(n > 0, gap * gap * total[0] * p[0] / n, 0.0)
        total = np.stack([n, mean, square, np.fmin(total[3], p[3]), np.fmax(total[4], p[4])])
    return total


def _row(side: int, n: int, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([side], pa.int32()), pa.array([n], pa.int64()), *(pa.array([x.tolist()], pa.list_(pa.float64())) for x in total)], [x.split()[0] for x in _MOMENTS.split(", ")])


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each side of a partition, from rows (side, cells)."""
    rows: dict[int, int] = {}
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        sides = batch.column(0).to_numpy()
        if not len(sides):
            continue
        cells = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(sides), -1)
        for side in np.unique(sides).tolist():
            x = cells[sides == side]
            seen = ~np.isnan(x)
            n = seen.sum(axis=0).astype(float)
            with np.errstate(invalid="ignore", divide="ignore"):
                mean = np.where(n > 0, np.where(seen, x, 0.0).sum(axis=0) / n, 0.0)
            gaps = np.where(seen, x - mean, 0.0)
            mean = mean + np.where(n > 0, gaps.sum(axis=0) / np.maximum(n, 1), 0.0)  # what rounding has left
            part = np.stack([n, mean, (np.where(seen, x - mean, 0.0) ** 2).sum(axis=0), np.where(seen, x, np.inf).min(axis=0), np.where(seen, x, -np.inf).max(axis=0)])
            held[side] = _joined([held[side], part]) if side in held else part
            rows[side] = rows.get(side, 0) + len(x)
    for side, total in held.items():
        yield _row(side, rows[side], total)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: dict[int, int] = {}
    held: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for r in batch.to_pylist():
            rows[r["side"]] = rows.get(r["side"], 0) + r["n"]
            part = np.array([r[k] for k in ("counts", "means", "squares", "least", "most")])
            held[r["side"]] = [_joined([*held.get(r["side"], []), part])]
    for side, (total,) in held.items():
        yield _row(side, rows[side], total)


def pooled_figures(target: DataFrame, supplemental: DataFrame, width: int) -> Figures:
    """Counts and scales of two tables whose first column is an array of cells: one aggregate over both, a row a partition.

    A constant feature has deviation 1, one without cells mean 0.  Scales are rounded, so that equal tables have equal ones
    however their rows are dealt.
    """
    sides = [t.select(F.lit(k).alias("side"), F.col(t.columns[0]).alias("cells")) for k, t in enumerate((target, supplemental))]
    partial = sides[0].unionByName(sides[1]).mapInArrow(_moments, _MOMENTS)
    found = {r["side"]: r for r in partial.repartition("side").mapInArrow(_merged, _MOMENTS).collect()}  # a row a side
    parts = [np.array([r[k] for k in ("counts", "means", "squares", "least", "most")]) for r in found.values()]
    scales = [Scale(0.0, 1.0)] * width
    if parts:
        n, mean, square, least, most = _joined(parts)
        scales = [Scale(m if c else 0.0, 1.0 if lo >= hi or not q else float(np.sqrt(q / c))) for c, m, q, lo, hi in zip(n.tolist(), mean.tolist(), square.tolist(), least.tolist(), most.tolist(), strict=True)]
        scales = [Scale(rounded(s.mean, max(abs(s.mean), s.deviation)), rounded(s.deviation, s.deviation)) if math.isfinite(s.mean) and math.isfinite(s.deviation) else s for s in scales]
    return Figures(*(found[k]["n"] if k in found else 0 for k in range(2)), scales)


def pooled_covariance(target: DataFrame, supplemental: DataFrame, scales: Sequence[Scale]) -> np.ndarray:
    """Mean products of standard scores over the rows of either table that have both, by feature pair; 0 where none has.

    The tables have a column ``cells``, an array.  One aggregate over both; a matrix of features by features comes to the driver.
    """
    means, deviations = np.array([s.mean for s in scales]), np.array([s.deviation for s in scales])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = counts = np.zeros((len(scales), len(scales)))
        for batch in batches:
            z = (batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, -1) - means) / deviations
            seen = ~np.isnan(z)
            z = np.where(seen, z, 0.0)
            sums, counts = sums + z.T @ z, counts + seen.astype(float).T @ seen
        i, j = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(sums[i, j]), pa.array(counts[i, j])], ["i", "j", "sum", "n"])

    both = target.select("cells").unionByName(supplemental.select("cells")).mapInArrow(run, "i int, j int, sum double, n double")
    out = np.zeros((len(scales), len(scales)))
    for r in both.groupBy("i", "j").agg((F.sum("sum") / F.sum("n")).alias("c")).collect():
        out[r["i"], r["j"]] = r["c"]
    return out


def positive_definite(covariance: np.ndarray, least: float = 1e-8) -> np.ndarray:
    """The covariance as a matrix that a distance can be taken from.

    Features without variance get 1 and no covariance.  Products of different rows need not make a
    proper matrix: eigenvalues below ``least`` are raised to it and the variances restored.  A proper one stays as it is.
    """
    c = (covariance + covariance.T) / 2
    flat = np.diag(c) <= 0
    c[flat, :] = c[:, flat] = 0.0
    c[flat, flat] = 1.0
    e, u = np.linalg.eigh(c)
    if e[0] >= least:
        return c
    raised = (u * np.maximum(e, least)) @ u.T
    scale = np.sqrt(np.diag(c) / np.diag(raised))
    return raised * scale[:, None] * scale[None, :]


class Whitener:
    """Scores turned so that their Euclidean distance is Mahalanobis'.

    A row is turned by the Cholesky factor of the covariance of its own observed features, in feature order:
    each score becomes what the observed ones before it do not tell, in its own deviations.  Missing cells stay
    missing and are charged as ever.  Equal rows give equal scores, bit for bit, whatever stands beside them.
    """

    def __init__(self, covariance: np.ndarray) -> None:
        self.covariance = covariance

    def __call__(self, z: np.ndarray) -> np.ndarray:
        out = np.full(z.shape, np.nan)
        patterns, which = np.unique(~np.isnan(z), axis=0, return_inverse=True)
        for p, seen in enumerate(patterns):
            at = np.flatnonzero(seen)
            if not len(at):
                continue
            rows = np.flatnonzero(which.ravel() == p)
            factor = np.linalg.cholesky(self.covariance[np.ix_(at, at)])
            turned: list[np.ndarray] = []
            for k, c in enumerate(at):
                rest = z[rows, c]
                for j, w in enumerate(turned):
                    rest = rest - factor[k, j] * w
                turned.append(rest / factor[k, k])
            out[np.ix_(rows, at)] = np.column_stack(turned)
        return out


def whitened(table: DataFrame, index: str, scales: Sequence[Scale], whitener: Whitener, names: Sequence[str]) -> DataFrame:
    """(index, names...): turned scores of a table with its index and ``cells``; null where missing."""
    means, deviations = np.array([s.mean for s in scales]), np.array([s.deviation for s in scales])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, len(scales))
            z = whitener((cells - means) / deviations)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(z[:, k], from_pandas=True) for k in range(len(scales)))], [index, *names])

    return table.select(index, "cells").mapInArrow(run, ", ".join([f"`{index}` long", *(f"`{n}` double" for n in names)]))


def standardized(table: DataFrame, features: Sequence[str], scales: Sequence[Scale]) -> DataFrame:
    """The table with its features in pooled deviations from the pooled mean; nulls stay."""
    return table.withColumns({f: (F.col(f) - F.lit(s.mean)) / F.lit(s.deviation) for f, s in zip(features, scales, strict=True)})


def side_deviations(target: DataFrame, supplemental: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, target_std, supplemental_std): deviations of each side; constant or empty ones are 0 or null."""

    def one(table: DataFrame, name: str) -> DataFrame:
        sums = table.agg(*(F.when(F.min(f) == F.max(f), 0.0).otherwise(F.stddev_pop(f)).alias(f) for f in features))
        return sums.unpivot([], list(features), "feature", name)

    return one(target, "target_std").join(one(supplemental, "supplemental_std"), "feature")


def scale_report(target: DataFrame, supplemental: DataFrame, features: Sequence[str], limit: float = 50.0) -> DataFrame:
    """(feature, target_std, supplemental_std, ratio, mismatch); skipped features have no ratio."""
    ratio = F.when((F.col("target_std") > 0) & (F.col("supplemental_std") > 0), F.col("target_std") / F.nullif("supplemental_std", F.lit(0.0)))
    report = side_deviations(target, supplemental, features).withColumn("ratio", ratio)
    return report.withColumn("mismatch", F.coalesce((F.col("ratio") > limit) | (F.col("ratio") < 1.0 / limit), F.lit(False)))


def scale_warnings(target: DataFrame, supplemental: DataFrame, features: Sequence[str], limit: float = 50.0) -> list[str]:
    """A sentence for each feature whose spreads differ by more than ``limit`` times, in feature order."""
    rows = {r["feature"]: r for r in scale_report(target, supplemental, features, limit).filter("mismatch").collect()}
    # Fixed text: callers show these sentences and look for parts of them.
    return [
        f"possible scale mismatch in column '{f}': target spread (std {rows[f]['target_std']:.4g}) vs supplemental spread (std {rows[f]['supplemental_std']:.4g}) "
        f"differ by more than {limit:g}x — check that both files use the same units and neither is already standardized"
        for f in features
        if f in rows
    ]
