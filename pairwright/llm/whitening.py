"""Whitening of embeddings by a weighted covariance of their distinct integer vectors.

Each entry c becomes the integer floor(64 * c) + 1000000.  Equal integer vectors are one row with
its count; the fit takes each of them with weight one, or with its count.  Covariances are sums
of products of centred matrices, one for each partition and added in Spark; the eigenvectors of
the sum, a matrix of the vectors' length squared, are found on the driver.  Each distinct vector is
whitened once, and the result is joined back to its rows.

Result of ``whiten``, a row for each remaining row and component: vec_id, component (from 1, by
falling eigenvalue), n (total weight of the fit), deviation (the sum over dimensions of
(n * x - S)**2, exact), whitened, explained and identity_error.  Eigenvectors have their largest
entry positive.

Rows whose vector is null or empty, or holds null or non-finite entries, are dropped.  Vectors
must have one length: rows of another length than the most frequent one (ties: the longest) are
dropped too.  Entries beyond 2**62 count as that.  Components without variance, beyond rounding,
are left out, so fewer than two different vectors give no rows.  A deviation beyond the range of
a long is null.  Null vec_ids stay null; repeated rows come as often as they are there.  An empty
table gives no rows.  Columns other than vec_id and embedding are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import join_spread
from .store import drop, written

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
_MOST = float(1 << 62)
#: Vectors that a task multiplies at a time hold so many entries.
ENTRIES = 1 << 20


@dataclass(frozen=True)
class Centre:
    """Weight and exact sums of the fit; a vector is centred by an integer and a fraction, so nothing is lost to its size."""

    n: int
    sums: list[int]

    @property
    def whole(self) -> list[int]:
        return [s // self.n for s in self.sums]

    def centred(self, x: np.ndarray) -> np.ndarray:
        rest = np.array([(s - self.n * w) / self.n for s, w in zip(self.sums, self.whole, strict=True)])
        return (x - np.array(self.whole, np.int64)).astype(float) - rest

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum of (n * x - S)**2 of each row, None beyond a long."""
        whole = np.array(self.whole, np.int64)
        rest = [s - self.n * w for s, w in zip(self.sums, self.whole, strict=True)]  # below n
        most = self.n * (int(np.abs((x - whole).astype(float)).max(initial=0.0)) + 2)
        if most < 1 << 31 and len(rest) * most * most < 1 << 63:
            y = (x - whole) * self.n - np.array(rest, np.int64)
            return (y * y).sum(axis=1).tolist()
        sums = [sum((self.n * (int(v) - w) - r) ** 2 for v, w, r in zip(row, whole.tolist(), rest, strict=True)) for row in x.tolist()]
        return [s if s < 1 << 63 else None for s in sums]


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Slices of a batch and the matrix of their first column, lists of one length."""
    for batch in batches:
        if not batch.num_rows:
            continue
        d = batch.column(0).offsets[1].as_py() - batch.column(0).offsets[0].as_py()
        step = max(1, ENTRIES // d)
        for a in range(0, batch.num_rows, step):
            part = batch.slice(a, step)
            yield part, part.column(0).flatten().to_numpy().reshape(-1, d)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(place, low, high): sums of the lower 32 bits and of the rest, by dimension; place -1 has the weights."""
    low = high = None
    weight = 0
    for part, x in _matrices(batches):
        w = part.column(1).to_numpy()
        weight += int(w.sum())
        if low is None:
            low, high = [0] * x.shape[1], [0] * x.shape[1]
        for k in range(x.shape[1]):
            low[k] += int(((x[:, k] & 0xFFFFFFFF) * w).sum()) if w.max() < 1 << 20 else sum(int(a) * int(b) for a, b in zip(x[:, k] & 0xFFFFFFFF, w, strict=True))
            high[k] += int(((x[:, k] >> 32) * w).sum())
    if low is not None:
        whole = [a + (b << 32) for a, b in zip(low, high, strict=True)]
        columns = [[-1, *range(len(whole))], [weight, *(s & 0xFFFFFFFF for s in whole)], [0, *(s >> 32 for s in whole)]]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], ["place", "low", "high"])


def _products(matrix_of):
    """(i, row): the sum of weighted products of the matrices that ``matrix_of(part, x)`` gives, row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for part, x in _matrices(batches):
            z = matrix_of(part, x)
            product = (z * part.column(1).to_numpy()[:, None]).T @ z
            total = product if total is None else total + product
        if total is not None:
            lists = pa.ListArray.from_arrays(np.arange(len(total) + 1, dtype=np.int32) * len(total), pa.array(total.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), lists], ["i", "row"])

    return run


def _added(rows: DataFrame) -> np.ndarray:
    """The sum of all matrices; entries are added in Spark, and one matrix comes to the driver."""
    entries = rows.select("i", F.posexplode("row").alias("j", "value")).groupBy("i", "j").agg(F.sum("value").alias("value")).collect()
    d = 1 + max((r["i"] for r in entries), default=-1)
    out = np.zeros((d, d))
    for r in entries:
        out[r["i"], r["j"]] = r["value"]
    return out


def integers(table: DataFrame) -> DataFrame:
    """(vec_id, x array<long>) of the rows with sound vectors of the most frequent length."""
    entry = lambda c: F.floor(F.greatest(F.lit(-_MOST), F.least(F.lit(_MOST), c * SCALE))) + SHIFT
    rows = table.select(table["vec_id"].cast("long").alias("vec_id"), F.transform(table["embedding"], lambda c: c.cast("double")).alias("v"))
    rows = rows.filter(F.coalesce((F.size("v") > 0) & F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False)))
    length = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return rows.filter(F.size("v") == (length["d"] if length else 0)).select("vec_id", F.transform("v", entry).alias("x"))


def whiten(table: DataFrame, components: int = COMPONENTS, weights: str = "one") -> DataFrame:
    """Whitened embeddings (vec_id, embedding); ``weights``: each distinct vector counts ``one`` or its ``counts``."""
    if weights not in ("one", "counts"):
        raise ValueError("weights are one or counts")
    rows = integers(table)
    grouped = rows.groupBy("x").agg(F.count(F.lit(1)).alias("copies"))
    distinct = written(grouped.select("x", (F.lit(1).cast("long") if weights == "one" else F.col("copies")).alias("weight"), "copies"), "distinct")

    sums = distinct.select("x", "weight").mapInArrow(_sums, "place int, low long, high long").groupBy("place").agg(F.sum("low").alias("low"), F.sum("high").alias("high"))
    found = {r["place"]: r["low"] + (r["high"] << 32) for r in sums.collect()}  # a number a dimension
    schema = "x array<long>, copies long, deviation long, whitened array<double>"
    spark = table.sparkSession
    if not found:
        return _result(rows, spark.createDataFrame([], schema), 0, np.zeros(0), 0.0)
    n = found.pop(-1)
    centre = Centre(n, [found[k] for k in sorted(found)])

    covariance = _added(distinct.select("x", "weight").mapInArrow(_products(lambda part, x: centre.centred(x)), "i int, row array<double>")) / n
    e, u = np.linalg.eigh((covariance + covariance.T) / 2)
    trace = float(np.trace(covariance))
    e, u = e[::-1], u[:, ::-1]
    kept = int((e > max(e[0], 0) * 1e-12 * len(e)).sum()) if e[0] > 0 else 0
    kept = min(kept, components)
    e, u = e[:kept], u[:, :kept]
    u = u * np.where(u[np.abs(u).argmax(axis=0), np.arange(kept)] < 0, -1.0, 1.0)
    turn = u / np.sqrt(e)

    def whitened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _matrices(batches):
            y = centre.centred(x) @ turn
            lists = pa.ListArray.from_arrays(np.arange(len(y) + 1, dtype=np.int32) * kept, pa.array(y.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(centre.deviations(x), pa.int64()), lists], ["x", "copies", "deviation", "whitened"])

    if not kept:
        return _result(rows, spark.createDataFrame([], schema), n, e, 0.0)
    once = written(distinct.select("x", "weight", "copies").mapInArrow(whitened, schema), "whitened")
    drop(distinct.written_to)
    weight = F.lit(1).cast("long") if weights == "one" else F.col("copies")
    means = once.select(weight.alias("w"), F.posexplode("whitened").alias("k", "y")).groupBy("k").agg((F.sum(F.col("w") * F.col("y")) / n).alias("mean")).collect()
    mean = np.array([r["mean"] for r in sorted(means, key=lambda r: r["k"])])  # a number a component
    check = _added(once.select("whitened", weight.alias("w")).mapInArrow(_products(lambda part, y: y - mean), "i int, row array<double>")) / n
    return _result(rows, once, n, e / trace, float(np.abs(check - np.eye(kept)).max()))


def _result(rows: DataFrame, once: DataFrame, n: int, explained: np.ndarray, identity_error: float) -> DataFrame:
    shares = F.array(*(F.lit(float(x)) for x in explained)) if len(explained) else F.array().cast("array<double>")
    joined = join_spread(rows, once, "x", "copies").select("vec_id", "deviation", F.posexplode("whitened").alias("k", "whitened"))
    return joined.select(
        "vec_id", (F.col("k") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("k")).alias("explained"), F.lit(identity_error).alias("identity_error"),
    )
