"""Targets that arrive as a stream, each micro-batch matched against a fixed supplemental table.

Means and deviations are frozen from a reference table, so a row gets the same score in any batch.  Mutual
confirmation looks at all targets so far: the least distance of each supplemental row, and how many targets
have it, is a table that each batch writes anew, under its own number, from the one before it.  A later target
that is nearer revokes what was confirmed; ``revoked`` tells which, and ``confirmed`` judges all matches again,
so any split into batches ends with the answer of one batch.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import blocks
from ..operators.match import Matcher, least_targets
from ..operators.standardize import Scale, pooled_scales, standardized
from ..sources.shared import Kept, names_in, remove, shared_folder

_MINIMA = "supp_idx long, reverse_distance double, reverse_repeat_count long"


class StreamMatcher:
    """``state`` is the folder of the minima; a query that is started again must name the same one."""

    def __init__(self, reference: DataFrame, supplemental: DataFrame, supplemental_index: str, features: Sequence[str], threshold: float = 0.8, state: str | None = None) -> None:
        self.features, self.threshold, self.index = list(features), threshold, supplemental_index
        self.scales: list[Scale] = pooled_scales(reference, supplemental, self.features)
        self.supplemental = standardized(supplemental.select(supplemental_index, *self.features), self.features, self.scales)
        # The fixed table is put into blocks once; every batch meets the same ones.
        n, width = self.supplemental.count(), len(self.features)
        rows = min(blocks.SUPPLEMENTAL_ROWS, max(blocks.LEAST_ROWS, blocks.BLOCK_CELLS // width))
        cells = F.array(*(F.col(f).cast("double") for f in self.features)).alias("cells")
        fixed = blocks.blocked(self.supplemental.select(F.col(supplemental_index).cast("long").alias("supp_idx"), cells), "supp_idx", "cells", n, rows)
        self.kept = Kept()
        self.blocks = blocks.Blocks(self.kept(fixed.rows), fixed.n, n)
        self.spark = supplemental.sparkSession
        self.state = (state or f"{shared_folder(self.spark)}/minima-{id(self)}").rstrip("/")

    def matcher(self, batch: DataFrame, target_index: str) -> Matcher:
        scores = standardized(batch.select(target_index, *self.features), self.features, self.scales)
        return Matcher(scores, target_index, self.supplemental, self.index, self.features, self.threshold, self.blocks)

    def match_batch(self, batch: DataFrame, target_index: str) -> DataFrame:
        """The matches of one batch, confirmed among its own targets."""
        return self.matcher(batch, target_index).matches()

    def _versions(self) -> list[int]:
        return sorted(int(x.removeprefix("batch-")) for x in names_in(self.spark, self.state) if x.startswith("batch-"))

    def minima(self, before: int | None = None) -> DataFrame:
        """(supp_idx, reverse_distance, reverse_repeat_count) over all batches, or over those before one."""
        usable = [v for v in self._versions() if before is None or v < before]
        if not usable:
            return self.spark.createDataFrame([], _MINIMA)
        return self.spark.read.schema(_MINIMA).parquet(f"{self.state}/batch-{usable[-1]}")

    def take(self, batch: DataFrame, target_index: str, batch_id: int, sink: Callable[[DataFrame, int], None]) -> None:
        """Match a batch, hand it to ``sink`` with its number, and bring the minima up to date.

        A batch that comes again finds the minima before it and writes the same ones.  The two last
        versions stay, and what the batch has written besides goes.
        """
        matcher = self.matcher(batch, target_index)
        try:
            own = matcher.reverse().filter("reverse_distance is not null").select("supp_idx", "reverse_distance", F.col("reverse_repeat_count").cast("long").alias("reverse_repeat_count"))
            least = least_targets(self.minima(batch_id).unionByName(own)).select(*(F.col(c).cast(k).alias(c) for c, k in (x.split() for x in _MINIMA.split(", "))))
            least.write.mode("overwrite").parquet(f"{self.state}/batch-{batch_id}")
            matches = matcher.matches().drop("mnn_confirmed", "reverse_repeat_count")
            sink(self._judged(matches).withColumn("batch_id", F.lit(batch_id)), batch_id)
        finally:
            matcher.kept.forget()
        for old in [v for v in self._versions() if v < batch_id][:-1]:
            remove(self.spark, f"{self.state}/batch-{old}")

    def _judged(self, matches: DataFrame) -> DataFrame:
        judged = matches.join(self.minima().withColumnRenamed("supp_idx", "match_idx"), "match_idx", "left")
        mutual = F.coalesce(F.col("best_distance") == F.col("reverse_distance"), F.lit(False))
        return judged.select(*matches.columns, mutual.alias("mnn_confirmed"), F.coalesce("reverse_repeat_count", F.lit(0)).cast("long").alias("reverse_repeat_count"))

    def confirmed(self, matches: DataFrame) -> DataFrame:
        """Matches of earlier batches judged by all targets so far."""
        return self._judged(matches.drop("mnn_confirmed", "reverse_repeat_count"))

    def revoked(self, matches: DataFrame) -> DataFrame:
        """(target_idx, match_idx, best_distance) of matches that were confirmed when they were made and are no longer."""
        now = self.minima().select(F.col("supp_idx").alias("match_idx"), "reverse_distance")
        return matches.filter("mnn_confirmed").join(now, "match_idx").filter("reverse_distance < best_distance").select("target_idx", "match_idx", "best_distance")

    def start(self, stream: DataFrame, target_index: str, sink: Callable[[DataFrame, int], None], checkpoint: str, **trigger):
        """Run a query that hands each batch's matches, with its number as ``batch_id``, to ``sink``."""

        def each(batch: DataFrame, batch_id: int) -> None:
            if not batch.isEmpty():
                self.take(batch, target_index, batch_id, sink)

        return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
