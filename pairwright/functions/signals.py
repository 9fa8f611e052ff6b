"""Signals of a matched row as column expressions: contributions of features, and plain-English flags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.blocks import MISSING_PENALTY, sum_terms

SMD_POOR, SMD_WARNING = 0.25, 0.10

# The messages, in the order in which they are given.
NO_MATCH = "WARNING: no valid match — target shares no observed features with any supplemental row"
AMBIGUOUS = "ambiguous match — NNDR {nndr} (>= {threshold:.2f})"
NEAR_MISS = "{n} near-miss row(s) within distance ratio threshold"
TIES = "{n} exact-distance tie(s)"
NOT_MUTUAL = "MNN not confirmed — supplemental row is closer to a different target; this record may have no valid match"
TARGET_MISSING = "target row missing {k} of {n} shared feature(s); match uses observed features only"
MATCH_MISSING = "matched supplemental row missing {k} of {n} shared feature(s)"
POOR_BALANCE = "poor feature balance — {features} (|SMD| > 0.25)"
IMBALANCE = "feature imbalance — {features} (|SMD| > 0.10)"
SEPARATOR = " | "


def contributions(target: Sequence[Column], match: Sequence[Column]) -> Column:
    """Each feature's share of the squared distance; zeros where the distance is zero or there is no match."""
    terms = [F.coalesce((a - b) * (a - b), F.lit(MISSING_PENALTY)) for a, b in zip(target, match, strict=True)]
    total = sum_terms(terms)
    return F.array(*(F.coalesce(t / F.nullif(total, F.lit(0.0)), F.lit(0.0)) for t in terms))


def smd_flag(smd: Column) -> Column:
    return F.when(F.abs(smd) > SMD_POOR, "poor").when(F.abs(smd) > SMD_WARNING, "warning").otherwise("ok")


def _filled(message: str, **columns: Column) -> Column:
    """A message with columns in the places of its names."""
    parts, rest = [], message
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [F.lit(before), columns[name].cast("string")]
    return F.concat(*parts, F.lit(rest))


def two_places(x: Column) -> Column:
    """A number of 0 to 1 as text with two places: its exact binary value, rounded half to even (exact from 1/16 on).

    As a whole number of 2^-56 the value is a long, and so is its hundredfold.
    """
    hundredfold = (x * F.lit(2.0**56)).cast("long") * 100
    whole, rest, half = F.shiftright(hundredfold, 56), hundredfold.bitwiseAND(F.lit((1 << 56) - 1)), F.lit(1 << 55)
    n = whole + ((rest > half) | ((rest == half) & (whole % 2 == 1))).cast("long")
    return F.concat(F.floor(n / 100).cast("string"), F.lit("."), F.lpad((n % 100).cast("string"), 2, "0"))


def flags(features: Sequence[str], smd: Sequence[float], threshold: float) -> Column:
    """The flags of a row of matches with target_missing and match_missing; "" if there are none."""
    n = len(features)
    poor = ", ".join(f for f, v in zip(features, smd, strict=True) if v > SMD_POOR)
    warned = ", ".join(f for f, v in zip(features, smd, strict=True) if SMD_WARNING < v <= SMD_POOR)
    ambiguous = AMBIGUOUS.replace("{threshold:.2f}", f"{threshold:.2f}")
    target_missing = F.when(F.col("target_missing") > 0, _filled(TARGET_MISSING.replace("{n}", str(n)), k=F.col("target_missing")))
    matched = F.concat_ws(
        SEPARATOR,
        F.when(F.col("nndr") >= threshold, _filled(ambiguous, nndr=two_places(F.col("nndr")))),
        F.when(F.col("near_miss") > 0, _filled(NEAR_MISS, n=F.col("near_miss"))),
        F.when(F.col("repeats") > 1, _filled(TIES, n=F.col("repeats"))),
        F.when(~F.col("mnn_confirmed"), F.lit(NOT_MUTUAL)),
        target_missing,
        F.when(F.col("match_missing") > 0, _filled(MATCH_MISSING.replace("{n}", str(n)), k=F.col("match_missing"))),
        F.lit(POOR_BALANCE.format(features=poor) if poor else None).cast("string"),
        F.lit(IMBALANCE.format(features=warned) if warned else None).cast("string"),
    )
    return F.when(F.col("no_match"), F.concat_ws(SEPARATOR, F.lit(NO_MATCH), target_missing)).otherwise(matched)


def near_miss_cutoff(best_distance: Column, top_distances: Column, threshold: float) -> Column:
    """The distance up to which a row counts as a near miss; without a threshold the last of the listed ones."""
    return best_distance / threshold if threshold > 0 else F.try_element_at(top_distances, F.lit(-1))


def cascading_ratio(distances: Column, threshold: float = 0.8) -> Column:
    """struct(nndr, near_misses) of an ascending array of distances, null or infinite ones last.

    The ratio of the first two, and how many after the first have d1 / d of ``threshold`` or more
    before the first that has not.  No distance or a single one: 0; no finite one: 1; equal
    zeros are ties, each a near miss.
    """
    first, second = F.try_element_at(distances, F.lit(1)), F.try_element_at(distances, F.lit(2))
    none = first.isNull() | (first == float("inf"))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(True).alias("going"))

    def step(state: Column, d: Column) -> Column:
        near = F.coalesce(F.when(first == 0, d == 0).otherwise(first / F.nullif(d, F.lit(0.0)) >= threshold), F.lit(False))
        going = state["going"] & near
        return F.struct((state["n"] + going.cast("long")).alias("n"), going.alias("going"))

    count = F.aggregate(F.slice(distances, 2, F.greatest(F.size(distances) - 1, F.lit(0))), start, step)["n"]
    ratio = F.when(F.size(distances) == 0, 0.0).when(none, 1.0).when(F.size(distances) < 2, 0.0).when(first == 0, F.when(second == 0, 1.0).otherwise(0.0)).otherwise(F.coalesce(first / F.nullif(second, F.lit(0.0)), F.lit(0.0)))
    return F.struct(ratio.alias("nndr"), F.when(none | (F.size(distances) < 2), 0).otherwise(count).cast("long").alias("near_misses"))
