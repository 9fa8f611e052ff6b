"""How unique rows are: exact agreement on growing sets of variables; noise; accuracy against a truth."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cleaning
from ..sources.shared import Kept
from ..sources.tables import write_csv
from .quantiles import exact_quantiles

# Least accuracies that a scored run must reach.
FLOORS = {"clean_accuracy": 1.0, "duplicate_group_accuracy": 1.0, "missing_one_accuracy": 0.9, "overall_accuracy": 0.85, "wrong_flagged_rate": 0.6}


def agreement_counts(target: DataFrame, pool: DataFrame, target_id: str, variables: Sequence[str]) -> DataFrame:
    """(target_id, n): pool rows that agree exactly on all variables; the pool is counted before the join."""
    counts = pool.groupBy(*variables).agg(F.count(F.lit(1)).alias("n"))
    return target.select(target_id, *variables).join(counts, list(variables), "left").select(target_id, F.coalesce("n", F.lit(0)).alias("n"))


def leading_counts(target: DataFrame, pool: DataFrame, target_id: str, variables: Sequence[str]) -> DataFrame:
    """(target_id, k, n): pool rows that agree exactly on the first k variables, for every k from 1.

    One ROLLUP counts the pool on all levels, and one join by level and values brings the counts to the targets.
    Null agrees with nothing; a null that is a value and one that a level has left out are told apart by the level.
    """
    width = len(variables)
    level = F.lit(width) - F.bit_count(F.grouping_id())  # a leading group leaves out the last variables
    groups = pool.rollup(*variables).agg(level.cast("int").alias("k"), F.count(F.lit(1)).alias("n")).filter("k > 0")
    own = [F.when(F.lit(c) < F.col("k"), F.col(v)).alias(v) for c, v in enumerate(variables)]
    levels = target.select(target_id, *variables, F.explode(F.array(*(F.lit(k + 1) for k in range(width)))).alias("k")).select(target_id, "k", *own)
    key = [f"v{c}" for c in range(width)]
    left = levels.select(target_id, "k", *(F.col(v).alias(x) for v, x in zip(variables, key, strict=True)))
    right = groups.select(F.col("k").alias("level"), "n", *(F.col(v).alias(f"p_{x}") for v, x in zip(variables, key, strict=True)))
    same = F.col("k") == F.col("level")
    for c, x in enumerate(key):
        same &= F.col(x).eqNullSafe(F.col(f"p_{x}"))
        right = right.filter((F.col("level") <= c) | F.col(f"p_{x}").isNotNull())
    return left.join(right, same, "left").select(target_id, "k", F.coalesce("n", F.lit(0)).alias("n"))


def candidate_gradient(target: DataFrame, pool: DataFrame, target_id: str, variables: Sequence[str]) -> DataFrame:
    """A row for each number k of leading variables: mean, median and most agreeing rows, and shares of unique and ambiguous targets.

    The counts are written once, as exact medians read them again.
    """
    kept = Kept()
    counts = kept(leading_counts(target, pool, target_id, variables).select("k", "n"))
    levels = range(1, len(variables) + 1)
    medians = exact_quantiles(counts, {str(k): (F.when(F.col("k") == k, F.col("n")), 0.5) for k in levels})
    names = [" + ".join(variables[:k]) for k in levels]
    told = counts.sparkSession.createDataFrame([(k, names[k - 1], medians[str(k)]) for k in levels], "k_variables int, variables string, median_candidates double")
    rows = counts.groupBy(F.col("k").alias("k_variables")).agg(
        F.avg("n").alias("mean_candidates"), F.max("n").alias("max_candidates"),
        (100.0 * F.count_if(F.col("n") == 1) / F.count(F.lit(1))).alias("pct_unique"), (100.0 * F.count_if(F.col("n") > 1) / F.count(F.lit(1))).alias("pct_ambiguous"),
    )
    return told.join(rows, "k_variables").select("k_variables", "variables", "mean_candidates", "median_candidates", "max_candidates", "pct_unique", "pct_ambiguous")


def duplicate_groups(target: DataFrame, pool: DataFrame, target_id: str, pool_id: str, variables: Sequence[str], counts: Sequence[int]) -> tuple[DataFrame, DataFrame]:
    """Which pool rows agree with which targets on the first k variables, for each k of ``counts``, as two tables.

    (target_id, k_variables, group_id, n_matching) has a row for each target that agrees with any, and (k_variables,
    group_id, pool_id) one for each row of those groups; a group is a hash of its values.  Neither grows with the
    product of a group's sides, and no group meets in one task.
    """
    group = lambda k: F.xxhash64(F.lit(k), *variables[:k])
    sound = lambda k: reduce(and_, (F.col(v).isNotNull() for v in variables[:k]))

    def keyed(table: DataFrame, name: str) -> DataFrame:
        each = F.array_compact(F.array(*(F.when(sound(k), F.struct(F.lit(k).alias("k_variables"), group(k).alias("group_id"))) for k in counts)))
        return table.select(name, F.explode(each).alias("x")).select(name, "x.*")

    members = keyed(pool, pool_id)
    sizes = members.groupBy("k_variables", "group_id").agg(F.count(F.lit(1)).alias("n_matching"))
    found = keyed(target, target_id).join(sizes, ["k_variables", "group_id"]).select(target_id, "k_variables", "group_id", "n_matching")
    asked = found.select("k_variables", "group_id").distinct()
    return found, members.join(asked, ["k_variables", "group_id"]).select("k_variables", "group_id", pool_id)


def duplicate_detail(target: DataFrame, pool: DataFrame, target_id: str, pool_id: str, variables: Sequence[str], counts: Sequence[int]) -> DataFrame:
    """(target_id, k_variables, n_matching, matching_ids): ids of agreeing pool rows, joined by ``;`` in order of their text.

    A row holds all ids of its group, once for each target; for groups without a bound take ``duplicate_groups``.
    """
    found, members = duplicate_groups(target, pool, target_id, pool_id, variables, counts)
    ids = members.groupBy("k_variables", "group_id").agg(F.array_join(F.array_sort(F.collect_list(F.col(pool_id).cast("string"))), ";").alias("matching_ids"))
    return found.join(ids, ["k_variables", "group_id"]).select(target_id, "k_variables", "n_matching", "matching_ids")


def scenario_accuracy(results: DataFrame) -> DataFrame:
    """(scenario, n, correct, flagged, wrong_flagged, no_match) of results with scenario, matched, truth, flags and no_match."""
    right = F.coalesce(F.col("matched") == F.col("truth"), F.lit(False))
    flagged = F.col("flags") != ""
    return results.groupBy("scenario").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(right).alias("correct"), F.count_if(flagged).alias("flagged"), F.count_if(~right & flagged).alias("wrong_flagged"), F.count_if("no_match").alias("no_match")
    )


def scenario_summary(results: DataFrame) -> DataFrame:
    """(scenario, n, pct_exact, pct_fuzzy, pct_correct_top1) of results with scenario, matched, truth and best_distance.

    Exact matches have distance 0, fuzzy ones a greater; rows without a match are neither.
    """

    def share(hit: Column) -> Column:
        return 100.0 * F.count_if(hit) / F.count(F.lit(1))

    distance = F.col("best_distance")
    right = F.coalesce(F.col("matched") == F.col("truth"), F.lit(False))
    return results.groupBy("scenario").agg(F.count(F.lit(1)).alias("n"), share(distance == 0).alias("pct_exact"), share(distance > 0).alias("pct_fuzzy"), share(right).alias("pct_correct_top1"))


def floor_failures(accuracy: DataFrame) -> list[str]:
    """What of ``scenario_accuracy`` is below its floor; measures without rows are passed over."""
    rows = {r["scenario"]: r for r in accuracy.collect()}  # a row a scenario

    def share(a: float, b: float) -> float | None:
        return a / b if b else None

    def of(name: str) -> float | None:
        return share(rows[name]["correct"], rows[name]["n"]) if name in rows else None

    n, correct, wrong_flagged = (sum(r[k] for r in rows.values()) for k in ("n", "correct", "wrong_flagged"))
    figures = {"clean_accuracy": of("clean"), "duplicate_group_accuracy": of("duplicate_group"), "missing_one_accuracy": of("missing_one"), "overall_accuracy": share(correct, n), "wrong_flagged_rate": share(wrong_flagged, n - correct)}
    # Fixed text: reports are compared by it.
    found = [f"{k} = {v:.3f} below floor {FLOORS[k]}" for k, v in figures.items() if v is not None and v < FLOORS[k]]
    empty = rows.get("missing_all")
    if empty and empty["no_match"] != empty["n"]:
        found.append(f"missing_all: {empty['no_match']}/{empty['n']} rows are no-match; every one must be")
    return found


def hashed_normal(key: Column, stream: str) -> Column:
    """Standard normal noise that depends on a key alone: two uniform numbers from its hash, by Box and Muller's rule."""

    def uniform(part: str) -> Column:
        head = F.substring(F.md5(F.concat(key.cast("string"), F.lit(f":{stream}:{part}"))), 1, 8)
        return (F.conv(head, 16, 10).cast("double") + 0.5) / float(1 << 32)

    return F.sqrt(F.lit(-2.0) * F.log(uniform("a"))) * F.cos(F.lit(2 * math.pi) * uniform("b"))


def perturbed(table: DataFrame, columns: Sequence[str], level: float, seed: int = 42, key: str | None = None) -> DataFrame:
    """Numeric columns with normal noise of ``level`` times their population deviation, to four places; nulls stay.

    With a ``key`` column a row has the same noise in every run; without one it is random.
    """
    spread = table.agg(*(F.stddev_pop(c).alias(c) for c in columns)).first()  # a number a column
    noise = [F.randn(seed + k) if key is None else hashed_normal(F.col(key), f"{seed}:{k}") for k in range(len(columns))]
    return table.withColumns({c: F.round(F.col(c) + F.lit(level * (spread[c] or 1.0)) * noise[k], 4) for k, c in enumerate(columns)})


def numeric_columns(table: DataFrame, without: Sequence[str] = ()) -> list[str]:
    """Columns, but those named in ``without``, whose every cell is a number; a blank cell is none."""
    columns = [c for c in table.columns if c.strip() not in {w.strip() for w in without}]
    if not columns:
        return []
    other = [F.count_if(F.coalesce(cleaning.clean_value(F.col(f"`{c}`").cast("string")).isNull(), F.lit(True))).alias(f"c{k}") for k, c in enumerate(columns)]
    row = table.agg(*other).first()  # a number a column
    return [c for k, c in enumerate(columns) if row[f"c{k}"] == 0]


def write_perturbed(table: DataFrame, folder: str, id_column: str, levels: Sequence[float] = (0.1, 0.25, 0.5), seed: int = 42) -> list[str]:
    """A folder of CSV for each level of noise on all numeric columns but the id; gives their paths."""
    columns = numeric_columns(table, [id_column])
    numbers = table.withColumns({c: cleaning.clean_value(F.col(f"`{c}`").cast("string")) for c in columns})
    paths = []
    for level in levels:
        paths.append(f"{folder.rstrip('/')}/noise_{round(level * 100):03d}pct")
        write_csv(perturbed(numbers, columns, level, seed, id_column), paths[-1])
    return paths
