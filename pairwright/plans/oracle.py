"""SQL twins of the linkage queries, put together from common table expressions."""

from __future__ import annotations

from ..functions import signals
from ..operators.blocks import sum_terms

_TABLES = {
    "accounts": (
        "SELECT c_custkey AS idx, CASE WHEN c_custkey % 11 = 0 OR c_custkey % 19 = 0 THEN NULL ELSE CAST(c_acctbal AS DOUBLE) END AS f0, CASE WHEN c_custkey % 13 = 0 OR c_custkey % 19 = 0 THEN NULL ELSE CAST(c_nationkey AS DOUBLE) END AS f1 FROM customer",
        "SELECT s_suppkey AS idx, CASE WHEN s_suppkey % 17 = 0 THEN NULL ELSE CAST(s_acctbal AS DOUBLE) END AS f0, CAST(s_nationkey AS DOUBLE) AS f1 FROM supplier",
        ["balance", "nation"],
    ),
    "nations": ("SELECT c_custkey AS idx, CASE WHEN c_custkey % 23 = 0 THEN NULL ELSE CAST(c_nationkey AS DOUBLE) * c_nationkey * c_nationkey END AS f0 FROM customer", "SELECT s_suppkey AS idx, CAST(s_nationkey AS DOUBLE) * s_nationkey * s_nationkey AS f0 FROM supplier", ["nation"]),
    "overlap": (
        "SELECT c_custkey AS idx, CAST(floor(CAST(c_acctbal AS DOUBLE) / 100e0) * 100 AS DOUBLE) + 0.3333e0 AS f0, CAST(c_nationkey AS DOUBLE) AS f1 FROM customer",
        "SELECT c_custkey AS idx, CAST(c_acctbal AS DOUBLE) AS f0, CAST(c_nationkey AS DOUBLE) AS f1 FROM customer",
        ["balance", "nation"],
    ),
    "profiles": (
        "SELECT o_custkey AS idx, CAST(count(*) AS DOUBLE) AS f0, round(max(o_totalprice), 2) AS f1 FROM orders GROUP BY o_custkey",
        "SELECT l_suppkey AS idx, CAST(count(*) AS DOUBLE) AS f0, round(max(l_extendedprice), 2) AS f1 FROM lineitem GROUP BY l_suppkey",
        ["count", "largest"],
    ),
    "vectors": (
        "SELECT vec_id AS idx, " + ", ".join(f"CAST(embedding[{k + 1}] AS DOUBLE) AS f{k}" for k in range(64)) + " FROM embeddings WHERE vec_id % 2 = 0",
        "SELECT vec_id AS idx, " + ", ".join(f"CAST(embedding[{k + 1}] AS DOUBLE) AS f{k}" for k in range(64)) + " FROM embeddings WHERE vec_id % 2 = 1",
        [f"d{k}" for k in range(64)],
    ),
}


def _noise(stream: str) -> str:
    """Normal noise from the hash of a supplier's key, as ``candidates.hashed_normal`` has it."""
    u = [f"((CAST('0x' || substr(md5(CAST(s_suppkey AS VARCHAR) || ':{stream}:{part}'), 1, 8) AS BIGINT) + 0.5e0) / 4294967296e0)" for part in "ab"]
    return f"sqrt(-2e0 * ln({u[0]})) * cos(2e0 * pi() * {u[1]})"


LEVELS = (0.1, 0.25, 0.5)
for _level in LEVELS:
    _TABLES[f"noise {_level}"] = (
        f"SELECT s_suppkey AS idx, round(s_acctbal + {_level}e0 * d0 * ({_noise('42:0')}), 4) AS f0, round(CAST(s_nationkey AS DOUBLE) + {_level}e0 * d1 * ({_noise('42:1')}), 4) AS f1 "
        "FROM supplier, (SELECT stddev_pop(s_acctbal) AS d0, stddev_pop(CAST(s_nationkey AS DOUBLE)) AS d1 FROM supplier)",
        "SELECT s_suppkey AS idx, CAST(s_acctbal AS DOUBLE) AS f0, CAST(s_nationkey AS DOUBLE) AS f1 FROM supplier",
        ["balance", "nation"],
    )


for _left_out, _own in ((0, "f1"), (1, "f0")):
    _TABLES[f"overlap without {_TABLES['overlap'][2][_left_out]}"] = (
        *(f"SELECT idx, {_own} AS f0 FROM ({side})" for side in _TABLES["overlap"][:2]),
        [_TABLES["overlap"][2][1 - _left_out]],
    )


BY_CORRELATION = " by correlation"


class _Sum(str):
    """A term of a sum, in parentheses, so that the order of additions is kept."""

    def __add__(self, other: str) -> _Sum:
        return _Sum(f"({str(self)} + {str(other)})")


def names(fixture: str) -> list[str]:
    return _TABLES[fixture.removesuffix(BY_CORRELATION)][2]


def _rounded(x: str, size: str) -> str:
    """A figure to 31 binary places of its size, as ``standardize.rounded`` has it."""
    return f"round({x} / pow(2e0, floor(log2({size})) - 30)) * pow(2e0, floor(log2({size})) - 30)"


def base(fixture: str) -> str:
    """WITH t, s (raw features), b (pooled figures, to 31 binary places, so that no order of additions decides ties), tz, sz (standardized), p (pairs).

    A fixture "x by correlation" is x with two features, the second turned by what the first tells.
    """
    name, turned = fixture.removesuffix(BY_CORRELATION), fixture.endswith(BY_CORRELATION)
    target, supplemental, features = _TABLES[name]
    d = range(len(features))
    z = ", ".join(f"(f{k} - m{k}) / v{k} AS z{k}" for k in d)
    terms = [_Sum(f"coalesce((a.z{k} - c.z{k}) * (a.z{k} - c.z{k}), 2.0e0)") for k in d]
    seen = " OR ".join(f"(a.z{k} IS NOT NULL AND c.z{k} IS NOT NULL)" for k in d)
    pooled = ", ".join(f"coalesce(avg(f{k}), 0e0) AS m{k}, CASE WHEN coalesce(stddev_pop(f{k}), 0e0) = 0 OR min(f{k}) = max(f{k}) THEN 1e0 ELSE stddev_pop(f{k}) END AS v{k}" for k in d)
    told = ", ".join(f"{_rounded(f'm{k}', f'greatest(abs(m{k}), v{k})')} AS m{k}, {_rounded(f'v{k}', f'v{k}')} AS v{k}" for k in d)
    own = ("tu", "su") if turned else ("tz", "sz")
    turn = ""
    if turned:
        turn = "rho AS (SELECT avg(z0 * z1) AS r FROM (SELECT z0, z1 FROM tu UNION ALL SELECT z0, z1 FROM su) AS u), "
        turn += ", ".join(f"{a} AS (SELECT idx, z0, CASE WHEN z0 IS NULL THEN z1 ELSE (z1 - r * z0) / sqrt(1e0 - r * r) END AS z1 FROM {b}, rho)" for a, b in (("tz", "tu"), ("sz", "su"))) + ", "
    return (
        f"WITH t AS ({target}), s AS ({supplemental}), b0 AS (SELECT {pooled} FROM (SELECT * FROM t UNION ALL SELECT * FROM s) AS u), b AS (SELECT {told} FROM b0), "
        f"{own[0]} AS (SELECT idx, {z} FROM t, b), {own[1]} AS (SELECT idx, {z} FROM s, b), {turn}"
        f"p AS (SELECT a.idx AS ti, c.idx AS si, CASE WHEN {seen} THEN sqrt({sum_terms(terms)}) END AS d FROM tz AS a, sz AS c)"
    )


def matched(fixture: str, threshold: float = 0.8) -> str:
    """``base`` and m: the figures of each target's match."""
    return (
        base(fixture) + ", p1 AS (SELECT ti, min(d) AS d1 FROM p GROUP BY ti), "
        "p2 AS (SELECT p.ti, d1, min(CASE WHEN d = d1 THEN si END) AS mi, count(CASE WHEN d = d1 THEN 1 END) AS repeats, min(CASE WHEN d > d1 THEN d END) AS further, "
        f"count(CASE WHEN d1 > 0 AND d > 0 AND d1 / nullif(d, 0e0) >= {threshold}e0 THEN 1 END) AS near FROM p JOIN p1 ON p.ti = p1.ti GROUP BY p.ti, d1), "
        "r1 AS (SELECT si, min(d) AS rd FROM p GROUP BY si), r AS (SELECT p.si, rd, count(CASE WHEN d = rd THEN 1 END) AS rn FROM p JOIN r1 ON p.si = r1.si GROUP BY p.si, rd), "
        "q AS (SELECT ti, d1, mi, repeats, CASE WHEN repeats >= 2 THEN d1 ELSE further END AS d2, near FROM p2), "
        "m AS (SELECT ti AS target_idx, mi AS match_idx, d1 IS NULL AS no_match, d1 AS best_distance, d2 AS second_distance, repeats, "
        "CASE WHEN d1 IS NULL THEN 1e0 WHEN d2 IS NULL THEN 0e0 WHEN d1 = 0 THEN CASE WHEN d2 = 0 THEN 1e0 ELSE 0e0 END ELSE d1 / nullif(d2, 0e0) END AS nndr, "
        "CASE WHEN d1 IS NULL OR d2 IS NULL THEN 0 WHEN d1 = 0 THEN repeats - 1 ELSE near - 1 END AS near_miss, "
        "coalesce(d1 = rd, false) AS mnn_confirmed, coalesce(rn, 0) AS reverse_repeat_count FROM q LEFT JOIN r ON q.mi = r.si)"
    )


def judged(fixture: str, threshold: float = 0.8) -> str:
    """``matched`` and g (smd by feature), h (missing counts, contributions) and j (flags)."""
    features = names(fixture)
    d = range(len(features))
    n = len(features)
    smd = " UNION ALL ".join(
        f"SELECT {k} AS k, '{features[k]}' AS feature, CASE WHEN count(*) < 2 OR count(a.z{k}) = 0 OR count(c.z{k}) = 0 OR coalesce(var_samp(a.z{k}), 0e0) + coalesce(var_samp(c.z{k}), 0e0) = 0 THEN 0e0 "
        f"ELSE abs(avg(a.z{k}) - avg(c.z{k})) / sqrt((coalesce(var_samp(a.z{k}), 0e0) + coalesce(var_samp(c.z{k}), 0e0)) / 2e0) END AS smd FROM m JOIN tz AS a ON a.idx = m.target_idx JOIN sz AS c ON c.idx = m.match_idx"
        for k in d
    )
    terms = [_Sum(f"coalesce((a.z{k} - c.z{k}) * (a.z{k} - c.z{k}), 2.0e0)") for k in d]
    shares = ", ".join(f"CASE WHEN m.no_match THEN 0e0 ELSE coalesce({terms[k]} / nullif({sum_terms(terms)}, 0e0), 0e0) END AS c{k}" for k in d)
    missing = [" + ".join(f"CASE WHEN {side}.z{k} IS NULL THEN 1 ELSE 0 END" for k in d) for side in ("a", "c")]
    poor = signals.POOR_BALANCE.replace("{features}", "' || x || '")
    warned = signals.IMBALANCE.replace("{features}", "' || y || '")

    def text(message: str, **columns: str) -> str:
        for name, column in columns.items():
            message = message.replace("{" + name + "}", f"' || {column} || '")
        return f"'{message}'"

    target_missing = f"CASE WHEN target_missing > 0 THEN {text(signals.TARGET_MISSING, k='target_missing', n=str(n))} END"
    hundredfold = f"(CAST(nndr * {2.0**56:.0f}e0 AS BIGINT) * 100)"  # exact, as in signals.two_places
    whole, rest = f"({hundredfold} // {1 << 56})", f"({hundredfold} % {1 << 56})"
    hundredths = f"({whole} + CASE WHEN {rest} > {1 << 55} OR ({rest} = {1 << 55} AND {whole} % 2 = 1) THEN 1 ELSE 0 END)"
    ratio = f"({hundredths} // 100) || '.' || lpad(CAST({hundredths} % 100 AS VARCHAR), 2, '0')"
    ambiguous = text(signals.AMBIGUOUS.replace("{threshold:.2f}", f"{threshold:.2f}"), nndr=ratio)
    flags = (
        f"CASE WHEN no_match THEN concat_ws(' | ', '{signals.NO_MATCH}', {target_missing}) ELSE concat_ws(' | ', CASE WHEN nndr >= {threshold}e0 THEN {ambiguous} END, "
        f"CASE WHEN near_miss > 0 THEN {text(signals.NEAR_MISS, n='near_miss')} END, CASE WHEN repeats > 1 THEN {text(signals.TIES, n='repeats')} END, CASE WHEN NOT mnn_confirmed THEN '{signals.NOT_MUTUAL}' END, {target_missing}, "
        f"CASE WHEN match_missing > 0 THEN {text(signals.MATCH_MISSING, k='match_missing', n=str(n))} END, CASE WHEN x IS NOT NULL THEN '{poor}' END, CASE WHEN y IS NOT NULL THEN '{warned}' END) END"
    )
    return (
        matched(fixture, threshold) + f", g AS ({smd}), h AS (SELECT m.*, {missing[0]} AS target_missing, CASE WHEN m.no_match THEN NULL ELSE {missing[1]} END AS match_missing, {shares} "
        "FROM m JOIN tz AS a ON a.idx = m.target_idx LEFT JOIN sz AS c ON c.idx = m.match_idx), "
        "w AS (SELECT string_agg(CASE WHEN smd > 0.25e0 THEN feature END, ', ' ORDER BY k) AS x, string_agg(CASE WHEN smd > 0.10e0 AND smd <= 0.25e0 THEN feature END, ', ' ORDER BY k) AS y FROM g), "
        f"j AS (SELECT h.*, {flags} AS flags FROM h, w)"
    )
