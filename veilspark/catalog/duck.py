"""Pieces of DuckDB SQL that several twins share."""

from __future__ import annotations

from collections.abc import Sequence

# (name, is it numeric)
FieldList = Sequence[tuple[str, bool]]


def similarity(field: tuple[str, bool], left: str = "l", right: str = "r") -> str:
    name, numeric = field
    a, b = f"{left}.{name}", f"{right}.{name}"
    if numeric:
        return f"coalesce(greatest(0e0, 1e0 - abs({a}::DOUBLE - {b}::DOUBLE) / 2e0), 0e0)"
    a, b = f"{a}::VARCHAR", f"{b}::VARCHAR"
    return (
        f"CASE WHEN {a} IS NULL OR {b} IS NULL OR length({a}) + length({b}) = 0 THEN 0e0 WHEN {a} = {b} THEN 1e0 "
        f"WHEN greatest(length({a}), length({b})) < 10 THEN 0e0 "
        f"WHEN 1e0 - levenshtein({a}, {b})::DOUBLE / greatest(length({a}), length({b})) >= 0.9e0 THEN 1e0 ELSE 0e0 END"
    )


def score(fields: FieldList) -> str:
    return "round(" + " + ".join(similarity(f) for f in fields) + ", 9)"


def pairs(left: str, right: str, fields: FieldList, on: str, min_score: float, carried: str) -> str:
    """Linked pairs of two tables; ``carried`` lists the columns to keep."""
    return (
        f"SELECT * FROM (SELECT {carried}, {score(fields)} AS similarity FROM {left} l JOIN {right} r ON {on}) "
        f"WHERE similarity > 1 AND similarity >= {min_score}"
    )


def rl(left: str, right: str, fields: FieldList, on: str, min_score: float, key: str) -> str:
    """Share of ``left`` rows with exactly one link, as a scalar query."""
    linked = pairs(left, right, fields, on, min_score, f"l.{key} AS k")
    return (
        f"SELECT 100e0 * count(*) FILTER (c = 1) / nullif((SELECT count(*) FROM {left}), 0) "
        f"FROM (SELECT k, count(*) AS c FROM ({linked}) GROUP BY k)"
    )


def cardinality_rows(source: str, cols: Sequence[str]) -> str:
    """One row per column: position, name, distinct values, rows."""
    counts = ", ".join(f"count(DISTINCT {c}) AS d{i}" for i, c in enumerate(cols))
    rows = " UNION ALL ".join(
        f"SELECT {i} AS pos, '{c}' AS col, d{i} AS d, n FROM s" for i, c in enumerate(cols)
    )
    return f"WITH s AS (SELECT count(*) AS n, {counts} FROM {source}) {rows}"


def block_choice(source: str, cols: Sequence[str]) -> str:
    """One row ``(blk, d)``: name and cardinality of the blocking column."""
    return (
        f"WITH u AS ({cardinality_rows(source, cols)}), w AS (SELECT CASE "
        "WHEN max(d) >= 0.85e0 * max(n) AND count(DISTINCT d) > 1 "
        "THEN coalesce(max(CASE WHEN d < 0.85e0 * n THEN d END), min(d)) ELSE max(d) END AS want FROM u) "
        "SELECT arg_min(col, pos) AS blk, min(d) AS d FROM u, w WHERE d = want"
    )


def searched_block(name: str, source: str, cols: Sequence[str]) -> str:
    """Common table expressions ``<name>_b`` (choice) and ``<name>_k`` (rows with block value)."""
    pick = " ".join(f"WHEN '{c}' THEN {c}::VARCHAR" for c in cols)
    return (
        f"{name}_b AS ({block_choice(source, cols)}), "
        f"{name}_l AS (SELECT t.*, CASE b.blk {pick} END AS blk_value FROM {source} t, {name}_b b)"
    )


def searched_rl(name: str, left: str, right: str, fields: FieldList, min_score: float, key: str) -> str:
    """``<name>_rl``: risk with the block chosen from ``left``; 0 for a one-valued block.

    ``right`` must hold the fields in the types of ``left``.
    """
    cols = [f for f, _ in fields]
    pick = " ".join(f"WHEN '{c}' THEN {c}::VARCHAR" for c in cols)
    risk = rl(f"{name}_l", f"{name}_r", fields, "l.blk_value = r.blk_value", min_score, key)
    return (
        f"{searched_block(name, left, cols)}, "
        f"{name}_r AS (SELECT t.*, CASE b.blk {pick} END AS blk_value FROM {right} t, {name}_b b), "
        f"{name}_rl AS (SELECT blk, CASE WHEN d = 1 THEN 0e0 ELSE ({risk}) END AS risk FROM {name}_b)"
    )


def round_to(col: str, base: float) -> str:
    return f"(round_even({col}::DOUBLE / {base!r}::DOUBLE, 0) * {base!r}::DOUBLE + 0e0)"


def recode(col: str, low: str, width: str) -> str:
    """Left edge of the bin, in integer arithmetic."""
    return (
        f"CASE WHEN {col} <= {low} THEN {low} "
        f"ELSE {low} + ({col} - {low} - 1) - (({col} - {low} - 1) % {width}) END"
    )


def uniform(seed: str, *keys: str) -> str:
    text = ", ".join([f"'{seed}'", *[f"{k}::VARCHAR" for k in keys]])
    return f"((('0x' || substr(md5(concat_ws('|', {text})), 1, 13))::BIGINT::DOUBLE + 0.5e0) / 4503599627370496e0 - 0.5e0)"


def laplace(value: str, diameter: str, epsilon: float, u: str) -> str:
    return f"({value} - {diameter} / {epsilon!r}::DOUBLE * sign({u}) * ln(1e0 - 2e0 * abs({u})) + 0e0)"
