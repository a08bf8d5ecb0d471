"""Comparison-friendly projection of result columns (used by the query registry).

Rules (identical in the oracle SQL): money 2 dp, ratios/std ``round(x + 1e-9, 4)``, rolling means
6 dp, other means ``round(x + 1e-7, 2)``, integers BIGINT.  The library itself
keeps unrounded values; rounding happens only in this last projection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULES = {
    "money": lambda c: F.round(c, 2),
    "ratio": lambda c: F.round(c + F.lit(1e-9), 4),
    "roll": lambda c: F.round(c, 6),
    "mean": lambda c: F.round(c + F.lit(1e-7), 2),
    "int": lambda c: c.cast("bigint"),
}


def present(df: DataFrame, spec: dict[str, str], order: list[str] | None = None) -> DataFrame:
    cols = order or df.columns
    return df.select(*[RULES[spec[c]](F.col(c)).alias(c) if c in spec else F.col(c) for c in cols])


def sql_rule(rule: str, expr: str) -> str:
    return {
        "money": f"round({expr}, 2)",
        "ratio": f"round({expr} + 1e-9, 4)",
        "roll": f"round({expr}, 6)",
        "mean": f"round({expr} + 1e-7, 2)",
        "int": f"CAST({expr} AS BIGINT)",
    }[rule]


def sql_select(spec: dict[str, str], cols: list[str], src: str = "") -> str:
    pre = f"{src}." if src else ""
    return ", ".join(f"{sql_rule(spec[c], pre + c)} AS {c}" if c in spec else f"{pre}{c}" for c in cols)
