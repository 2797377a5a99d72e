"""Validation inside a plan: rows that break a rule raise an error."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(column: Column) -> Column:
    """True for numbers that are neither NaN nor infinite; Spark orders NaN
    above all numbers, so a range test alone would not do."""
    value = column.cast("double")
    return ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))


def require(rule: Column, value: Column, message: str) -> Column:
    """``value`` where ``rule`` holds; elsewhere, null included, an error."""
    return F.when(rule, value).otherwise(F.raise_error(F.lit(message)))


def require_rows(df: DataFrame, rule: Column, message: str) -> DataFrame:
    """``df``, which fails on the first row that breaks ``rule``."""
    return df.filter(F.when(rule, True).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def require_any(df: DataFrame, message: str) -> DataFrame:
    """``df``; raises now if it has no rows."""
    if df.isEmpty():
        raise ValueError(message)
    return df


def positive(name: str, value: float) -> float:
    """A parameter that must be a finite number above 0."""
    if not math.isfinite(value) or value <= 0:
        raise ValueError(f"{name} must be finite and above 0, not {value}")
    return float(value)
