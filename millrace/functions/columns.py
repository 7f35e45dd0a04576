"""Column expressions that fix one meaning of missing, numeric and bounded values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLOATS = (T.DoubleType, T.FloatType)


def numeric_columns(df: DataFrame, *, with_bool: bool = False) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) or with_bool and isinstance(f.dataType, T.BooleanType)]


def is_float(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, FLOATS)


def value(df: DataFrame, name: str) -> Column:
    """The column, NaN read as null."""
    c = F.col(f"`{name}`")
    return F.when(~F.isnan(c), c) if is_float(df, name) else c


def is_missing(df: DataFrame, name: str) -> Column:
    return value(df, name).isNull()


def number(c: Column, fill: float | None = 0.0) -> Column:
    """The value as a double; what is no number, or missing, becomes ``fill``."""
    d = c.try_cast("double")
    d = F.when(~F.isnan(d), d)
    return d if fill is None else F.coalesce(d, F.lit(float(fill)))


def finite(c: Column) -> Column:
    """The value if it is a finite number, else null."""
    return F.when(~F.isnan(c) & (F.abs(c) < float("inf")), c)


def clip(c: Column, lo: float | None, hi: float | None) -> Column:
    """Nulls stay null; greatest and least alone would return the bound for them."""
    out = c
    if lo is not None:
        out = F.when(out < lo, F.lit(lo)).otherwise(out)
    if hi is not None:
        out = F.when(out > hi, F.lit(hi)).otherwise(out)
    return out


def text_of(df: DataFrame, name: str, missing: str = "None") -> Column:
    """A category as text; missing values are a category of their own."""
    return F.coalesce(value(df, name).cast("string"), F.lit(missing))


def dates(c: Column, name: str) -> dict[str, Column]:
    """Year, month, day, weekday (Monday 0), quarter, weekend; 0 where the value is no date."""
    t = c.try_cast("timestamp")
    zero = lambda x: F.coalesce(x, F.lit(0)).cast("int")
    return {f"{name}_year": zero(F.year(t)), f"{name}_month": zero(F.month(t)), f"{name}_day": zero(F.day(t)), f"{name}_dow": zero(F.weekday(t)), f"{name}_quarter": zero(F.quarter(t)), f"{name}_weekend": zero((F.weekday(t) >= 5).cast("int"))}
