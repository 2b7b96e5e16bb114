"""Column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BERLIN = "Europe/Berlin"


def title_case(column: Column) -> Column:
    """Upper-case the first letter of every run of letters, lower-case the rest."""
    runs = F.regexp_extract_all(column, F.lit(r"([\p{Lu}\p{Ll}\p{Lt}]+|[^\p{Lu}\p{Ll}\p{Lt}]+)"))
    cased = F.transform(runs, lambda run: F.concat(F.upper(F.substring(run, 1, 1)), F.lower(F.substr(run, F.lit(2)))))
    return F.array_join(cased, "")


def local_to_utc(text: Column, zone: str = BERLIN, fmt: str = "d.M.yyyy, H:m:s") -> Column:
    """Local wall-clock text to UTC; null when it cannot be read."""
    return F.to_utc_timestamp(F.try_to_timestamp(F.trim(text), F.lit(fmt)), zone)


def clock_change(text: Column, zone: str = BERLIN, fmt: str = "d.M.yyyy, H:m:s") -> Column:
    """Whether the local time happens twice or not at all because the clock is changed."""
    local = F.try_to_timestamp(F.trim(text), F.lit(fmt))
    utc = F.to_utc_timestamp(local, zone)
    hour = F.expr("INTERVAL 1 HOUR")
    twice = (F.from_utc_timestamp(utc + hour, zone) == local) | (F.from_utc_timestamp(utc - hour, zone) == local)
    return twice | (F.from_utc_timestamp(utc, zone) != local)


def downtime_seconds(text: Column) -> Column:
    """``HH:MM:SS`` to seconds; null unless there are three numeric parts."""
    parts = F.split(F.trim(text), ":")
    number = lambda i: F.get(parts, i).try_cast("double")
    return F.when(F.size(parts) == 3, number(0) * 3600 + number(1) * 60 + number(2))


def floor_to(value: Column, step: int) -> Column:
    """Largest multiple of ``step`` at or below an integer; exact, also before 1970."""
    return value - F.pmod(value, F.lit(step))


def finite(column: Column) -> Column:
    """Neither null, NaN nor infinite."""
    return column.isNotNull() & ~F.isnan(column) & (F.abs(column) != F.lit(float("inf")))


def numeric_columns(df: DataFrame, exclude: list[str] | tuple[str, ...] = ()) -> list[str]:
    """Numeric columns that are not excluded, in schema order."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def feature_columns(df: DataFrame, exclude: list[str] | tuple[str, ...] = ()) -> list[str]:
    """All columns that are not excluded, in schema order."""
    return [c for c in df.columns if c not in exclude]


def column_intersection(df: DataFrame, wanted: list[str]) -> tuple[list[str], list[str]]:
    """Wanted columns that exist, and those that are missing."""
    have = set(df.columns)
    return [c for c in wanted if c in have], [c for c in wanted if c not in have]


def unpivoted(row: DataFrame, columns: list[str], statistics: list[str]) -> DataFrame:
    """One-row aggregate with columns ``<statistic>__<column>`` to one row per column."""
    entries = [
        F.struct(F.lit(c).alias("column"), *[F.col(f"`{s}__{c}`").alias(s) for s in statistics]) for c in columns
    ]
    return row.select(F.inline(F.array(*entries)))


def digamma(n: Column) -> Column:
    """The digamma function of a positive number: its asymptotic series ten further on, less the steps back."""
    x = n.cast("double") + 10
    far = F.log(x) - 1 / (2 * x) - 1 / (12 * x**2) + 1 / (120 * x**4) - 1 / (252 * x**6)
    return far - sum((1 / (n + i) for i in range(1, 10)), 1 / n.cast("double"))
