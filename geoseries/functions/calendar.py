"""Calendar columns: scaled time features, month indicators, date arithmetic."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def second_of_minute(ts: Column) -> Column:
    return F.second(ts) / F.lit(59.0) - F.lit(0.5)


def minute_of_hour(ts: Column) -> Column:
    return F.minute(ts) / F.lit(59.0) - F.lit(0.5)


def hour_of_day(ts: Column) -> Column:
    return F.hour(ts) / F.lit(23.0) - F.lit(0.5)


def day_of_week(ts: Column) -> Column:
    return F.weekday(ts) / F.lit(6.0) - F.lit(0.5)


def day_of_month(ts: Column) -> Column:
    return (F.dayofmonth(ts) - 1) / F.lit(30.0) - F.lit(0.5)


def day_of_year(ts: Column) -> Column:
    return (F.dayofyear(ts) - 1) / F.lit(365.0) - F.lit(0.5)


def month_of_year(ts: Column) -> Column:
    return (F.month(ts) - 1) / F.lit(11.0) - F.lit(0.5)


def week_of_year(ts: Column) -> Column:
    return (F.weekofyear(ts) - 1) / F.lit(52.0) - F.lit(0.5)


FEATURES = {
    "second_of_minute": second_of_minute,
    "minute_of_hour": minute_of_hour,
    "hour_of_day": hour_of_day,
    "day_of_week": day_of_week,
    "day_of_month": day_of_month,
    "day_of_year": day_of_year,
    "month_of_year": month_of_year,
    "week_of_year": week_of_year,
}

# Which features a sampling frequency gets, in this order.
_DAILY_PARTS = ["day_of_week", "day_of_month", "day_of_year"]
FREQUENCY_FEATURES = {
    "Y": [],
    "Q": ["month_of_year"],
    "M": ["month_of_year"],
    "W": ["day_of_month", "week_of_year"],
    "D": ["month_of_year", "day_of_month", "day_of_year"],
    "B": _DAILY_PARTS,
    "H": ["hour_of_day", *_DAILY_PARTS],
    "T": ["minute_of_hour", "hour_of_day", *_DAILY_PARTS],
    "S": ["second_of_minute", "minute_of_hour", "hour_of_day", *_DAILY_PARTS],
}
_ALIASES = {"A": "Y", "YE": "Y", "QE": "Q", "ME": "M", "MIN": "T"}


def frequency_features(freq: str = "D") -> list[str]:
    """Feature names for a frequency such as `D`, `12H` or `5min`."""
    parts = re.fullmatch(r"\d*([A-Za-z]+)", freq)
    unit = parts.group(1).upper() if parts else ""
    unit = _ALIASES.get(unit, unit)
    if unit not in FREQUENCY_FEATURES:
        raise ValueError(f"unsupported frequency {freq!r}; use one of {sorted(FREQUENCY_FEATURES)}")
    return FREQUENCY_FEATURES[unit]


def time_features(df: DataFrame, ts: str, freq: str = "D") -> DataFrame:
    return df.withColumns({name: FEATURES[name](F.col(ts)) for name in frequency_features(freq)})


def month_indicators(ts: Column) -> dict[str, Column]:
    """All twelve 0/1 month columns, whatever months occur in the data."""
    return {f"month_{m}": (F.month(ts) == m).cast("int") for m in range(1, 13)}


def category_indicators(value: Column, domain: range | list[int], prefix: str, with_null: bool = False) -> dict[str, Column]:
    """0/1 columns over a fixed domain; a null or unknown value sets none of them."""
    columns = {f"{prefix}_{c}": F.coalesce((value == c).cast("int"), F.lit(0)) for c in domain}
    if with_null:
        columns[f"{prefix}_nan"] = value.isNull().cast("int")
    return columns


def year_doy_date(year: Column, doy: Column) -> Column:
    return F.date_add(F.make_date(year, F.lit(1), F.lit(1)), (doy - 1).cast("int"))


def previous_day(day: Column) -> Column:
    return F.date_sub(day, 1)


def day_number(time: Column) -> Column:
    return F.datediff(F.to_date(time), F.lit("1970-01-01").cast("date"))


def month_start(time: Column) -> Column:
    return F.trunc(F.to_date(time), "month")


def next_month_start(time: Column) -> Column:
    return F.add_months(month_start(time), 1)


def month_days(time: Column) -> Column:
    """Array of all days of the month `time` falls in."""
    return F.sequence(month_start(time), F.date_sub(next_month_start(time), 1))


def year_month_label(time: Column) -> Column:
    """`2004_03`: the name a month file carries."""
    return F.concat_ws("_", F.year(time).cast("string"), F.lpad(F.month(time).cast("string"), 2, "0"))
