"""Expressions that the report and the operators share; all stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "||"


def series_name(component: Column, kpi: Column) -> Column:
    return F.concat_ws(SEPARATOR, component, kpi)


def series_component(series: Column) -> Column:
    return F.substring_index(series, SEPARATOR, 1)


def series_kpi(series: Column) -> Column:
    return F.regexp_replace(series, r"^[^|]+\|\|", "")


def title_case(text: Column) -> Column:
    return F.initcap(text)


def shown(form: str, value: Column) -> Column:
    """A number in C's format; "NA" if there is none."""
    return F.when(value.isNotNull(), F.format_string(form, value)).otherwise("NA")


def percent(share: Column, digits: int = 1) -> Column:
    return shown(f"%.{digits}f%%", F.lit(100.0) * share)


def signed(value: Column) -> Column:
    return shown("%+.3f", value.cast("double"))


def interval(mid: Column, low: Column, high: Column) -> Column:
    return F.concat(shown("%.3f", mid), F.lit(" ["), shown("%.3f", low), F.lit(", "), shown("%.3f", high), F.lit("]"))


def clip(value: Column, low: float, high: float) -> Column:
    """Null stays null; NaN must be null before."""
    return F.when(value.isNotNull(), F.greatest(F.least(value, F.lit(high)), F.lit(low)))


def safe_divide(part: Column, whole: Column, otherwise: float = 0.0) -> Column:
    return F.when(whole != 0, part / whole).otherwise(F.lit(otherwise))


def number_or_zero(value: Column) -> Column:
    """NaN, infinities and null become 0."""
    bad = F.isnan(value) | value.isNull() | (F.abs(value) == float("inf"))
    return F.when(bad, 0.0).otherwise(value)


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def array_median(values: Column) -> Column:
    """Median of an array's non-null numbers."""

    def middle(s: Column) -> Column:
        n = F.size(s)
        return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)

    return F.transform(F.array(F.array_sort(F.filter(values, lambda x: x.isNotNull()))), middle)[0]


def floor_div(a: Column, b: int) -> Column:
    """Division rounded down, also for negative numbers."""
    return F.floor(a / b).cast("long")


def draw(*parts: Column | int) -> Column:
    """A number below 2**48 by a hash of the parts (as texts), the same in any SQL engine that knows MD5."""
    texts = [F.lit(p).cast("string") if isinstance(p, int) else p.cast("string") for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("/", *texts)), 1, 12), 16, 10).cast("long")


def local_day(second: Column, offset: int) -> Column:
    return F.date_from_unix_date(F.floor((second + offset) / 86400).cast("int"))
