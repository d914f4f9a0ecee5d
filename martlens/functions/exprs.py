"""Column expressions that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rint(x: Column, places: int = 2) -> Column:
    """Half-even rounding of the scaled double, as rint(x * 10^n) / 10^n."""
    k = float(10**places)
    return F.rint(x * F.lit(k)) / F.lit(k)


def money_sum(x: Column | str) -> Column:
    """An exact sum of amounts with two decimals; 0 for no rows. Doubles would depend on the order of rows."""
    c = F.col(x) if isinstance(x, str) else x
    return F.coalesce(F.sum(c.cast("decimal(18,2)")), F.lit(0)).cast("double")


def date_key(d: Column) -> Column:
    return (F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)).cast("long")


def month_index(d: Column) -> Column:
    return F.year(d) * 12 + F.month(d)


def clip(x: Column, low: float | int, high: float | int) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def bands(x: Column, edges: list[tuple[float, str]], other: str) -> Column:
    """Right-closed bands: the label of the first edge that x does not exceed."""
    out = None
    for top, label in edges:
        out = F.when(x <= top, label) if out is None else out.when(x <= top, label)
    return out.otherwise(other)


def short_scale(x: Column) -> Column:
    """Thousand, lakh and crore as K, L and Cr with two decimals."""
    out = None
    for base, label in ((1e7, "Cr"), (1e5, "L"), (1e3, "K")):
        text = F.concat(F.format_string("%.2f", x / base), F.lit(f" {label}"))
        out = F.when(F.abs(x) >= base, text) if out is None else out.when(F.abs(x) >= base, text)
    return out.otherwise(F.format_string("%.0f", x))


def on_days(df: DataFrame, since: str | Column | None = None, until: str | Column | None = None, column: str = "date", month: str = "year_month") -> DataFrame:
    """The rows of the days from since to until, both included where given.

    Where df knows its rows' months, text as yyyy-MM, the bounds also hold for these; on a table that is partitioned by
    month they leave only its folders of these months. No row is lost: a day in the range has its month in the range.
    """
    for bound, keeps in ((since, lambda x, y: x >= y), (until, lambda x, y: x <= y)):
        if bound is None:
            continue
        day = F.lit(bound).cast("date") if isinstance(bound, str) else bound
        df = df.filter(keeps(F.col(column), day))
        if month in df.columns:
            df = df.filter(keeps(F.col(month), F.date_format(day, "yyyy-MM")))
    return df
