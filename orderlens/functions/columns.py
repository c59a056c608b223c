"""Column expressions for cleaning raw codes, flags, dates and amounts."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def resolve_column(df: DataFrame, candidates: Iterable[str], dtype: str = "string") -> Column:
    """First candidate the frame has, else a typed NULL."""
    for name in candidates:
        if name in df.columns:
            return F.col(name)
    return F.lit(None).cast(dtype)


def lookup(key: str | Column, mapping: Mapping, default=None) -> Column:
    """Small literal map as a CASE expression."""
    key = col(key)
    out = None
    for k, v in mapping.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    if out is None:
        return F.lit(default)
    return out if default is None else out.otherwise(default if isinstance(default, Column) else F.lit(default))


def parse_zip(raw: str | Column) -> Column:
    text = F.regexp_replace(F.trim(col(raw)), r"\.0$", "")
    digits = F.regexp_replace(text, "[^0-9]", "")
    return (
        F.when(F.lower(text).isin("nan", "none", "nat", "null", ""), F.lit(None))
        .when(F.length(digits) == 4, F.lpad(digits, 5, "0"))
        .when(F.length(digits).isin(5, 9), digits)
    )


def clean_state(raw: str | Column) -> Column:
    code = F.upper(F.trim(col(raw)))
    return F.when(code.rlike("^[A-Z]{2}$"), code)


# Spellings of a true and a false flag.
TRUE_WORDS = ("Y", "1", "TRUE", "T", "YES")
FALSE_WORDS = ("N", "0", "FALSE", "F", "NO")


def flag_to_yn(raw: str | Column) -> Column:
    word = F.upper(F.trim(col(raw)))
    return F.when(word.isin(*TRUE_WORDS), "Y").when(word.isin(*FALSE_WORDS), "N")


def flag_to_int(raw: str | Column) -> Column:
    return F.coalesce(F.upper(F.trim(col(raw))).isin(*TRUE_WORDS).cast("int"), F.lit(0))


def valid_code(raw: str | Column, allowed: Iterable) -> Column:
    c = col(raw)
    return F.when(c.isin(*allowed), c)


def date_parts(date_id: str | Column) -> dict[str, Column]:
    d = col(date_id).cast("bigint")
    return {
        "order_year": F.floor(d / 10000).cast("int"),
        "order_month": (F.floor(d / 100) % 100).cast("int"),
        "order_day": (d % 100).cast("int"),
    }


def try_date(date_id: str | Column) -> Column:
    return F.try_to_date(F.lpad(col(date_id).cast("string"), 8, "0"), "yyyyMMdd")


def flag(condition: Column) -> Column:
    """1 where the condition holds, 0 where it is false or NULL."""
    return F.coalesce(condition.cast("int"), F.lit(0))


def share(part: str | Column, whole: str | Column, digits: int = 6) -> Column:
    return F.round(F.try_divide(col(part).cast("double"), col(whole).cast("double")), digits)


def half_up(c: str | Column, digits: int = 2) -> Column:
    """Decimal rounding: binary noise past the 8th place goes first, then half up."""
    return F.round(F.round(col(c), 8), digits)


def clip(c: str | Column, low: float | None = None, high: float | None = None) -> Column:
    out = col(c)
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return out


def bands(c: str | Column, steps: list[tuple[float, str]], last: str) -> Column:
    """Step function: the label of the first upper bound (exclusive) the value is below."""
    c = col(c)
    out = None
    for bound, label in steps:
        cond = c < bound
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise(last)
