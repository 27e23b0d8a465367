"""Scalar column builders: safe arithmetic, flags, and text parsing.

Missing values are NULL throughout, never NaN, and a NULL comparison is False
once it becomes a flag.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Exchange of a six-digit code by its first three digits.
SHANGHAI_PREFIXES = ("600", "601", "603", "605", "688")
SHENZHEN_PREFIXES = ("000", "001", "002", "003", "300", "301")

# Accepted spellings of a boolean.
TRUE_WORDS = ("true", "1", "yes", "y")
FALSE_WORDS = ("false", "0", "no", "n")

# Words that stand for a missing code.
NULL_WORDS = ("", "nan", "none", "null")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(a: Column | str, b: Column | str) -> Column:
    """``a / b``; a zero denominator gives NULL."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


# The same arithmetic as SQL text.  Indicator pipelines project a hundred
# expressions at a time, and text is ten times cheaper to hand to the JVM than
# one Column object per operator.

def ratio(a: str, b: str) -> str:
    return f"try_divide({a}, {b})"


def change_pct(a: str, b: str) -> str:
    return f"((try_divide({a}, {b}) - 1.0D) * 100.0D)"


def ratio_or(a: str, b: str, when_zero: float) -> str:
    """``a / b`` with a fixed result for a zero denominator; NULL stays NULL."""
    return f"(CASE WHEN ({b}) = 0 THEN {float(when_zero)}D ELSE try_divide({a}, {b}) END)"


def is_true(condition: str) -> str:
    return f"coalesce({condition}, false)"


def as_flag(condition: str) -> str:
    return f"CAST(coalesce({condition}, false) AS INT)"


def project(columns: dict[str, Column | str]) -> list[Column]:
    """Named select items from SQL text or Columns."""
    return [F.expr(f"{v} AS `{k}`") if isinstance(v, str) else v.alias(k) for k, v in columns.items()]


def extend(df: DataFrame, columns: dict[str, Column | str]) -> DataFrame:
    """Add or replace columns in one projection."""
    have = df.columns
    if not any(c in have for c in columns):
        return df.select("*", *project(columns))
    return df.select(*[c for c in df.columns if c not in columns], *project(columns))


def finite(x: Column | str) -> Column:
    """NaN and both infinities become NULL."""
    x = col(x).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def _pad6(digits: Column) -> Column:
    return F.when(F.length(digits) >= 6, F.substring(digits, -6, 6)).otherwise(F.lpad(digits, 6, "0"))


def normalize_symbol(x: Column | str, keep_text: bool = False) -> Column:
    """Digits only: the last six, or zero-padded to six.

    Text without digits becomes "" or, with ``keep_text``, the trimmed upper text.
    """
    text = F.upper(F.trim(col(x).cast("string")))
    digits = F.regexp_replace(text, r"\D", "")
    fallback = text if keep_text else F.lit("")
    return F.when(text.isNull(), F.lit("")).when(digits == "", fallback).otherwise(_pad6(digits))


def first_code(x: Column | str) -> Column:
    """First run of six digits, otherwise as :func:`normalize_symbol`."""
    run = F.regexp_extract(F.trim(col(x).cast("string")), r"(\d{6})", 1)
    return F.when(run != "", run).otherwise(normalize_symbol(x))


def code_in_parts(x: Column | str) -> Column:
    """Last six digits of the first ``. _ - space`` part that has six or more.

    If no part qualifies the digits of the whole text decide, and failing that
    the upper-cased text itself is kept.
    """
    text = F.upper(F.trim(col(x).cast("string")))
    parts = F.transform(F.split(text, r"[._\- ]+"), lambda p: F.regexp_replace(p, r"\D", ""))
    hit = F.try_element_at(F.filter(parts, lambda p: F.length(p) >= 6), F.lit(1))
    digits = F.regexp_replace(text, r"\D", "")
    return (
        F.when(text.isNull(), F.lit(""))
        .when(hit.isNotNull(), F.substring(hit, -6, 6))
        .when(F.length(digits) >= 6, F.substring(digits, -6, 6))
        .otherwise(text)
    )


def exchange_symbol(file_name: Column | str) -> Column:
    """``SH#600000``-style symbol from a file name; NULL when no code is found."""
    base = F.element_at(F.split(col(file_name), "/"), -1)
    stem = F.replace(F.upper(F.trim(F.regexp_replace(base, r"\.[^.]*$", ""))), F.lit(" "), F.lit(""))
    market = F.regexp_extract(stem, r"^([^#]*)#", 1)
    marked = F.regexp_extract(stem, r"^[^#]*#.*?(\d{6})", 1)
    code = F.regexp_extract(stem, r"(\d{6})", 1)
    head = F.substring(code, 1, 3)
    return (
        F.when(marked != "", F.concat(market, F.lit("#"), marked))
        .when(code == "", None)
        .when(head.isin(*SHANGHAI_PREFIXES), F.concat(F.lit("SH#"), code))
        .when(head.isin(*SHENZHEN_PREFIXES), F.concat(F.lit("SZ#"), code))
        .otherwise(code)
    )


def normalize_code(x: Column | str) -> Column:
    """Export form of a code: no ``.0`` tail, at least six digits, "" if missing."""
    text = F.trim(col(x).cast("string"))
    bare = F.regexp_replace(text, r"^(\d+)\.0$", "$1")
    short_number = bare.rlike(r"^\d{1,5}$")
    return (
        F.when(text.isNull() | F.lower(text).isin(*NULL_WORDS), F.lit(""))
        .when(short_number, F.lpad(bare, 6, "0"))
        .otherwise(bare)
    )


def _try_date(x: Column, *formats: str) -> Column:
    return F.coalesce(*[F.try_to_timestamp(x, F.lit(f)).cast("date") for f in formats])


def parse_date(x: Column | str) -> Column:
    """ISO-like dates, then any text whose digits form ``YYYYMMDD``."""
    text = F.trim(col(x).cast("string"))
    head = F.regexp_extract(text, r"^(\d{4}[-/]\d{1,2}[-/]\d{1,2})(?:[ T].*)?$", 1)
    iso = _try_date(F.regexp_replace(F.when(head != "", head), "/", "-"), "yyyy-M-d")
    digits = F.regexp_replace(text, r"\D", "")
    return F.coalesce(iso, _try_date(F.when(F.length(digits) == 8, digits), "yyyyMMdd"))


def parse_date_day_first(x: Column | str) -> Column:
    """ISO first, then ``dd/MM/yyyy``, then ``yyyyMMdd``.

    Year-first text is never read day-first, so 2021-08-02 is 2 August.
    """
    text = F.trim(col(x).cast("string"))
    iso = F.when(text.rlike(r"^\d{4}[-/]\d{1,2}[-/]\d{1,2}$"), F.regexp_replace(text, "/", "-"))
    day_first = F.when(text.rlike(r"^\d{1,2}[-/]\d{1,2}[-/]\d{4}$"), F.regexp_replace(text, "-", "/"))
    compact = F.when(text.rlike(r"^\d{8}$"), text)
    return F.coalesce(
        _try_date(iso, "yyyy-M-d"),
        _try_date(day_first, "d/M/yyyy"),
        # 13/25-style text cannot be a day-first date; accept month-first as pandas does.
        _try_date(day_first, "M/d/yyyy"),
        _try_date(compact, "yyyyMMdd"),
    )


def parse_number(x: Column | str) -> Column:
    """Number with optional thousands commas; unparseable text is NULL."""
    return finite(F.regexp_replace(F.trim(col(x).cast("string")), ",", "").try_cast("double"))


def to_number(x: Column | str) -> Column:
    return finite(col(x).try_cast("double"))


def parse_boolean(x: Column | str) -> Column:
    text = F.lower(F.trim(col(x).cast("string")))
    number = text.try_cast("double")
    return (
        F.when(text.isin(*TRUE_WORDS) | (number == 1), F.lit(True))
        .when(text.isin(*FALSE_WORDS) | (number == 0), F.lit(False))
    )
