"""Scalar column expressions used by the reports.

Every function returns a ``Column`` built from ``pyspark.sql.functions``
so it stays inside whole-stage code generation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F



def fraction_text(x: Column) -> Column:
    """A fraction as the text a spreadsheet cell would hold."""
    return x.cast("string")


def percent_to_fraction(pct: Column) -> Column:
    """Form input in whole percent -> fraction of a person-month."""
    return pct.cast("double") / 100


def load_band(x: Column, max_value: float = 1.0) -> Column:
    """Load band of a person-month cell, tested in this order.

    (max, 3*max] -> over, (0.5*max, 0.8*max] -> light, <= 0.5*max -> low,
    anything else (including null) -> none.
    """
    return (F.when((x > max_value) & (x <= 3 * max_value), "over")
            .when((x > 0.5 * max_value) & (x <= 0.8 * max_value), "light")
            .when(x <= 0.5 * max_value, "low")
            .otherwise("none"))


def whole_percent(x: Column) -> Column:
    """``round(x * 100)`` as an integer, ties to even like Python's round."""
    return F.bround(x * 100, 0).cast("int")


def fmt_percent(x: Column) -> Column:
    """``0%`` format: whole percent, ties to even."""
    return F.concat(whole_percent(x).cast("string"), F.lit("%"))


def fmt_one_decimal(x: Column) -> Column:
    """``0.0`` format: the double rounded to one decimal from its exact
    binary value (so 0.35, stored just below .35, prints 0.3), without
    thousands separators."""
    return F.regexp_replace(F.format_number(x, 1), ",", "")


def fmt_pm(x: Column) -> Column:
    """``0.0 PM`` format of a person-month total."""
    return F.concat(fmt_one_decimal(x), F.lit(" PM"))


def plain_number(x: Column) -> Column:
    """A double as positional text with its shortest digits (``150000.0``,
    ``123456.5``, ``12345678.0``) -- never scientific notation."""
    digits = x.cast("decimal(38,18)").cast("string")
    return F.regexp_replace(F.regexp_replace(digits, "0+$", ""), "\\.$", ".0")


def fmt_euro(x: Column) -> Column:
    """``n €`` format of a cost cell (the value printed as is)."""
    return F.concat(plain_number(x.cast("double")), F.lit(" €"))


def iso_utc(ts: Column) -> Column:
    """ISO-8601 text plus ``Z``; the fraction is omitted when it is zero."""
    frac = F.date_format(ts, "SSSSSS")
    return F.when(ts.isNull(), F.lit(None).cast("string")).otherwise(
        F.concat(F.when(frac == "000000", F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"))
                 .otherwise(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")),
                 F.lit("Z")))


def avatar_digest(username: Column) -> Column:
    """MD5 hex digest of the lower-cased user name (avatar link key)."""
    return F.md5(F.lower(username))


def needs_translation(language: Column, locale: str) -> Column:
    """Language known and different from the reader's locale."""
    return (language.isNotNull() & (language != "") & (language != F.lit(locale)))


def truthy_text(c: Column) -> Column:
    """Template truthiness of a text value: not null and not empty."""
    return c.isNotNull() & (c != "")


def change_sentence(c: dict[str, Column] | None = None) -> Column:
    """One audit row rendered as a sentence.

    Dedication branch when an employee is set, else cost branch when a concept
    is set, else only the author.  " Motivation: <remarks>" is appended when
    remarks are present.  A missing author, project, month or year reads
    "None", as the page renders it.  Percentages are ``round(x * 100)``, ties to even.
    """
    col = (lambda n: F.col(n)) if c is None else (lambda n: c[n])
    said = lambda n: F.coalesce(col(n).cast("string"), F.lit("None"))
    when_ = F.concat(said("month"), F.lit("/"), said("year"))
    ded = F.concat(
        said("author"), F.lit(" changed the dedication of "), col("employee"),
        F.lit(" in "), said("project"), F.lit(" - "), when_,
        F.lit(" from "), F.coalesce(whole_percent(col("dedication_old")).cast("string"), F.lit("")),
        F.lit("% to "), F.coalesce(whole_percent(col("dedication_new")).cast("string"), F.lit("")),
        F.lit("%."))
    cst = F.concat(
        said("author"), F.lit(" changed the cost of "), col("concept"),
        F.lit(" in "), said("project"), F.lit(" - "), when_,
        F.lit(" from "), F.coalesce(col("cost_old").cast("string"), F.lit("None")),
        F.lit("€ to "), F.coalesce(col("cost_new").cast("string"), F.lit("None")),
        F.lit("€."))
    head = (F.when(truthy_text(col("employee")), ded)
            .when(truthy_text(col("concept")), cst)
            .otherwise(F.coalesce(col("author"), F.lit(""))))
    return F.concat(head, F.when(truthy_text(col("remarks")),
                                 F.concat(F.lit(" Motivation: "), col("remarks"))).otherwise(F.lit("")))


def row_sum(cols: list[str]) -> Column:
    """Sum of columns, row-wise (nulls count as 0)."""
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0.0)) for c in cols])


def all_not_null(cols: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])


def title_case_names(columns: list[str]) -> list[str]:
    """Report headers: first letter upper case, the rest lower case."""
    return [c.capitalize() for c in columns]
