"""Filters as they are typed above the columns of a table: ``> 100``, ``contains tea``.

A cell holds an operator and a value, or a value alone:

    = eq   != ne   > gt   >= ge   < lt   <= le   contains   datestartswith   is nil   is blank

An ``i`` before an operator ignores case (``i=``, ``icontains``). A value alone is looked for
in texts, must be equal for numbers and begins dates. A value in quotes is taken as it is. A date may be
a year, a month, a day or a time and stands for all of it: ``> 2023-05`` begins with June.
Nulls match ``is nil`` and ``is blank`` only. Everything else is refused.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Mapping, Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SYMBOLS = {"eq": "=", "ne": "!=", "gt": ">", "ge": ">=", "lt": "<", "le": "<="}
_CELL = re.compile(
    r"\s*(?:(?P<unary>is\s+(?:nil|blank))\s*$"
    r"|(?P<fold>i)?(?P<symbol>>=|<=|!=|=|>|<)"
    r"|(?P<case>[is])?(?P<word>eq|ne|gt|ge|lt|le|contains|datestartswith)(?=[\s\"'`]))?\s*(?P<value>.*?)\s*$", re.S)
_QUOTED = re.compile(r"([\"'`])(.*)\1", re.S)
_NUMBER = re.compile(r"[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d{1,3})?")
_DATE = re.compile(r"(\d{4})(?:-(\d\d)(?:-(\d\d)(?:[ T](\d\d):(\d\d)(?::(\d\d))?)?)?)?")


class FilterRefused(ValueError):
    """The text in a cell is no filter for its column."""


def typed_filter(column: str, kind: str, text: str) -> Column:
    """The condition that ``text`` puts on a column of the type ``kind``."""
    cell = _CELL.match(text)
    held = F.col(f"`{column}`")
    if cell["unary"]:
        blank = cell["unary"].endswith("blank")
        return held.isNull() | (F.trim(held.cast("string")) == "") if blank else held.isNull()
    operator = cell["symbol"] or _SYMBOLS.get(cell["word"], cell["word"])
    value, fold = cell["value"], "i" in (cell["fold"], cell["case"])
    if quoted := _QUOTED.fullmatch(value):
        value = quoted[2]
    elif not value:
        raise FilterRefused(f"{column}: a value is missing in {text!r}")
    if operator == "contains" or operator is None and kind == "string":
        return _folded(held.cast("string"), fold).contains(value.lower() if fold else value)
    if kind in ("date", "timestamp", "timestamp_ntz"):
        return _in_time(column, held, "=" if operator in (None, "datestartswith") else operator, value)
    if operator == "datestartswith":
        raise FilterRefused(f"{column}: only dates can start with a date")
    if kind == "string":
        return _compared(_folded(held, fold), operator, F.lit(value.lower() if fold else value))
    if kind == "boolean":
        if value.lower() not in ("true", "false") or operator not in (None, "=", "!="):
            raise FilterRefused(f"{column}: {text!r} is neither true nor false")
        return _compared(held, operator or "=", F.lit(value.lower() == "true"))
    digits = re.sub(r"[\s\u00a0]", "", value)
    if not _NUMBER.fullmatch(digits):
        raise FilterRefused(f"{column}: {value!r} is no number")
    number = float(digits) if kind in ("double", "float") else Decimal(digits)
    return _compared(held, operator or "=", F.lit(number))


def _folded(held: Column, fold: bool) -> Column:
    return F.lower(held) if fold else held


def _compared(held: Column, operator: str, value: Column) -> Column:
    return {
        "=": held == value, "!=": held != value, ">": held > value, ">=": held >= value,
        "<": held < value, "<=": held <= value,
    }[operator]


def _in_time(column: str, held: Column, operator: str, value: str) -> Column:
    """The value is a period; bare bounds, so that they reach the files."""
    found = _DATE.fullmatch(value)
    try:
        year, month, day, hour, minute, second = (None if x is None else int(x) for x in found.groups())
        begin = dt.datetime(year, month or 1, day or 1, hour or 0, minute or 0, second or 0)
        if month is None:
            end = begin.replace(year=year + 1)
        elif day is None:
            end = begin.replace(year=year + month // 12, month=month % 12 + 1)
        else:
            step = dt.timedelta(days=1) if hour is None else dt.timedelta(minutes=1) if second is None else dt.timedelta(seconds=1)
            end = begin + step
    except (AttributeError, ValueError, OverflowError) as error:
        raise FilterRefused(f"{column}: {value!r} is no date") from error
    first, behind = (F.lit(t.isoformat(" ")).cast("timestamp_ntz") for t in (begin, end))
    return {
        "=": (held >= first) & (held < behind), "!=": (held < first) | (held >= behind),
        ">": held >= behind, ">=": held >= first, "<": held < first, "<=": held < behind,
    }[operator]


def filtered(report: DataFrame, cells: Mapping[str, str], sort: Sequence[str] = ()) -> DataFrame:
    """A report under what is typed above its columns, sorted by several of them.

    ``cells`` maps columns to texts, empty ones filter nothing and all others must hold.
    ``sort`` names columns, the first counts most, with a ``-`` before descending ones;
    nulls come last. An unknown column is refused.
    """
    kinds = dict(report.dtypes)
    by = [(name.removeprefix("-"), name.startswith("-")) for name in sort]
    if unknown := [c for c in [*cells, *(name for name, _ in by)] if c not in kinds]:
        raise FilterRefused(f"no such column: {', '.join(unknown)}")
    for column, text in cells.items():
        if text and text.strip():
            report = report.filter(typed_filter(column, kinds[column], text))
    order = [F.col(f"`{c}`").desc_nulls_last() if down else F.col(f"`{c}`").asc_nulls_last() for c, down in by]
    return report.orderBy(*order) if order else report
