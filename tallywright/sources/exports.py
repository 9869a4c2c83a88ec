"""Writing tables and reports out as CSV."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.functions import time_text
from tallywright.operators.present import titled
from tallywright.schemas import PARTNER_TITLES

_STAMP = "%Y%m%d_%H%M%S"


def export_image(table: DataFrame) -> DataFrame:
    """Rows as an export shows them: null texts empty, times to the second as text."""
    shown = []
    for name, kind in table.dtypes:
        col = F.col(name)
        if kind.startswith("timestamp"):
            col = F.coalesce(time_text(col), F.lit(""))
        elif kind == "string":
            col = F.coalesce(col, F.lit(""))
        shown.append(col.alias(name))
    return table.select(*shown)


def plain_digits(value: Column) -> Column:
    """A double as text without an exponent: ``12345678.5``, ``0.00004``."""
    text = value.cast("string")
    digits = F.regexp_replace(text.try_cast("decimal(38,18)").cast("string"), r"(\.\d+?)0+$", "$1")
    whole = F.concat(text.try_cast("decimal(38,0)").cast("string"), F.lit(".0"))
    return F.when(~text.contains("E"), text).otherwise(F.coalesce(digits, whole, text))


def write_csv(frame: DataFrame, path: str) -> None:
    """CSV with a header; a folder of part files, written in parallel.

    Texts are written as they are, surrounding blanks included, and doubles as
    plain digits. Cells with line breaks are quoted; ``read_upload`` reads them with
    ``multiline``.
    """
    def shown(name: str, kind: str) -> Column:
        cell = F.col("`" + name.replace("`", "``") + "`")  # titles may hold dots
        return (plain_digits(cell) if kind in ("double", "float") else cell).alias(name)

    (
        frame.select(*[shown(*c) for c in frame.dtypes]).write.option("header", True).option("nullValue", "").option("emptyValue", "")
        .option("escape", '"').option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False).csv(path)
    )


def export_tables(
    tables: Mapping[str, DataFrame], folder: str, now: dt.datetime | None = None
) -> dict[str, str]:
    """Write every table to ``folder/<table>_<time>``; returns the paths."""
    stamp = (now or dt.datetime.now()).strftime(_STAMP)
    paths = {}
    for name, table in tables.items():
        paths[name] = f"{folder.rstrip('/')}/{name}_{stamp}"
        write_csv(export_image(table), paths[name])
    return paths


def table_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Table names with their numbers of rows."""
    counts = None
    for name, table in tables.items():
        one = table.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows")
        counts = one if counts is None else counts.unionByName(one)
    if counts is None:
        raise ValueError("no tables given")
    return counts


def partner_export(report: DataFrame, show_income: bool = True) -> DataFrame:
    """The partner report under its column titles, amounts to two digits."""
    rounded = report.withColumn("total_income", F.bround("total_income", 2))
    return titled(rounded, PARTNER_TITLES, hide=() if show_income else ("total_income",))
