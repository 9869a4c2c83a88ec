"""Column expressions shared by the reports. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_QUOTIENT = "decimal(30,10)"
_LOW_BITS = 24


def finite(value: Column) -> Column:
    """The amount, or null where it is no number: NaN and infinities."""
    amount = value.cast("double")
    return F.when((amount > float("-inf")) & (amount < float("inf")), amount)


def is_paid(value: Column) -> Column:
    """A positive, finite amount. Plain comparisons, so they reach the Parquet reader."""
    return (value > 0) & (value < float("inf"))


def exact_sum(value: Column) -> Column:
    """Sum of amounts to six decimals, exact in any order of the rows.

    A sum of doubles depends on the order in which tasks finish. A sum of
    decimals does not, but turning a double into a decimal costs ten times the
    sum itself. Here the whole part is summed as a long integer, its high and
    low bits apart so that neither sum overflows, and the fraction in millionths
    (fewer decimals where a double has no more); they are put together as a
    decimal once per group.

    NaN and infinities are no amounts and count as null. Amounts of 2**63 and
    more are summed as doubles, which hold no fraction there; a group whose sum
    no decimal(38,6) can hold has a null sum.
    """
    amount = finite(value)
    small = F.abs(amount) < float(1 << 62)
    whole = F.when(small, F.floor(amount)).when(amount.isNotNull(), F.lit(0)).cast("bigint")
    places = F.when(F.abs(amount) < float(1 << 32), 1e6).when(F.abs(amount) < float(1 << 40), 1e4).otherwise(1e2)
    rest = F.when(small, F.rint((amount - F.floor(amount)) * places) * (F.lit(1e6) / places))
    high = F.sum(F.shiftright(whole, _LOW_BITS))
    low = F.sum(whole.bitwiseAND(F.lit((1 << _LOW_BITS) - 1)))
    millionths = F.coalesce(F.sum(rest.cast("bigint")), F.lit(0))
    large = F.sum(F.when(~small, amount))
    units = (
        high.cast("decimal(20,0)") * F.lit(1 << _LOW_BITS).cast("decimal(8,0)")
        + low.cast("decimal(20,0)")
    )
    total = units.cast("decimal(32,0)") + millionths.cast("decimal(20,0)") * F.lit("0.000001").cast("decimal(7,6)")
    total = total.cast("decimal(38,6)")
    return F.when(large.isNull(), total).otherwise((total + large.try_cast("decimal(38,6)")).cast("decimal(38,6)"))


def day_of(ts: Column) -> Column:
    """Calendar day of a zone-less timestamp."""
    return F.to_date(ts)


def month_start(ts: Column) -> Column:
    """First day of the month: a four-byte grouping key, cheaper than its text."""
    return F.trunc(F.to_date(ts), "month")


def month_text(day: Column) -> Column:
    """``yyyy-MM`` of a date. Reports use it after grouping: per group, not per order."""
    return F.substring(day.cast("string"), 1, 7)


def round_half_even(value: Column, digits: int = 2) -> Column:
    """Round ties to the even neighbour (``round`` in SQL rounds them up)."""
    return F.bround(value, digits)


def ratio(top: Column, bottom: Column, digits: int | None = None) -> Column:
    """``top / bottom``, or 0 unless ``bottom`` is positive."""
    quotient = top.cast("double") / F.when(bottom > 0, bottom).cast("double")
    if digits is not None:
        quotient = round_half_even(quotient.cast(_QUOTIENT), digits)
    return F.coalesce(quotient, F.lit(0))


def percent_of(value: Column, base: float | None) -> Column:
    """``value`` in percent of ``base`` to two digits; null without a positive base."""
    if base is None or base <= 0:
        return F.lit(None).cast("decimal(30,2)")
    share = value.cast("double") / F.lit(float(base)) * F.lit(100.0)
    return round_half_even(share.cast(_QUOTIENT)).cast("decimal(30,2)")


def percent_text(percent: Column) -> Column:
    """``12.50%``, or ``N/A`` where there is no percentage."""
    return F.coalesce(F.concat(percent.cast("string"), F.lit("%")), F.lit("N/A"))


def money_text(value: Column) -> Column:
    """Two decimals and a space between thousands: ``1 234 567.89``."""
    return F.replace(F.format_number(value, 2), F.lit(","), F.lit(" "))


def time_text(ts: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss``.

    By a cast and not by ``date_format``, which would take a zone-less timestamp
    through the session's time zone and shift hours that do not exist there.
    """
    return F.substring(ts.cast("string"), 1, 19)


def local_text(utc: Column, zone: str, separator: str) -> Column:
    """A zone-less UTC timestamp on the clock of ``zone``: day, month, year, HH:mm."""
    local = time_text(F.convert_timezone(F.lit("UTC"), F.lit(zone), utc))
    layout = f"$3{separator}$2{separator}$1 $4"
    return F.regexp_replace(local, r"^(\d+)-(\d+)-(\d+) (\d+:\d+):\d+$", layout)
