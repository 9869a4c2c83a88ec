from tallywright.functions.hashed import may_match
from tallywright.functions.ids import append_ids
from tallywright.functions.scalars import (
    day_of,
    exact_sum,
    finite,
    is_paid,
    local_text,
    money_text,
    month_start,
    month_text,
    percent_of,
    percent_text,
    ratio,
    round_half_even,
    time_text,
)
from tallywright.functions.skew import heavy_keys, spread_join

__all__ = [
    "append_ids", "day_of", "exact_sum", "finite", "heavy_keys", "is_paid", "local_text", "may_match", "money_text", "month_start",
    "month_text", "percent_of", "percent_text", "ratio", "round_half_even",
    "spread_join", "time_text",
]
