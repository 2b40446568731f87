from cumulus.functions.scalar import (  # noqa: F401
    LN2, bin_index, day_string, doubling_days, month_key, parse_day, pct, ratio, try_parse_day,
)
