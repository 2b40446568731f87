from cumulus.operators.stages import group_day, group_window, increments, with_increments  # noqa: F401
