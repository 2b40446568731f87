from cumulus.streaming.ingest import group_day_from_partials, start_group_day_ingest  # noqa: F401
