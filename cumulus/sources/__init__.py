from cumulus.sources.observations import OBS_SCHEMA, RAW_SCHEMA, read_obs  # noqa: F401
from cumulus.sources.fixtures import FIXTURES, obs_events, obs_lineitem, obs_orders  # noqa: F401
from cumulus.sources.dimensions import nation_coords, reference_coords  # noqa: F401
from cumulus.sources.results import read_result, write_result  # noqa: F401
