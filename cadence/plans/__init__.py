from cadence.plans import jobs, records, selection, text  # noqa: F401
from cadence.plans.registry import ORACLES, QUERIES
