"""Restartable data jobs on Spark: step specs, resumable maps, throttles, snapshots,
nested records, log and YAML scans, and text tables."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

from cadence.functions.json_text import (
    canonical_json, json_get, json_set, merge_json_defaults, pretty_json,
)
from cadence.functions.levels import level_to_int, level_to_name, parse_level
from cadence.functions.steps import StepSpec, step_clause, step_filter, step_spec
from cadence.functions.text import aligned, fixed_text, path_prefixes, plain_text, split_path
from cadence.operators.averages import (
    last_value, running_weighted_mean, weighted_mean, weighted_summary,
)
from cadence.operators.documents import flatten_json, merge_defaults_long
from cadence.operators.keysets import (
    assert_complete, assert_unique, duplicate_keys, keep_latest, latest_by_key,
    ordered_results, remaining_items, upsert_results,
)
from cadence.operators.logs import level_filter, logger_threshold_filter
from cadence.operators.nesting import (
    flatten_struct, get_path, merge_defaults, merge_variants, set_path, unflatten_struct,
)
from cadence.operators.ordering import balanced_batches, dense_index, key_batches, key_index
from cadence.operators.tables import column_widths, format_dataframe, format_table
from cadence.operators.throttling import throttle
from cadence.runtime import clear_staging
from cadence.sources.json_files import scan_json, sink_json
from cadence.sources.log_files import (
    parse_log_lines, scan_log_lines, scan_log_records, sink_log_lines, stream_log_lines,
)
from cadence.sources.snapshots import (
    append_results, compute_or_load, read_first_available, read_snapshot, stash, write_snapshot,
)
from cadence.sources.states import (
    commit_state, latest_index, list_states, prune_states, read_latest_state,
)
from cadence.sources.text_tables import sink_text_table
from cadence.sources.yaml_files import parse_yaml, scan_yaml
from cadence.streaming.incremental import cadence, incremental_job, on_batches
from cadence.streaming.keyed import (
    read_clocks, stream_throttle, stream_weighted_mean, throttle_job,
)
from cadence.streaming.resume import per_item, read_batches, resumable_map

# Functions sent to executors carry their code along, so those need no copy of this package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

__all__ = [name for name in dir() if not name.startswith("_")]
