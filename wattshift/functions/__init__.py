"""Column expressions."""

from wattshift.functions.power import (
    active_power,
    apparent_power,
    batch_tag,
    euclidean,
    event_midpoint,
    event_time,
    instant_power,
    reactive_power,
    safe_ln,
    shift_indices,
    slot_index,
)

__all__ = [
    "active_power",
    "apparent_power",
    "batch_tag",
    "euclidean",
    "event_midpoint",
    "event_time",
    "instant_power",
    "reactive_power",
    "safe_ln",
    "shift_indices",
    "slot_index",
]
