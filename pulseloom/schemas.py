"""Fixed schemas of the stored tables (DDL text)."""

RAW = "data_block bigint, error_level bigint, timestamp bigint, chip bigint, sample_index bigint, samples_value array<bigint>"
RUNS = "chip bigint, timestamp array<bigint>, sample_index array<bigint>, samples_value array<array<bigint>>"
PULSES = "chip bigint, channel bigint, t0_ms double, pulse array<bigint>, pulse_index array<bigint>, pulse_timestamp array<bigint>"
HITS = (
    "chip bigint, channel bigint, gch bigint, event_id bigint, timestamp_ms double, pulse array<bigint>, "
    "indices array<bigint>, times array<bigint>, maxsample bigint, charge double"
)
CHANNEL_MAP = "chipNo int, chipChannel int, readoutID int, tpcID string, padID string, gid string"
PADS = "tpc_id int, x double, z double"
TRACKS = (
    "event_id bigint, a_slope double, a_intercept double, a_chi2 double, a_chi2_reduced double, a_angle_deg double, "
    "a_n_points int, a_dof int"
)
PINREFS = "array<struct<_part: string, _gate: string, _pin: string>>"
NET = f"_name string, segment array<struct<pinref: {PINREFS}>>"
