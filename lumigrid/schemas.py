"""Fixed schemas of the tables.  What varies per file (its channels) is kept in rows, not columns.

Schemas are DDL text, which readers take as it is.
"""

FILES = "file_id BIGINT, path STRING, file_name STRING, size_bytes BIGINT"

CHANNELS = (
    "file_id BIGINT, part_idx INT, part_name STRING, width INT, height INT, "
    "channel_idx INT, full_name STRING")

# part_idx is NULL for attributes of the file header.
ATTRS = "file_id BIGINT, part_idx INT, ord INT, name STRING, value STRING"

SAMPLES = (
    "file_id BIGINT, part_idx INT, channel_idx INT, y INT, x INT, v FLOAT")

# One row per scan line: `width` times fewer rows than SAMPLES.
SCANLINES = (
    "file_id BIGINT, part_idx INT, channel_idx INT, y INT, line ARRAY<FLOAT>")

PIXELS = "image_id BIGINT, y INT, x INT, r FLOAT, g FLOAT, b FLOAT, a FLOAT"

PIXELS8 = "image_id BIGINT, y INT, x INT, r8 INT, g8 INT, b8 INT, a8 INT"

DIMS = "image_id BIGINT, width INT, height INT"

PARAM_EVENTS = (
    "session BIGINT, event_id BIGINT, ts TIMESTAMP, exposure DOUBLE, gamma DOUBLE")

PROGRESS_UPDATES = (
    "session BIGINT, event_id BIGINT, ts TIMESTAMP, kind STRING, p DOUBLE, message STRING")

LOG_LINES = "session BIGINT, ts TIMESTAMP, line STRING"

SELECTIONS = "sel_id BIGINT, file_id BIGINT, line STRING"

TABLES = {
    "files": FILES,
    "channels": CHANNELS,
    "attrs": ATTRS,
    "samples": SAMPLES,
    "scanlines": SCANLINES,
    "pixels": PIXELS,
    "pixels8": PIXELS8,
    "dims": DIMS,
    "param_events": PARAM_EVENTS,
    "progress_updates": PROGRESS_UPDATES,
    "log_lines": LOG_LINES,
    "selections": SELECTIONS,
}
