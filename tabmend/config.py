"""Limits that decide results."""

PREVIEW_ROWS = 5
INFER_ROWS = 8192
ROW_GROUP_ROWS = 50_000
RUNAWAY_FACTOR, RUNAWAY_FIELDS = 16, 4096
JOIN_LOOKAHEAD = 8
REALIGN_EXTRA, REALIGN_PROFILE = 3, 2048
DETECT_BYTES = 10_000
DOCTOR_BYTES, DOCTOR_RECORDS = 4 << 20, 5000
SQLITE_PARAMETERS = 32_766
WARNINGS_SHOWN, MISMATCH_COLUMNS_SHOWN = 10, 10
