"""Everything that a conversion can be told."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from tabmend import config


class ConversionError(ValueError):
    """A conversion that cannot go on, with a message for people."""


def parse_delimiter(given: str) -> str:
    """`t`, `n`, `r` and their backslash forms, or else the first byte; a comma for nothing."""
    named = {"t": "\t", "\\t": "\t", "n": "\n", "\\n": "\n", "r": "\r", "\\r": "\r"}
    if given in named:
        return named[given]
    first = given.encode()[:1] or b","
    if first[0] > 127:
        raise ConversionError(f"the delimiter must be one byte, not {given!r}")
    return first.decode()


@dataclass
class Options:
    delimiter: str = ","
    encoding: str | None = None
    fallback_encoding: str | None = None
    no_headers: bool = False
    columns: str | None = None
    quoting: bool = True
    repair: bool = True
    trailing_delimiter: bool = False
    join_lines: bool = False
    realign: bool = False
    fix_mojibake: str | None = None
    trim: str = ""
    max_field: int = 0
    strict: bool = False
    infer_types: bool = False
    infer_rows: int = config.INFER_ROWS
    table: str | None = None
    drop_table: bool = False
    sqlite_mode: str = "fts5"
    codec: str = "zstd"
    level: int | None = None
    row_group: int = config.ROW_GROUP_ROWS
    single_file: bool = False
    count: bool = False
    #: Names of options that the caller set; safe fixes leave those alone.
    explicit: set[str] = field(default_factory=set)

    def __post_init__(self) -> None:
        self.delimiter = parse_delimiter(self.delimiter)
        if self.infer_rows < 1:
            raise ConversionError("infer_rows must be at least 1")
        if self.sqlite_mode not in ("fts5", "typed"):
            raise ConversionError(f"unknown SQLite mode {self.sqlite_mode!r}")
        default = {f.name: f.default for f in fields(self)}
        self.explicit |= {k for k, v in default.items() if k != "explicit" and getattr(self, k) != v}
