"""Output paths."""

from __future__ import annotations

from pathlib import Path

from tabmend.options import ConversionError


def output_path(path: str, target: str) -> str:
    """With the target's suffix, unless it is there; databases always get one."""
    if target == "sqlite":
        return f"{path}.db"
    return path if path.endswith(f".{target}") else f"{path}.{target}"


def require_distinct(source: str, target: str) -> None:
    """Fail where both name one file, through links as well."""
    a, b = Path(source), Path(target)
    same = a.exists() and b.exists() and a.samefile(b)
    if same or a.resolve() == b.resolve():
        raise ConversionError("input and output are the same file")
