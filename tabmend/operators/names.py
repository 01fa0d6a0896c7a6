"""Output column names."""

from __future__ import annotations

from tabmend.options import ConversionError


def _key(name: str, fold: bool) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in name) if fold else name


def unique_names(names: list[str], fold_case: bool = False) -> list[str]:
    """Trimmed names, blank ones by position, repeats with the first free numeric suffix."""
    wanted = [n.strip() or f"c{i}" for i, n in enumerate(names)]
    taken: set[str] = set()
    out = []
    for name in wanted:
        candidate, suffix = name, 0
        while _key(candidate, fold_case) in taken:
            suffix += 1
            candidate = f"{name}_{suffix}"
        taken.add(_key(candidate, fold_case))
        out.append(candidate)
    return out


def output_names(source: list[str], columns: str | None, fold_case: bool = False) -> list[str]:
    """Source names, or the comma-separated names given instead, made unique."""
    if columns is None:
        return unique_names(source, fold_case)
    given = [c.strip() for c in columns.split(",")]
    if len(given) != len(source):
        raise ConversionError(f"{len(given)} column names for {len(source)} columns")
    if "" in given:
        raise ConversionError("a column name is empty")
    return unique_names(given, fold_case)


def positional_names(n: int) -> list[str]:
    return [f"c{i}" for i in range(n)]


def quoted(identifier: str) -> str:
    return '"' + identifier.replace('"', '""') + '"'
