"""Rows of SQL dumps: CREATE TABLE and INSERT statements, read as a stream of tokens."""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator

from tabmend.operators.names import positional_names
from tabmend.options import ConversionError

CHUNK = 1 << 20
_TOKEN = re.compile(
    r"(?P<space>\s+|--[^\n]*\n|\#[^\n]*\n|/\*.*?\*/)"
    r"|(?P<string>'(?:[^'\\]|\\.|'')*+'|\"(?:[^\"\\]|\\.|\"\")*+\")"
    r"|(?P<name>`(?:[^`]|``)*+`|\[[^\]]*\])"
    r"|(?P<mark>[(),;])"
    r"|(?P<word>(?:(?!--|/\*)[^\s'\"`\[(),;#])+)",
    re.DOTALL,
)
#: As many whole tokens as there are, up to a semicolon: the same as above, each with what must follow in sight.
_RUN = re.compile(rb"""(?:[^;'"`\[\#/-]++|'(?:[^'\\]|\\.|'')*+'(?=.)|"(?:[^"\\]|\\.|"")*+"(?=.)|`(?:[^`]|``)*+`(?=.)|\[[^\]]*+\]|--[^\n]*+\n|\#[^\n]*+\n|/\*.*?\*/|-(?=[^-])|/(?=[^*]))*+""", re.DOTALL)
_END = re.compile(rb";[ \t\r]*(\n|\Z)")
#: A token of more bytes is not looked through for where statements start.
LONGEST = 64 << 20
#: Where a statement seems to start.
_LIKELY = re.compile(rb";[ \t\r]*\n(?=\s*(?:INSERT|CREATE|DROP|ALTER|LOCK|UNLOCK|SET|BEGIN|COMMIT|--|/\*)[\s!])", re.IGNORECASE)
#: First words of table items that are no columns.
CONSTRAINTS = {"PRIMARY", "UNIQUE", "KEY", "INDEX", "CONSTRAINT", "FOREIGN", "CHECK", "FULLTEXT", "SPATIAL"}
#: What a letter after a backslash stands for.
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "0": "\0", "b": "\b", "Z": "\x1a"}
Token = tuple[str, str]


def _unquoted(text: str) -> str:
    quote, body = text[0], text[1:-1]
    return re.sub(rf"\\(.)|{quote}{quote}", lambda m: ESCAPES.get(m[1], m[1]) if m[1] else quote, body, flags=re.DOTALL)


def likely_start(path: str, start: int, stop: int) -> int | None:
    """The first place behind `start`, at `stop` at most, where a statement seems to start."""
    with open(path, "rb") as file:
        file.seek(start)
        kept, at = b"", start
        while at < stop and (data := file.read(min(CHUNK, stop - at))):
            text = kept + data
            if found := _LIKELY.search(text):
                return at - len(kept) + found.end()
            at, kept = at + len(data), text[-100:]
    return None


def next_start(path: str, start: int, likely: list[int]) -> int | None:
    """The first of some places at which a statement ends, read from one that does start a statement; nothing where the file ends before.

    A place inside a text or comment is passed over. So pieces from one such place to the next hold whole statements.
    """
    wanted = set(likely)
    with open(path, "rb") as file:
        file.seek(start)
        text, at, base, ended = b"", 0, start, not wanted
        while True:
            at = _RUN.match(text, at).end()
            end = _END.match(text, at)
            if text[at : at + 1] == b";" and (ended or end is None or end[1]):
                if end and base + end.end() in wanted:
                    return base + end.end()
                at += 1
                continue
            if ended or len(text) - at > LONGEST:
                return None
            data = file.read(max(CHUNK, len(text) - at))
            base, text, at, ended = base + at, text[at:] + data, 0, not data


def tokens(path: str, start: int = 0, stop: int | None = None) -> Iterator[Token]:
    """(kind, text) of strings, words, names and marks; comments and white space are left out."""
    with open(path, "rb") as file:
        file.seek(start)
        decoder = codecs.getincrementaldecoder("utf-8")("replace")
        left = None if stop is None else stop - start

        def read(n: int) -> str:
            """The next characters, of n bytes at most; nothing at the end."""
            nonlocal left
            while True:
                data = file.read(n if left is None else min(n, left))
                left = None if left is None else left - len(data)
                piece = decoder.decode(data, final=not data)
                if piece or not data:
                    return piece

        text, at, ended = "", 0, False
        while True:
            found = _TOKEN.match(text, at)
            # a token that reaches the end of the buffer may go on
            if not ended and (found is None or found.end() >= len(text) - 1):
                piece = read(max(CHUNK, len(text) - at))
                ended = not piece
                text, at = text[at:] + piece + ("\n" if ended else ""), 0
                continue
            if found is None:
                if at >= len(text):
                    return
                at += 1  # a stray character
                continue
            at = found.end()
            kind = found.lastgroup
            if kind == "string":
                yield kind, _unquoted(found[0])
            elif kind == "name":
                quoted = found[0]
                yield "word", quoted[1:-1].replace("``", "`") if quoted[0] == "`" else quoted[1:-1]
            elif kind != "space":
                yield kind, found[0]


class Dump:
    """One pass over a dump for one table; `wanted` is empty for the first table that has rows."""

    def __init__(self, path: str, wanted: str = "", start: int = 0, stop: int | None = None) -> None:
        self.stream, self.wanted = tokens(path, start, stop), wanted.lower()
        self.whole = not start and stop is None
        self.created: dict[str, tuple[str, list[str]]] = {}
        self.table, self.columns = "", []
        self.seen: list[str] = []

    def _next(self) -> Token:
        return next(self.stream, ("end", ""))

    def _table_name(self) -> tuple[str, Token]:
        """The last part of a qualified name, and the token behind it."""
        kind, text = self._next()
        words = []
        while kind in ("word", "string"):
            words.append((kind, text))
            kind, text = self._next()
        plain = [w[1] for w in words]
        while len(plain) >= 3 and [w.upper() for w in plain[:3]] == ["IF", "NOT", "EXISTS"]:
            plain = plain[3:]
        joined = ""
        for w in plain:  # `db`.`t` comes as three words, db.t as one
            if joined and not (joined.endswith(".") or w.startswith(".")):
                break
            joined += w
        return joined.rpartition(".")[2], (kind, text)

    def _create(self) -> None:
        name, token = self._table_name()
        columns, depth, fresh = [], 1, True
        if token == ("mark", "("):
            while depth:
                kind, text = self._next()
                if kind == "end":
                    break
                if kind == "mark" and text in "()":
                    depth += 1 if text == "(" else -1
                elif depth == 1 and (kind, text) == ("mark", ","):
                    fresh = True
                    continue
                elif fresh and kind in ("word", "string") and text.upper() not in CONSTRAINTS:
                    columns.append(text)
                fresh = False
            self._skip()
        elif token != ("mark", ";"):
            self._skip()
        if name:
            self.created.setdefault(name.lower(), (name, columns))

    def _skip(self) -> None:
        while self._next() not in (("mark", ";"), ("end", "")):
            pass

    def _tuple(self) -> list[str]:
        """The fields up to the closing parenthesis."""
        fields: list[list[Token]] = [[]]
        depth = 1
        while True:
            kind, text = self._next()
            if kind == "end":
                break
            if kind == "mark" and text == ")":
                depth -= 1
                if not depth:
                    break
            elif kind == "mark" and text == "(":
                depth += 1
            elif depth == 1 and (kind, text) == ("mark", ","):
                fields.append([])
                continue
            fields[-1].append((kind, text))
        return [self._field(f) for f in fields]

    @staticmethod
    def _field(parts: list[Token]) -> str:
        strings = [text for kind, text in parts if kind == "string"]
        if strings:
            return strings[-1]
        if len(parts) == 1:
            return "" if parts[0][1].upper() == "NULL" else parts[0][1]
        return " ".join(text for _, text in parts)

    def _insert(self) -> Iterator[list[str]]:
        kind, text = self._next()
        if kind != "word" or text.upper() != "INTO":
            if (kind, text) != ("mark", ";"):
                self._skip()
            return
        name, token = self._table_name_before_values()
        listed: list[str] = []
        if token == ("mark", "("):
            listed = self._tuple()
            token = self._next()
        if name.lower() not in (s.lower() for s in self.seen):
            self.seen.append(name)
        target = self.table.lower() or self.wanted or name.lower()
        if name.lower() != target or token[0] != "word" or token[1].upper() != "VALUES":
            if token not in (("mark", ";"), ("end", "")):
                self._skip()
            return
        if not self.table:
            self.table = name
            self.columns = self.created.get(name.lower(), ("", []))[1] or listed
        while True:
            token = self._next()
            if token in (("mark", ";"), ("end", "")):
                return
            if token == ("mark", "("):
                row = self._tuple()
                self.columns = self.columns or positional_names(len(row))
                yield row

    def _table_name_before_values(self) -> tuple[str, Token]:
        parts = ""
        kind, text = self._next()
        while kind in ("word", "string") and (not parts or parts.endswith(".") or text.startswith(".")):
            parts += text
            kind, text = self._next()
        return parts.rpartition(".")[2], (kind, text)

    def rows(self) -> Iterator[list[str]]:
        while True:
            kind, text = self._next()
            if kind == "end":
                break
            word = text.upper() if kind == "word" else ""
            if word == "CREATE":
                kind, text = self._next()
                while kind == "word" and text.upper() in ("TEMPORARY", "TEMP", "UNLOGGED", "GLOBAL", "LOCAL"):
                    kind, text = self._next()
                if kind == "word" and text.upper() == "TABLE":
                    self._create()
                elif (kind, text) != ("mark", ";"):
                    self._skip()
            elif word == "INSERT":
                yield from self._insert()
            elif (kind, text) != ("mark", ";"):
                self._skip()
        if not self.table and self.whole:
            self._without_rows()

    def _without_rows(self) -> None:
        tables = [name for name, _ in self.created.values()] + [s for s in self.seen if s.lower() not in self.created]
        key = self.wanted or next(iter(self.created), "")
        if key not in self.created:
            raise ConversionError(f"table {self.wanted!r} is not in the dump; it has: {', '.join(tables)}" if tables else "the dump has no table")
        self.table, self.columns = self.created[key]


def schema(path: str, wanted: str = "") -> tuple[str, list[str]]:
    """Table and column names; reads up to the table's first row."""
    dump = Dump(path, wanted)
    next(dump.rows(), None)
    return dump.table, dump.columns


def rows(path: str, wanted: str = "", start: int = 0, stop: int | None = None) -> Iterator[list[str]]:
    """Rows of a table, or of a part of the dump's whole statements; a file's first part looks further for a table that it doesn't have."""
    dump = Dump(path, wanted, start, stop)
    yield from dump.rows()
    if not (start or dump.whole or dump.table or wanted.lower() in dump.created):
        schema(path, wanted)
