"""Splitting JSON arrays and concatenated values into the texts of their values, with a bounded buffer."""

from __future__ import annotations

import codecs
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

from tabmend.options import ConversionError

CHUNK = 1 << 20
_SPACE = " \t\r\n"
_ESCAPED = re.compile(rb"\\.", re.DOTALL)
#: Bytes before or after which a number or literal cannot go on.
_CLEAR = frozenset(b' \t\r\n{}[]",')


@dataclass
class Piece:
    """Bytes of a file whose values are one task's, and the state of the text where they start and stop."""

    start: int = 0
    stop: int | None = None
    inside: bool = False
    depth: int = 0


class _Buffer:
    """Text from a place in the file on. `limit` is the number of its characters before `stop`, once that has been read."""

    def __init__(self, path: str, start: int = 0, stop: int | None = None) -> None:
        self.file = open(path, "rb")  # noqa: SIM115
        self.file.seek(start)
        self.left = None if stop is None else stop - start
        self.decoder = codecs.getincrementaldecoder("utf-8" if start else "utf-8-sig")("replace")
        self.text, self.at, self.ended = "", 0, False
        self.gone, self.limit = 0, None
        self.json = json.JSONDecoder()

    def more(self) -> bool:
        if self.ended:
            return False
        data = self.file.read(CHUNK if self.left is None else min(CHUNK, self.left))
        self.ended = not data
        piece = self.decoder.decode(data, final=self.ended)
        self.gone += self.at
        self.text, self.at = self.text[self.at :] + piece, 0
        if self.left is not None:
            self.left -= len(data)
            if not self.left:
                self.left, self.limit = None, self.gone + len(self.text)
        return not self.ended or bool(piece)

    def owned(self) -> bool:
        """Whether the next character lies before `stop`."""
        return self.limit is None or self.gone + self.at < self.limit

    def peek(self) -> str:
        """The next character that is no white space, or nothing at the end."""
        while True:
            while self.at < len(self.text) and self.text[self.at] in _SPACE:
                self.at += 1
            if self.at < len(self.text) or not self.more():
                return self.text[self.at : self.at + 1]

    def value(self) -> str:
        """The text of the value that starts here."""
        self.peek()
        while True:
            try:
                _, stop = self.json.raw_decode(self.text, self.at)
            except json.JSONDecodeError as error:
                if self.more():
                    continue
                raise ConversionError(f"invalid JSON: {error.msg}") from None
            if stop > len(self.text) - 3 and not self.ended:  # a number may go on, such as behind 1e+
                self.more()
                continue
            out, self.at = self.text[self.at : stop], stop
            return out


def shape(path: str) -> str:
    """`array` or `stream`, by the first character that is no white space."""
    buffer = _Buffer(path)
    first = buffer.peek()
    if not first:
        raise ConversionError("the JSON file is empty")
    return "array" if first == "[" else "stream"


def opening(path: str) -> int:
    """The place behind an array's bracket, or the start of a stream."""
    with open(path, "rb") as file:
        while data := file.read(CHUNK):
            if rest := data.lstrip(b"\xef\xbb\xbf \t\r\n"):
                return file.tell() - len(rest) + 1 if rest[:1] == b"[" else 0
    return 0


def _blanked(path: str, start: int, stop: int | None = None) -> Iterator[bytes]:
    """The bytes in pieces, with spaces for escaped characters. Backslashes stand in strings only, so a run of them tells by itself what it escapes."""
    with open(path, "rb") as file:
        run, low = 0, start
        while low:
            size = min(4096, low)
            low -= size
            file.seek(low)
            before = file.read(size)
            run += (found := size - len(before.rstrip(b"\\")))
            if found < size:
                break
        escaped = run % 2 == 1
        file.seek(start)
        left = stop - start if stop is not None else None
        while data := file.read(CHUNK if left is None else min(CHUNK, left)):
            left = None if left is None else left - len(data)
            if escaped:
                data = b" " + data[1:]
            data = _ESCAPED.sub(b"  ", data)
            escaped = data.endswith(b"\\")
            yield data


def _levels(data: bytes, inside: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each byte: itself, whether a string is open behind it, and by how much brackets outside strings change the depth."""
    codes = np.frombuffer(data, np.uint8)
    within = ((np.cumsum(codes == 34) + inside) & 1).astype(bool)
    step = ((codes == 123) | (codes == 91)).astype(np.int64) - ((codes == 125) | (codes == 93))
    return codes, within, step


def summary(path: str, start: int, stop: int) -> tuple[bool, list[tuple[int, int]]]:
    """What these bytes do to the state: whether they hold an odd number of quotes, and the depth's change and least value if they start outside or inside a string."""
    odd, found = False, [(0, 0), (0, 0)]
    for data in _blanked(path, start, stop):
        codes, within, step = _levels(data, odd)
        for entry in (0, 1):
            depth, low = found[entry]
            levels = depth + np.cumsum(np.where(within != bool(entry), 0, step))
            found[entry] = (int(levels[-1]), min(low, int(levels.min())))
        odd = bool(within[-1])
    return odd, found


def pieces(kind: str, edges: list[tuple[int, int]], summaries: list[tuple[bool, list[tuple[int, int]]]]) -> list[Piece]:
    """The state at the start of each of a file's pieces; none behind an array's end. The first summary is of what follows an array's bracket."""
    out, inside, depth = [], False, int(kind == "array")
    for (start, stop), (odd, found) in zip(edges, summaries, strict=True):
        out.append(Piece(start, stop, inside, depth))
        change, low = found[inside]
        if kind == "array" and depth + low <= 0:
            break
        inside, depth = inside != odd, depth + change
    return out


def _first_of(path: str, kind: str, piece: Piece) -> int | None:
    """Where the piece's first value may start: behind its first comma between an array's elements, or behind the value of a stream that it starts in."""
    if kind == "stream" and not piece.inside and piece.depth == 0:
        return _clear(path, piece.start)
    inside, depth, at = piece.inside, piece.depth, piece.start
    for data in _blanked(path, piece.start, piece.stop):
        codes, within, step = _levels(data, inside)
        step = np.where(within, 0, step)
        levels = depth + np.cumsum(step)
        if kind == "array":
            hits = ((codes == 44) & ~within & (levels == 1)) | (levels <= 0)
        else:
            hits = (levels == 0) & ~within & ((step < 0) | (codes == 34))
        if hits.any():
            i = int(hits.argmax())
            return None if kind == "array" and levels[i] <= 0 else at + i + 1
        inside, depth, at = bool(within[-1]), int(levels[-1]), at + len(data)
    return None


def _clear(path: str, at: int) -> int:
    """This place, or else the end of the number or literal that it stands in."""
    with open(path, "rb") as file:
        file.seek(max(0, at - 1))
        if at and file.read(1)[0] in _CLEAR:
            return at
        while c := file.read(1):
            if c[0] in _CLEAR:
                break
            at += 1
    return at


def values(path: str, kind: str = "", piece: Piece | None = None) -> Iterator[str]:
    """Texts of an array's elements (one comma may trail; what follows the array is ignored) or of all values of a stream.

    Of a piece, those whose comma, or in a stream whose first character, lies in it.
    """
    kind, piece = kind or shape(path), piece or Piece()
    start = _first_of(path, kind, piece) if piece.start else 0
    if start is None:
        return
    stop = piece.stop
    if kind == "stream":
        # where the next piece starts within a number, that is this one's
        stop = None if stop is None else _clear(path, stop)
        if stop is not None and start >= stop:
            return
        buffer = _Buffer(path, start, stop)
        while buffer.peek() and buffer.owned():
            yield buffer.value()
        return
    # a comma before `stop` may be the last byte there
    buffer = _Buffer(path, start, stop if stop is None or start < stop else None)
    if start == stop:
        buffer.limit = 0
    if not piece.start:
        buffer.peek()
        buffer.at += 1
        if buffer.peek() == ",":
            raise ConversionError("invalid JSON: the array starts with a comma")
    while True:
        c = buffer.peek()
        if c == "]":
            return
        if not c:
            raise ConversionError("invalid JSON: the array does not end")
        yield buffer.value()
        c = buffer.peek()
        if c == "," and not buffer.owned():
            return
        if c == ",":
            buffer.at += 1
        elif c != "]":
            raise ConversionError("invalid JSON: a comma is missing between elements" if c else "invalid JSON: the array does not end")
