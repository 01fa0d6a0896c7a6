"""Single-byte charsets as JVM expressions, mojibake reversal and encoding detection.

Every byte 0x80-0xFF of a charset is one character, so a line is decoded as Latin-1
and its upper characters are translated; encoding goes the other way. Bytes that a
Python codec leaves undefined stand for the control character of the same value, as
the web's encoding standard has it.
"""

from __future__ import annotations

import codecs
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabmend.config import DETECT_BYTES
from tabmend.options import ConversionError

#: Labels of single-byte charsets that the web's standard reads as another charset.
LABELS = {"latin1": "windows-1252", "iso-8859-1": "windows-1252", "ascii": "windows-1252", "us-ascii": "windows-1252", "cp1252": "windows-1252", "cp1251": "windows-1251", "cp1250": "windows-1250", "iso-8859-9": "windows-1254", "latin5": "windows-1254", "tis-620": "windows-874", "koi8": "koi8-r", "cp866": "ibm866"}
#: Single-byte charsets and the Python codec of each.
SINGLE_BYTE = {f"windows-125{i}": f"cp125{i}" for i in range(9)} | {"windows-874": "cp874", "koi8-r": "koi8_r", "koi8-u": "koi8_u", "ibm866": "cp866", "macintosh": "mac_roman", "x-mac-cyrillic": "mac_cyrillic"} | {f"iso-8859-{i}": f"iso8859_{i}" for i in (2, 3, 4, 5, 6, 7, 8, 10, 13, 14, 15, 16)}
#: Charsets of more than one byte and the Python codec of each.
MULTI_BYTE = {"utf-8": "utf-8", "utf-16le": "utf-16-le", "utf-16be": "utf-16-be", "shift_jis": "cp932", "euc-jp": "euc_jp", "iso-2022-jp": "iso2022_jp", "gbk": "gbk", "gb18030": "gb18030", "big5": "big5hkscs", "euc-kr": "cp949"}
_ALIASES = {"utf8": "utf-8", "utf-16": "utf-16le", "sjis": "shift_jis", "shift-jis": "shift_jis", "gb2312": "gbk"}


def canonical(label: str) -> str:
    """The lower-case name of a charset, or an error."""
    name = label.strip().lower()
    name = LABELS.get(name, _ALIASES.get(name, name))
    if name not in SINGLE_BYTE and name not in MULTI_BYTE:
        raise ConversionError(f"unknown encoding {label!r}")
    return name


def single_byte(label: str) -> str:
    name = canonical(label)
    if name not in SINGLE_BYTE:
        raise ConversionError(f"{label!r} is not a single-byte encoding")
    return name


def upper_half(name: str) -> str:
    """The characters of the bytes 0x80-0xFF."""
    codec = SINGLE_BYTE[single_byte(name)]
    return "".join(bytes([b]).decode(codec, "replace").replace("�", chr(b)) for b in range(128, 256))


_LATIN_UPPER = "".join(map(chr, range(128, 256)))


def decode_single_byte(data: Column, label: str) -> Column:
    """Text of binary data in a single-byte charset."""
    return F.translate(F.decode(data, "ISO-8859-1"), _LATIN_UPPER, upper_half(label))


def encode_single_byte(text: Column, label: str) -> Column:
    """Bytes of a text in a single-byte charset, NULL where a character has none."""
    upper = upper_half(label)
    allowed = "".join(re.escape(c) if c.isascii() else c for c in upper)
    able = text.rlike(rf"\A[\x00-\x7F{allowed}]*\z")
    return F.when(able, F.encode(F.translate(text, upper, _LATIN_UPPER), "ISO-8859-1"))


def unmojibake(cell: Column, label: str) -> Column:
    """UTF-8 that was read as a single-byte charset, read again; other cells unchanged."""
    plain = cell.rlike(r"\A[\x00-\x7F]*\z")
    again = encode_single_byte(cell, label).cast("string")
    return F.when(~plain & again.isNotNull() & F.is_valid_utf8(again) & (again != cell), again).otherwise(cell)


def bom(data: bytes) -> tuple[str, int] | None:
    """Charset and length of a byte order mark."""
    for mark, name in ((codecs.BOM_UTF8, "utf-8"), (codecs.BOM_UTF16_LE, "utf-16le"), (codecs.BOM_UTF16_BE, "utf-16be")):
        if data.startswith(mark):
            return name, len(mark)
    return None


def is_utf8(data: bytes) -> bool:
    """Valid UTF-8, but for a character that the end cuts."""
    try:
        codecs.getincrementaldecoder("utf-8")().decode(data)
    except UnicodeDecodeError:
        return False
    return True


def guess(data: bytes, candidates: tuple[str, ...] = ("windows-1252", "windows-1251", "windows-1250", "koi8-r", "ibm866", "windows-1253", "windows-1254")) -> str:
    """A single-byte charset by how much its reading looks like words: letters beside letters, mostly lower case, of one script."""
    import unicodedata

    def script(c: str) -> str:
        return unicodedata.name(c, "?").split(" ")[0]

    best, most = candidates[0], float("-inf")
    for name in candidates:
        upper = upper_half(name)
        text = "".join(chr(b) if b < 128 else upper[b - 128] for b in data[:DETECT_BYTES])
        score = 0.0
        for i, c in enumerate(text):
            if c.isascii():
                continue
            before = text[i - 1] if i else " "
            after = text[i + 1] if i + 1 < len(text) else " "
            if not c.isalpha():
                score -= 2 if unicodedata.category(c) == "Cc" else 0.3
                continue
            kin = [x for x in (before, after) if x.isalpha()]
            score += 0.5 + sum(0.5 if script(x) == script(c) else -0.75 for x in kin)
            score += 0.3 if c.islower() else (-0.8 if any(x.islower() for x in (before,)) else 0)
            if script(c) == "LATIN" and all(not x.isascii() for x in kin) and kin:
                score -= 0.5  # Latin words seldom are accents throughout
        if score > most + 1e-9:
            best, most = name, score
    return best


def detect_encoding(data: bytes) -> str:
    """By byte order mark, UTF-8 validity, escapes and pairs of Asian charsets, or else the best single-byte guess."""
    data = data[:DETECT_BYTES]
    if found := bom(data):
        return found[0]
    if b"\x1b$" in data and all(b < 128 for b in data):
        return "iso-2022-jp"
    if is_utf8(data):
        return "utf-8"
    single = guess(data)
    for name in ("shift_jis", "euc-jp", "euc-kr", "gb18030", "big5"):
        text = _read(data, MULTI_BYTE[name])
        if text and (wide := [c for c in text if not c.isascii()]):
            kana = sum("぀" <= c <= "ヿ" for c in wide)
            hangul = sum("가" <= c <= "힣" for c in wide)
            han = sum("一" <= c <= "鿿" for c in wide)
            need = {"shift_jis": kana, "euc-jp": kana, "euc-kr": hangul, "gb18030": han, "big5": han}[name]
            # an accent and the letter behind it also read as one wide character, which then mostly stands alone
            alone = sum(not c.isascii() and a.isascii() and b.isascii() for a, c, b in zip(" " + text, text, text[1:] + " ", strict=False))
            if need >= 0.4 * len(wide) and kana + hangul + han >= 0.8 * len(wide) and alone <= 0.5 * len(wide):
                return name
    return single


def _read(data: bytes, codec: str) -> str | None:
    for cut in range(4):  # the sample may cut a character
        try:
            return data[: len(data) - cut].decode(codec)
        except UnicodeDecodeError:
            continue
    return None
