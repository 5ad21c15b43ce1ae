"""Byte alphabet: every byte of a text as one printable symbol, and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bytes that stand for themselves in the byte alphabet. The other
# 68 bytes take the code points from U+0100 on, in byte order.
KEPT_RANGES = ((33, 126), (161, 172), (174, 255))

SPACE_SYMBOL = "Ġ"


def byte_symbols() -> list[str]:
    """The 256 symbols in byte order."""
    symbols, moved = [], 0
    for byte in range(256):
        if any(lo <= byte <= hi for lo, hi in KEPT_RANGES):
            symbols.append(chr(byte))
        else:
            symbols.append(chr(0x100 + moved))
            moved += 1
    return symbols


_MOVED = [(chr(b), s) for b, s in enumerate(byte_symbols()) if chr(b) != s]
_FROM = "".join(b for b, _ in _MOVED)
_TO = "".join(s for _, s in _MOVED)


def byte_view(text: Column) -> Column:
    """One character U+0000..U+00FF per byte of the text's UTF-8 form."""
    return F.decode(text.cast("binary"), "ISO-8859-1")


def text_of_byte_view(view: Column) -> Column:
    return F.decode(F.encode(view, "ISO-8859-1"), "UTF-8")


def symbols_of_byte_view(view: Column) -> Column:
    return F.translate(view, _FROM, _TO)


def to_byte_symbols(text: Column) -> Column:
    """Text to byte alphabet: one symbol per UTF-8 byte."""
    return symbols_of_byte_view(byte_view(text))


def from_byte_symbols(symbols: Column) -> Column:
    """Byte alphabet to text, the inverse of :func:`to_byte_symbols`."""
    return text_of_byte_view(F.translate(symbols, _TO, _FROM))
