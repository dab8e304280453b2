"""SQL that several oracles share."""

from __future__ import annotations

#: A table of one row: the 256 steps of CRC-32 by a byte.
CRC32_STEPS = "SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i::BIGINT], range(8)), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS tab"


def crc32(text: str) -> str:
    """The unsigned CRC-32 of an ASCII text, where `tab` of CRC32_STEPS is at hand."""
    return f"xor(list_reduce(list_concat([4294967295], list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295)"
