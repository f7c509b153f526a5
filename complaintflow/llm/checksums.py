"""Checksums that the comparison database lacks, as SQL."""

from __future__ import annotations


def crc32_sql(ascii_text: str) -> str:
    """The unsigned CRC-32 (polynomial EDB88320) of an expression whose value has ASCII characters only."""
    step = "list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda v, z: xor(v >> 1, (v & 1) * 3988292384))"
    codes = f"list_transform(string_split({ascii_text}, ''), lambda x: CAST(ascii(x) AS BIGINT))"
    # list_reduce starts from the first element: 2^32 - 1
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {codes}), lambda c, b: {step.replace('[0,', '[0::BIGINT,')}), 4294967295::BIGINT)"
