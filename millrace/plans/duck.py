"""DuckDB SQL for what it has no function for."""

from __future__ import annotations


def crc32(text: str) -> str:
    """CRC-32 of a short ASCII text: bit by bit over its bytes."""
    return f"xor(list_reduce(list_concat([4294967295], list_transform(range(1, length({text}) + 1), lambda i: CAST(ascii({text}[i]) AS BIGINT))), lambda c, b: list_reduce(list_concat([xor(c, b)], [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
