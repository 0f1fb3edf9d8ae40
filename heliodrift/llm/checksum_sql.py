"""CRC-32 in SQL for DuckDB, which has no such function."""

from __future__ import annotations

_POLYNOMIAL = 0xEDB88320


def _table() -> list[int]:
    """What four shifts make of each value of the low four bits."""
    out = []
    for value in range(16):
        for _ in range(4):
            value = (value >> 1) ^ (_POLYNOMIAL if value & 1 else 0)
        out.append(value)
    return out


def crc32_sql(text: str) -> str:
    """The unsigned checksum of the UTF-8 bytes of a SQL expression, four bits at a time."""
    digits = f"hex({text})"
    # The low digit of each byte goes before its high one.
    low_first = (
        f"[instr('0123456789ABCDEF', substr({digits}, CASE WHEN k % 2 = 0 THEN k + 2 ELSE k END, 1)) - 1 "
        f"FOR k IN range(length({digits}))]"
    )
    step = f"xor(c >> 4, {_table()}[(xor(c, n) & 15) + 1])"
    return f"xor(list_reduce(list_prepend(4294967295, {low_first}), lambda c, n: {step}), 4294967295)"
