"""The unsigned CRC-32 as DuckDB SQL, for the SQL counterparts of queries that use it."""

from __future__ import annotations

#: A common table expression ``crc_table`` with one row: the 256 remainders of single bytes.
CRC_TABLE = """crc_table AS (
    SELECT list(list_reduce(list_concat([i], range(8)),
        lambda r, step: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END) ORDER BY i) AS remainders
    FROM (SELECT unnest(range(256)) AS i))"""


def crc32(text: str) -> str:
    """CRC-32 of the UTF-8 bytes of a text expression; needs ``crc_table`` in the FROM clause."""
    values = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"
    step = "lambda c, b: xor(crc_table.remainders[(xor(c, b) & 255) + 1], c >> 8)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {values}), {step}), 4294967295)"
