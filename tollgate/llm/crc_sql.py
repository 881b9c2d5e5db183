"""CRC-32 in SQL, for the queries that check an operator: one table and two expressions."""

from __future__ import annotations

#: A common table expression ``crc(t)``: the 256 remainders of the reflected polynomial.
TABLE = """crc AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM range(256) r(i)))"""


def of_text(text: str) -> str:
    """The unsigned CRC-32 of a text of code points below U+0800; ``crc.t`` must be in scope."""
    code = f"""list_transform(string_split({text}, ''), lambda x: CASE WHEN x = '' THEN []
      WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [192 + (unicode(x) >> 6)::BIGINT, 128 + (unicode(x) & 63)::BIGINT] END)"""
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, flatten({code})), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"
