"""What the operators agree on about texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASCII white space between words; everything else belongs to a word.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """The words of a text as an array; NULL text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


#: Bytes a value of a type takes, about; anything else is taken to be text.
WIDTHS = {"boolean": 1, "int": 4, "bigint": 8, "double": 8}
BROADCAST_BYTES = 48 << 20


def sized_join(left: DataFrame, right: DataFrame, on: str, how: str, limit: int | None = None) -> DataFrame:
    """Join that broadcasts a narrow right side only when it was counted to have few rows; otherwise both sides are shuffled.

    limit: rows, otherwise as many as BROADCAST_BYTES hold by the widths of their types and 24 bytes of a hash table.
    """
    if limit is None:
        limit = BROADCAST_BYTES // (24 + sum(WIDTHS.get(kind, 40) for _, kind in right.dtypes))
    if right.limit(limit + 1).count() <= limit:
        right = F.broadcast(right)
    return left.join(right, on, how)
