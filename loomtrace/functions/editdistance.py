"""Edit distance of token lists, bit-parallel: no bound on their lengths, memory in proportion to them."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def distance(left: Sequence[str], right: Sequence[str]) -> int:
    """Fewest insertions, deletions and replacements that turn one list into the other.

    One column of the distance table is a pair of whole numbers whose bits say where it rises and falls, so a token of the shorter
    list costs a few operations on numbers of as many bits as the longer list has tokens. What both ends share is cut off first.
    """
    start, shorter = 0, min(len(left), len(right))
    while start < shorter and left[start] == right[start]:
        start += 1
    ends = 0
    while ends < shorter - start and left[len(left) - 1 - ends] == right[len(right) - 1 - ends]:
        ends += 1
    long_, short = sorted((left[start : len(left) - ends], right[start : len(right) - ends]), key=len, reverse=True)
    rows = len(long_)
    if not len(short):
        return rows
    places: dict[str, int] = {}
    wanted = set(short)
    for place, token in enumerate(long_):
        if token in wanted:
            places.setdefault(token, []).append(place)
    masks = {token: _bits(found, rows) for token, found in places.items()}
    every, lowest = (1 << rows) - 1, 1 << (rows - 1)
    rises, falls, total = every, 0, rows
    for token in short:
        same = masks.get(token, 0)
        even = ((((same & rises) + rises) ^ rises) | same | falls) & every
        up = falls | (every & ~(even | rises))
        down = even & rises
        total += bool(up & lowest) - bool(down & lowest)
        up = ((up << 1) | 1) & every
        rises = ((down << 1) & every) | (every & ~(even | up))
        falls = even & up
    return total


def _bits(places: list[int], size: int) -> int:
    raw = bytearray(size // 8 + 1)
    for place in places:
        raw[place >> 3] |= 1 << (place & 7)
    return int.from_bytes(raw, "little")


@F.pandas_udf(T.LongType())
def token_distance(left: pd.Series, right: pd.Series) -> pd.Series:
    """Distance of two array columns; NULL if either is NULL."""
    return pd.Series([None if a is None or b is None else distance(list(a), list(b)) for a, b in zip(left, right, strict=True)], dtype="Int64")
