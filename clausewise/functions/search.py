"""First occurrences of many pieces in one text, in one pass.

All windows of the shortest piece's length are hashed by a rolling sum (one
multiplication and one running total per character, in numpy); a piece is looked
up by the hash of its first characters and compared where that hash occurs.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ODD = 0x9E3779B97F4A7C15           # multiplier of the rolling sum
INVERSE = pow(ODD, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def window_hashes(text: str, width: int) -> np.ndarray:
    """A 64-bit number of each window of `width` characters; equal windows have
    equal numbers."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    if len(points) < width:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        value = (points + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        value ^= value >> np.uint64(31)
        total = np.zeros(len(points) + 1, np.uint64)
        np.cumsum(value * _powers(ODD, len(points)), out=total[1:])
        return (total[width:] - total[:-width]) * _powers(INVERSE, len(points) - width + 1)


def first_places(text: str, pieces: list[str]) -> list[int]:
    """`text.find(piece)` of each piece."""
    width = min(map(len, pieces), default=0)
    if width == 0:
        return [text.find(p) for p in pieces]
    wanted: dict[int, list[str]] = {}
    for piece in dict.fromkeys(pieces):
        wanted.setdefault(int(window_hashes(piece[:width], width)[0]), []).append(piece)
    windows = window_hashes(text, width)
    at = np.flatnonzero(np.isin(windows, np.array(list(wanted), np.uint64)))
    found: dict[str, int] = {}
    for place, key in zip(at.tolist(), windows[at].tolist(), strict=True):
        open_pieces = wanted[key]
        if open_pieces:
            hits = [p for p in open_pieces if text.startswith(p, place)]
            if hits:
                found.update((p, place) for p in hits)
                wanted[key] = [p for p in open_pieces if p not in found]
    return [found.get(p, -1) for p in pieces]


def first_occurrences(text: Column, pieces: Column) -> Column:
    """array<int>: the first place of each piece in the text (null for a null text)."""
    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def places(texts: pd.Series, lists: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else first_places(t, list(p)) for t, p in zip(texts, lists, strict=True)], dtype=object)
    return places.asNondeterministic()(text, pieces)  # not inlined into later projections, so run once
