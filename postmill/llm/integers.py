"""Exact integer vectors of any size: scaled floors, squared distances, and sums that Spark can add up.

Vectors whose squared distances stay below 2 to the 53 are float64 matrices, in which every step on
whole numbers is exact; anything larger is a matrix of Python integers.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMB = 32
LONGEST = (1 << 63) - 1
EXACT = float(1 << 53)


def sound(vec: Column) -> Column:
    """Whether an array is there and holds neither nulls nor NaN nor infinities."""
    return F.coalesce(F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def rectangle(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column in double precision, shorter ones filled up with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(len(column), width)
    out = np.zeros((len(column), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def floors(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), `scale` a power of two: float64 where that is exact for distances, else Python integers."""
    with np.errstate(over="ignore"):
        y = np.floor(scale * x)
    if fits(y):
        return y
    # A double so large that the product overflows is a whole number itself.
    return np.array([[int(b) if np.isfinite(b) else int(a) * scale for a, b in zip(p, q, strict=True)] for p, q in zip(x.tolist(), y.tolist(), strict=True)], object)


def fits(*rows: np.ndarray) -> bool:
    """Whether squared distances between any of these rows, and each term of them, are exact in float64."""
    most = max((float(np.abs(r).max()) if r.dtype != object else EXACT for r in rows if r.size), default=0.0)
    return max((r.shape[-1] for r in rows), default=1) * 4 * most * most < EXACT


def narrow(values: list) -> np.ndarray:
    """A matrix of Python integers as float64 where that is exact for distances."""
    rows = np.array(values, object)
    if rows.size and max(abs(v) for v in rows.ravel().tolist()) < 1 << 26 and fits(rows.astype(np.float64)):
        return rows.astype(np.float64)
    return rows


def alike(*rows: np.ndarray) -> list[np.ndarray]:
    """The matrices as one kind: float64 if that is exact for all together."""
    if all(r.dtype != object for r in rows) and fits(*rows):
        return list(rows)
    return [r if r.dtype == object else np.array([[int(v) for v in p] for p in r.tolist()], object).reshape(r.shape) for r in rows]


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows to rows (n, m), both matrices of one kind."""
    if a.dtype != object:
        return (a * a).sum(axis=1)[:, None] - 2 * (a @ b.T) + (b * b).sum(axis=1)
    out = np.empty((len(a), len(b)), object)
    for i, p in enumerate(a.tolist()):
        out[i] = [sum((x - y) ** 2 for x, y in zip(p, q, strict=True)) for q in b.tolist()]
    return out


def roots(d: np.ndarray) -> np.ndarray:
    """Square roots in float64, infinite where too large for that."""
    if d.dtype != object:
        return np.sqrt(d)
    return np.sqrt(np.array([float(v) if v < 1 << 1023 else np.inf for v in d.ravel().tolist()]).reshape(d.shape))


def longs(values: Iterable) -> list[int | None]:
    """Whole numbers as longs; null beyond what a long holds."""
    return [v if v <= LONGEST else None for v in map(int, values)]


def as_lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A matrix as an Arrow list column."""
    at = np.arange(0, rows.size + 1, max(rows.shape[1], 1), dtype=np.int32)
    return pa.ListArray.from_arrays(at, pa.array(rows.reshape(-1), kind))


class Totals:
    """Sums of Python integers per key, kept by a task and sent on in limbs of 32 bits."""

    def __init__(self, keys: int, width: int):
        self.sums = np.zeros((keys, width), object)

    def add(self, key: int, at: slice | int, values) -> None:
        if isinstance(at, int):
            self.sums[key, at] += int(values)
        else:
            self.sums[key, at] += np.array([int(v) for v in values], object)

    def limbs(self) -> tuple[list[int], list[int], list[list[int]]]:
        """Keys, limb numbers and limb values; the topmost limb carries the sign."""
        keys, numbers, values = [], [], []
        for key, row in enumerate(self.sums.tolist()):
            n = 0
            while any(row) or n == 0:
                top = all(-(1 << LIMB) < v < 1 << LIMB for v in row)
                keys.append(key), numbers.append(n)
                values.append(row if top else [v & ((1 << LIMB) - 1) for v in row])
                row = [0] * len(row) if top else [v >> LIMB for v in row]
                n += 1
        return keys, numbers, values


def collect_totals(limbs: DataFrame, keys: int, width: int) -> list[list[int]]:
    """Sums (keys, width) of rows (key, limb, sums): combined by Spark, put together as Python integers."""
    each = limbs.select("key", "limb", F.posexplode("sums").alias("at", "value"))
    out = [[0] * width for _ in range(keys)]
    for row in each.groupBy("key", "limb", "at").agg(F.sum("value").alias("value")).collect():
        out[row.key][row.at] += row.value << (LIMB * row.limb)
    return out
