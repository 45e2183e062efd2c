"""Arrow batches in and out of Spark tasks; words of UTF-8 text as numpy columns.

Work on bytes keeps whole texts in one contiguous buffer: a word is a run of bytes of one class
that ends at its document's end. Hashes are 64 bits wide and the same in every task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

HASH_BASE = np.uint64(0x9E3779B97F4A7C15)
MIX_1 = np.uint64(0xFF51AFD7ED558CCD)
MIX_2 = np.uint64(0xC4CEB9FE1A85EC53)
SLICE_ROWS = 512

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """Membership by byte value for inclusive ranges."""
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Everything but ASCII white space.
NOT_SPACE = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: ASCII digits and lower-case letters, and everything beyond ASCII.
ALNUM = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))


def sliced(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches of at most `rows` rows, so that what a step makes of one stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def arrow_schema(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


def record_batch(columns: dict, fields: pa.Schema) -> pa.RecordBatch:
    """Lists, numpy or Arrow columns as a batch of the stated types."""
    arrays = []
    for field in fields:
        column = columns[field.name]
        arrays.append(column.cast(field.type) if isinstance(column, pa.Array) else pa.array(column, field.type))
    return pa.RecordBatch.from_arrays(arrays, schema=fields)


def map_batches(df: DataFrame, schema: str, fn: Callable[[pa.RecordBatch], dict], rows: int = SLICE_ROWS) -> DataFrame:
    """Apply `fn` (batch -> columns by name) to slices of `df`; no shuffle."""
    fields = arrow_schema(schema)

    def run(batches):
        for batch in sliced(batches, rows):
            yield record_batch(fn(batch), fields)

    return df.mapInArrow(run, schema)


def filter_batches(df: DataFrame, columns: list[str], keep: Callable[[pa.RecordBatch], np.ndarray], rows: int = SLICE_ROWS) -> DataFrame:
    """The rows of `df`, all columns, for which `keep` (slice of `columns` -> mask) holds; no shuffle."""
    at = [df.columns.index(c) for c in columns]

    def run(batches):
        for batch in sliced(batches, rows):
            judged = pa.RecordBatch.from_arrays([batch.column(i) for i in at], names=columns)
            yield batch.filter(pa.array(keep(judged), pa.bool_()))

    return df.mapInArrow(run, df.schema)


def texts(column: pa.Array) -> list[str]:
    """Python strings; null reads as empty."""
    return [t or "" for t in column.to_pylist()]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in a row and the n + 1 offsets of the texts; null reads as empty."""
    plain = column.cast(pa.large_string()).fill_null("")
    plain = pa.concat_arrays([plain]) if plain.offset else plain
    _, offsets, data = plain.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[plain.offset : plain.offset + len(plain) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in `data`, and for each text the index of its first word (n + 1)."""
    flag = inside[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.concatenate(([False], flag[:-1])) & ~edge[:-1] if len(flag) else flag
    after = np.concatenate((flag[1:], [False])) & ~edge[1:] if len(flag) else flag
    starts = np.flatnonzero(flag & ~before)
    ends = np.flatnonzero(flag & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of the hash's base, or of its inverse, modulo 2 to the 64."""
    if len(_powers[inverse]) < n:
        base = pow(int(HASH_BASE), -1, 1 << 64) if inverse else int(HASH_BASE)
        steps = np.full(max(n, 1 << 20), base, dtype=np.uint64)
        steps[0] = 1
        _powers[inverse] = np.cumprod(steps)
    return _powers[inverse]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * MIX_1
    h = (h ^ (h >> np.uint64(33))) * MIX_2
    return h ^ (h >> np.uint64(33))


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, piece: int = 1 << 20) -> np.ndarray:
    """A 64-bit hash for each byte range, by prefix sums over pieces of about `piece` bytes."""
    out = np.zeros(len(starts), dtype=np.uint64)
    first = 0
    while first < len(starts):
        last = max(first + 1, int(np.searchsorted(ends, starts[first] + piece, side="right")))
        low, high = int(starts[first]), int(ends[last - 1])
        weight = powers(high - low)
        sums = np.zeros(high - low + 1, dtype=np.uint64)
        np.cumsum((data[low:high].astype(np.uint64) + np.uint64(1)) * weight[: high - low], out=sums[1:])
        a, b = starts[first:last] - low, ends[first:last] - low
        # Taking out the power of its start makes equal words equal wherever they stand.
        out[first:last] = mixed((sums[b] - sums[a]) * powers(high - low, inverse=True)[a] + (b - a).astype(np.uint64))
        first = last
    return out


def gram_hashes(items: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n consecutive items from each position that has n."""
    count = max(0, len(items) - n + 1)
    h = np.zeros(count, dtype=np.uint64)
    for k in range(n):
        h = mixed(h * HASH_BASE + items[k : k + count] + np.uint64(k + 1))
    return h


def stars(nodes: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 under links (a, b): the smallest node of each one's component."""
    label = np.arange(nodes)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new
