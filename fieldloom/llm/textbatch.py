"""Text columns of Arrow batches as flat byte arrays, for vectorised scans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that a vectorised step takes at once.  One longer text is a step of its own.
CHUNK_BYTES = 2 << 20

#: Odd multiplier of the rolling hash, and its inverse modulo 2**64.
_MULT = 0x9E3779B97F4A7C15
_MULT_INV = pow(_MULT, -1, 1 << 64)
_U64 = np.uint64
_powers: list[np.ndarray] = []


def text_values(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary column and its row offsets (int64, from 0); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, offsets - offsets[0]


def pieces(batch: pa.RecordBatch, column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch with at most ``most`` bytes of text each (one row at least)."""
    _, offsets = text_values(batch.column(batch.schema.get_field_index(column)))
    at, n = 0, batch.num_rows
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield batch.slice(at, min(end, n) - at)
        at = end


def byte_table(*ranges: tuple[int, int]) -> np.ndarray:
    """A lookup of 256 booleans, true in the given inclusive ranges."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


#: Bytes of words in [^\x20\x09-\x0D]+.
NOT_SPACE = ~byte_table((0x20, 0x20), (0x09, 0x0D))


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and counts per row of the maximal runs of true bytes; runs end at row ends."""
    n = len(inside)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets) - 1, np.int64)
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    first = offsets[:-1]
    before[first[first < n]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    last = offsets[1:] - 1
    after[last[last >= 0]] = False
    ends = np.flatnonzero(inside & ~after) + 1
    place = np.searchsorted(starts, offsets)
    return starts, ends, np.diff(place)


def _power_arrays(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1024)
        up, down = np.full(size, _MULT, _U64), np.full(size, _MULT_INV, _U64)
        up[0] = down[0] = 1
        both = np.cumprod(up), np.cumprod(down)
        if size > 4 * CHUNK_BYTES:  # one long text: don't keep its arrays
            return both
        _powers[:] = both
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit words."""
    x = x ^ (x >> _U64(30))
    x = x * _U64(0xBF58476D1CE4E5B9)
    x ^= x >> _U64(27)
    x = x * _U64(0x94D049BB133111EB)
    return x ^ (x >> _U64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: equal bytes give equal hashes in every batch, task and run."""
    up, down = _power_arrays(len(data) + 1)
    total = np.zeros(len(data) + 1, _U64)
    np.cumsum((data.astype(_U64) + _U64(1)) * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(_U64))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z as a-z; other bytes as they are."""
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def code_points_before(data: np.ndarray) -> np.ndarray:
    """For each byte place (and the end) the number of code points that begin before it."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


def row_texts(column: pa.Array) -> list[bytes]:
    """Each row's UTF-8 bytes; null counts as empty."""
    data, offsets = text_values(column)
    raw = data.tobytes()
    at = offsets.tolist()
    return [raw[a:b] for a, b in zip(at, at[1:])]
