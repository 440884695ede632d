"""Words and rolling hashes of whole Arrow string columns in numpy.

Texts are handled as UTF-8 bytes; the six white-space characters that separate words are single bytes, so bytes are
enough to find words. Hashes are 64-bit: a polynomial over mixed bytes modulo 2**64, finished by a mixing step.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Bytes of text that are worked on at once; a longer text is worked on by itself.
CHUNK = 1 << 20
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_power = {1: np.ones(1, U), -1: np.ones(1, U)}


def mix(h: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that every input bit reaches every output bit."""
    h = h ^ (h >> U(30))
    h = h * U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> U(27))
    h = h * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


BYTE = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))


def powers(n: int, sign: int = 1) -> np.ndarray:
    """The first n powers of the base (sign -1: of its inverse) modulo 2**64."""
    if len(_power[sign]) < n:
        step = U(_BASE if sign == 1 else pow(_BASE, -1, 1 << 64))
        grown = np.full(max(n, CHUNK + 64), step, U)
        grown[0] = 1
        _power[sign] = np.cumprod(grown, dtype=U)
    return _power[sign][:n]


def prefix(values: np.ndarray) -> np.ndarray:
    """P with P[i] = sum over j < i of values[j] * base**j; a span's hash is (P[e] - P[s]) * base**-s."""
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values * powers(len(values)), out=out[1:])
    return out


def spans(pre: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Mixed hashes of the spans [starts, ends); equal content of equal length gives equal hashes."""
    h = (pre[ends] - pre[starts]) * powers(len(pre), -1)[starts]
    return mix(h + (ends - starts).astype(U) * U(0xD6E8FEB86659FD93))


try:
    _libc = ctypes.CDLL("libc.so.6")
except OSError:  # not glibc: nothing to hand back
    _libc = None


def trim() -> None:
    """Give freed memory back to the system: a Python worker lives on between tasks and stages."""
    pa.default_memory_pool().release_unused()
    if _libc is not None:
        _libc.malloc_trim(0)


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets into them) of a string or binary column; null is empty. ``size`` bytes at most, or one text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64 if large else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + size, "right")) - 1)
        b = min(b, n)
        yield a, b, data[offs[a] : offs[b]], offs[a : b + 1] - offs[a]
        a = b
    trim()


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of all rows, and how many words each row has."""
    inside = ~IS_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    real = offs[1:] > offs[:-1]
    heads, tails = offs[:-1][real], offs[1:][real] - 1
    first[heads] = inside[heads]
    last[tails] = inside[tails]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    at = np.searchsorted(starts, offs)
    return starts, ends, np.diff(at)


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n successive word hashes, rows not regarded."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U)
    out = np.full(m, n, U)
    for i in range(n):
        out = mix(out * U(0xFF51AFD7ED558CCD) + h[i : i + m])
    return out


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
