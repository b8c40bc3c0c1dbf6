"""Words of texts as numpy arrays, 64-bit keys of words and n-grams, and compact
byte strings of sorted keys and counts for shuffles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def doc_words(text: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words (runs of anything but ASCII white space, A-Z in lower case) of all
    texts: each word's code, the offset of each text's first word (and the end),
    and the distinct words by code."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(text))
    flat = lists.flatten()
    off = lists.offsets.to_numpy().astype(np.int64)
    off = off - off[0]
    there = pc.not_equal(pc.binary_length(flat), 0)
    kept = np.append(0, np.cumsum(there.to_numpy(zero_copy_only=False)))
    coded = flat.filter(there).dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    return codes, kept[off], coded.dictionary


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(k: int, base: np.uint64, n: int) -> np.ndarray:
    if len(_powers[k]) < n:
        more = np.full(max(n, 1024), base, np.uint64)
        more[0] = 1
        _powers[k] = np.cumprod(more)
    return _powers[k][:n]


def keys_of(strings: pa.Array) -> np.ndarray:
    """A 64-bit key of every string: two polynomials over its bytes, mixed."""
    n = len(strings)
    if n == 0:
        return np.empty(0, np.uint64)
    strings = strings.cast(pa.large_string())
    off = np.frombuffer(strings.buffers()[1], np.int64, count=strings.offset + n + 1)[strings.offset:]
    data = np.frombuffer(strings.buffers()[2], np.uint8)[off[0]:off[-1]] if off[-1] > off[0] else np.zeros(0, np.uint8)
    size = np.diff(off)
    out = mix(size.astype(np.uint64) + np.uint64(0x51ED27))
    some = size > 0
    if not some.any():
        return out
    starts = (off[:-1] - off[0])[some]
    longest = int(size.max())
    place = np.arange(len(data)) - np.repeat(starts, size[some])
    value = data.astype(np.uint64) + np.uint64(1)
    one = np.add.reduceat(value * _power(0, _M1, longest)[place], starts)
    two = np.add.reduceat(value * _power(1, _M2, longest)[place], starts)
    out[some] ^= mix(one) + mix(mix(two) ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    return out


def chain_keys(*parts: np.ndarray) -> np.ndarray:
    """The key of an n-gram from the keys of its words, in order."""
    h = parts[0]
    for p in parts[1:]:
        h = mix(h * _M1 + (p ^ _M2))
    return h


def planes(x: np.ndarray, width: int) -> bytes:
    """Unsigned integers as byte planes, lowest first, compressed (zstd): planes of
    zeros and of small counts shrink to little."""
    raw = np.ascontiguousarray(x.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T)
    return zstandard.ZstdCompressor(level=1).compress(raw)


def from_planes(data: bytes, width: int) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(width, -1)
    return np.ascontiguousarray(raw.T).view(f"<u{width}").ravel()


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending uint64 as byte planes of their differences."""
    return planes(np.diff(keys, prepend=np.uint64(0)), 8)


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(from_planes(data, 8), dtype=np.uint64)
