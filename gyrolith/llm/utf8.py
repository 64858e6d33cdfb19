"""Bulk views of UTF-8 text: character starts, classes and packed words, without decoding strings."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import regex

LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3


@functools.cache
def class_table() -> np.ndarray:
    """Class of every code point: letter, number, white space or other."""
    out = np.full(0x110000, OTHER, np.uint8)
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for cls, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, everything):
            a, b = ord(m[0][0]), ord(m[0][-1])
            if b - a + 1 == len(m[0]):
                out[a : b + 1] = cls
            else:  # the run spans the surrogates
                out[[ord(c) for c in m[0]]] = cls
    return out


@functools.cache
def ascii_table() -> np.ndarray:
    out = np.full(256, OTHER, np.uint8)
    out[:128] = class_table()[:128]
    return out


def string_parts(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts on end and their n + 1 offsets; null counts as empty."""
    col = col.cast(pa.large_string())
    n = len(col)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64, n + 1, col.offset * 8)
    raw = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
    off = off - off[0]
    if col.null_count and (np.diff(off)[np.asarray(col.is_null())] > 0).any():
        return string_parts(pa.array(["" if x is None else x for x in col.to_pylist()], pa.large_string()))
    return raw, off


def characters(raw: np.ndarray) -> tuple[np.ndarray | None, np.ndarray]:
    """Byte position of each character (None if all are ASCII) and its class."""
    if not len(raw) or raw.max() < 128:
        return None, ascii_table()[raw]
    pos = np.flatnonzero((raw & 0xC0) != 0x80)
    lead = raw[pos]
    cls = ascii_table()[lead]
    wide = np.flatnonzero(lead >= 128)
    p, b = pos[wide], lead[wide].astype(np.int64)
    pad = np.r_[raw, np.zeros(4, np.uint8)]
    c1, c2, c3 = (pad[p + k].astype(np.int64) & 0x3F for k in (1, 2, 3))
    code = np.where(b < 0xE0, (b & 0x1F) << 6 | c1, np.where(b < 0xF0, (b & 0x0F) << 12 | c1 << 6 | c2, (b & 0x07) << 18 | c1 << 12 | c2 << 6 | c3))
    cls[wide] = class_table()[np.minimum(code, 0x10FFFF)]
    return pos, cls


def words64(raw: np.ndarray) -> np.ndarray:
    """View whose element i is the eight bytes from i on, as a little-endian integer."""
    pad = np.r_[raw, np.zeros(32, np.uint8)]
    return np.lib.stride_tricks.as_strided(pad.view(np.uint8)[: len(pad) // 8 * 8].view("<u8"), (len(raw) + 24,), (1,))


#: MASKS[n] keeps the first n bytes of an eight-byte word.
MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
