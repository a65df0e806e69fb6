"""Words of many texts at once, in Arrow arrays.

Separators and capitals are single ASCII bytes, so a table over byte values
maps a whole UTF-8 buffer without decoding it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes A-Z as a-z, all others as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32


def table(separators: bytes, to: bytes, base: np.ndarray = LOWER) -> np.ndarray:
    """``base`` with every byte of ``separators`` made ``to``."""
    out = base.copy()
    out[np.frombuffer(separators, np.uint8)] = to[0]
    return out


def mapped(texts: pa.Array, by: np.ndarray) -> pa.StringArray:
    """``texts`` with each byte exchanged by the table; null is empty."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    _, offsets, data = texts.buffers()
    if data is None or not len(texts):
        return texts
    at = np.frombuffer(offsets, np.int32)[texts.offset:texts.offset + len(texts) + 1]
    body = by[np.frombuffer(data, np.uint8)[at[0]:at[-1]]]
    return pa.StringArray.from_buffers(len(texts), pa.py_buffer(at - at[0]), pa.py_buffer(body))


def split(texts: pa.Array, at: str) -> tuple[np.ndarray, pa.Array]:
    """(text number, part) of all parts between the separators, empty ones left out."""
    parts = pc.split_pattern(texts, at)
    rows, flat = pc.list_parent_indices(parts), parts.flatten()
    some = pc.greater(pc.binary_length(flat), 0)
    return rows.filter(some).to_numpy().astype(np.int64), flat.filter(some)


def expand(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, .. (size[0] of them), first[1], .."""
    at = np.cumsum(size) - size
    return np.repeat(first - at, size) + np.arange(int(size.sum()))
