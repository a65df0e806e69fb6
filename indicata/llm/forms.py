"""Ids of texts from the ids of their space-separated forms, each form encoded once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class FormMemory:
    """Remembers the ids of short forms, at most ``limit`` of them (then it starts anew).

    ``learn`` gives the ids of new forms, little-endian unsigned 32-bit.  Arrow
    splits the texts and numbers their distinct forms; numpy puts the ids of
    all forms back in text order.
    """

    def __init__(self, learn: Callable[[list[str]], dict[str, bytes]], limit: int, longest: int):
        self.learn, self.limit, self.longest = learn, limit, longest
        self.known: dict[str, bytes] = {"": b""}

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, where each text's ids start, and the end)."""
        if len(self.known) > self.limit:
            self.known = {"": b""}
        known = self.known
        split = pc.split_pattern(texts, " ")
        coded = split.flatten().dictionary_encode()
        forms = coded.dictionary.to_pylist()
        new = self.learn([f for f in forms if f not in known])
        known.update((f, v) for f, v in new.items() if len(f) <= self.longest)
        ids = [known[f] if f in known else new[f] for f in forms]
        blob = np.frombuffer(b"".join(ids), "<u4")
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        at = np.cumsum(size) - size
        index = coded.indices.to_numpy()
        sizes = size[index]
        ends = np.cumsum(sizes)
        small = ends.size == 0 or max(ends[-1], blob.size) < 1 << 31
        move = np.repeat((at[index] - (ends - sizes)).astype(np.int32 if small else np.int64), sizes)
        move += np.arange(move.size, dtype=move.dtype)
        starts = np.append(0, ends)[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return blob[move], starts
