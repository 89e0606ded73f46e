"""Texts of an Arrow batch as byte arrays of bounded size, for work by NumPy on many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BLOCK_BYTES = 1 << 19


def blocks(texts: list, block_bytes: int = BLOCK_BYTES, before: bytes = b" ", after: bytes = b" ", points: bool = False
           ) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, stop, bytes, offsets): texts first..stop-1, one after the other; text i is bytes[offsets[i]:offsets[i + 1]].

    A text is never cut: a block has at least one, and more only as long as they stay below ``block_bytes``. Null counts as
    empty. Each text stands between ``before`` and ``after``. With ``points`` there are code points in place of bytes.
    """
    encoding, unit = ("utf-32-le", np.uint32) if points else ("utf-8", np.uint8)
    before, after = (x.decode().encode(encoding) for x in (before, after))
    block_bytes *= np.dtype(unit).itemsize
    parts, offsets, first, total = [], [0], 0, 0
    for n, text in enumerate(texts):
        raw = before + (text or "").encode(encoding, "surrogatepass") + after
        if parts and total + len(raw) > block_bytes:
            yield first, n, np.frombuffer(b"".join(parts), unit), np.array(offsets) // np.dtype(unit).itemsize
            parts, offsets, first, total = [], [0], n, 0
        parts.append(raw)
        total += len(raw)
        offsets.append(total)
    if parts:
        yield first, len(texts), np.frombuffer(b"".join(parts), unit), np.array(offsets) // np.dtype(unit).itemsize


def distinct(values: np.ndarray) -> np.ndarray:
    """The different values in rising order, by sorting."""
    ordered = np.sort(values)
    if not len(ordered):
        return ordered
    return ordered[np.append(True, ordered[1:] != ordered[:-1])]
