"""Sample positions of texts that any long match shares: what a sparse suffix array is built on.

Of all windows of ``length`` bytes, each chooses as its anchor the position
whose following GRAM bytes have the smallest hash, the leftmost of equals. The
choice depends on the window's bytes alone: equal windows have equal anchors.
"""

from __future__ import annotations

import numpy as np

GRAM = 24
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]
_PLACE_BITS = np.uint64(36)


def order(data: bytes) -> np.ndarray:
    """A hash of the GRAM bytes from each position."""
    n = len(data) - GRAM + 1
    at = [np.ndarray((n,), "<u8", data, offset=8 * k, strides=(1,)) for k in range(3)]
    h = at[0] * _C[0]
    h ^= h >> np.uint64(32)
    h += at[1] * _C[1]
    h ^= h >> np.uint64(29)
    h *= _C[3]
    h += at[2] * _C[2]
    h ^= h >> np.uint64(32)
    h *= _C[3]
    return h


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive values: minima from the left and from the right of blocks meet."""
    n = len(x)
    pad = -n % w
    y = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]) if pad else x
    y = y.reshape(-1, w)
    left = np.minimum.accumulate(y, axis=1).ravel()
    right = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def anchors(data: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, anchor, first, last) of each run of windows that have the same anchor; key is a hash of the anchor's GRAM bytes, first and last are window starts."""
    n = len(data)
    if n < length:
        empty = np.empty(0, np.int64)
        return empty, empty, empty, empty
    place = np.arange(n - GRAM + 1, dtype=np.uint64)
    h = order(data)
    chosen = sliding_min(((h >> _PLACE_BITS) << _PLACE_BITS) | place, length - GRAM + 1) & np.uint64((1 << int(_PLACE_BITS)) - 1)
    first = np.flatnonzero(np.concatenate([[True], chosen[1:] != chosen[:-1]]))
    last = np.append(first[1:] - 1, len(chosen) - 1)
    at = chosen[first].astype(np.int64)
    key = h[at] * _C[1]  # anchors have small hashes: spread them again
    key = (key ^ (key >> np.uint64(31))) * _C[2]
    return (key ^ (key >> np.uint64(29))).view(np.int64), at, first, last
