"""Content-defined anchors: every window of a text holds one, and equal windows hold it at the same place."""

from __future__ import annotations

import numpy as np

from .common import SpanHasher

GRAM = 32


def anchors(data: np.ndarray, offsets: np.ndarray, window: int, hasher: SpanHasher) -> dict[str, np.ndarray]:
    """For each anchor: its ``row``, the first and last start (``lo``, ``hi``, in ``data``) of the windows it stands for,
    its place ``at``, and a hash ``gram`` of the anchor.

    The anchor of a window is the gram in it with the least hash, the leftmost of equals. Needs data under 2**24 bytes.
    """
    n = len(data)
    starts = np.concatenate([np.arange(a, b - window + 1) for a, b in zip(offsets[:-1], offsets[1:], strict=True) if b - a >= window] or [np.zeros(0, np.int64)])
    if not len(starts):
        empty = np.zeros(0, np.int64)
        return {k: empty for k in ("row", "lo", "hi", "at")} | {"gram": empty.astype(np.uint64)}
    if n >= 1 << 24:
        raise ValueError("anchors are taken of less than 2**24 bytes at a time")
    prefix = hasher.prefix(data)
    place = np.arange(n - GRAM + 1)
    gram = hasher.spans(prefix, place, place + GRAM)
    key = (gram >> np.uint64(24) << np.uint64(24)) | place.astype(np.uint64)
    width = window - GRAM + 1
    padded = np.full(-(-len(key) // width) * width, np.uint64(2**64 - 1))
    padded[: len(key)] = key
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(behind[starts], ahead[starts + width - 1])
    at = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
    # Windows of one anchor follow one another; a new text starts anew.
    first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)]))
    last = np.append(first[1:], len(at)) - 1
    lo, hi, at = starts[first], starts[last], at[first]
    return {"row": np.searchsorted(offsets, lo, side="right") - 1, "lo": lo, "hi": hi, "at": at, "gram": gram[at]}
