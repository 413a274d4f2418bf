"""Code points of a batch of texts in one array, and tables over code points."""

from __future__ import annotations

from functools import lru_cache

import numpy as np


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts end to end, and offsets; bytes that are not UTF-8 become U+FFFD."""
    try:
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        first = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=first[1:])
        return points, first[offsets]
    except UnicodeDecodeError:
        texts = [data[a:b].tobytes().decode(errors="replace") for a, b in zip(offsets[:-1], offsets[1:])]
        at = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        return np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32), at


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x10000)])


@lru_cache(maxsize=1)
def _lower() -> np.ndarray:
    return np.array([ord(x) if len(x := chr(i).lower()) == 1 else i for i in range(0x10000)], np.uint32)


def _looked_up(points: np.ndarray, small: np.ndarray, rest) -> np.ndarray:
    if len(points) == 0 or points.max() < 0x10000:
        return small[points]
    out = small[np.minimum(points, 0xFFFF)]
    far = np.flatnonzero(points >= 0x10000)
    values, which = np.unique(points[far], return_inverse=True)
    out[far] = np.array([rest(chr(v)) for v in values])[which]
    return out


def is_letter(points: np.ndarray) -> np.ndarray:
    return _looked_up(points, _letters(), str.isalpha)


def lowered(points: np.ndarray) -> np.ndarray:
    return _looked_up(points, _lower(), lambda c: ord(c.lower()) if len(c.lower()) == 1 else ord(c))
