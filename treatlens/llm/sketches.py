"""Fast similarity sketching: fixed-size sketches of sets, and hashes of their bands.

A set fills the coordinates of its sketch in rounds: in round i every element is
hashed to one coordinate and the value (i, hash); after as many rounds as there
are coordinates, round ``coordinates + b`` gives all elements to coordinate b. A
sketch is done once every coordinate holds a value, after one or two rounds for
large sets, so its cost does not grow with elements times coordinates.
"""

from __future__ import annotations

import numpy as np

_EMPTY = np.uint64(2**64 - 1)
_FRACTION = 54


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _seed(i: int) -> np.uint64:
    return _mix(np.array([(i + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)], np.uint64))[0]


def sketch(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """One row of ``coordinates`` values per non-empty set; equal with a chance of the sets' similarity."""
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    items = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    out = np.full((len(sets), coordinates), _EMPTY)
    flat, t = out.reshape(-1), np.uint64(coordinates)
    for i in range(2 * coordinates):
        if not len(items):
            break
        mixed = _mix(items ^ _seed(i))
        value = (_mix(mixed) >> np.uint64(64 - _FRACTION)) | np.uint64(i << _FRACTION)
        bins = ((mixed >> np.uint64(32)) * t >> np.uint64(32)).astype(np.int64) if i < coordinates else i - coordinates
        np.minimum.at(flat, owner * coordinates + bins, value)
        open_ = (out == _EMPTY).any(axis=1)[owner]
        items, owner = items[open_], owner[open_]
    return out


def band_keys(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """A hash per band of ``rows`` coordinates of each set's sketch; bands of different place have different hashes."""
    parts = sketch(sets, bands * rows).reshape(len(sets), bands, rows)
    key = np.broadcast_to(_mix(np.arange(1, bands + 1, dtype=np.uint64)), parts.shape[:2]).copy()
    for r in range(rows):
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return key
