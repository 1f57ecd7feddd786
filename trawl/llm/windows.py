"""Pieces of texts in which repeated windows can lie.

The anchor of a window of LENGTH bytes is the leftmost of its ANCHOR-byte strings with the least hash: it depends on the
window's content alone, so equal windows have it at the same offset. Offsets are cut into ranges of SPREAD; the windows of
one anchor and one range form a piece, and what all of them could share, LENGTH - SPREAD + 1 bytes at a fixed place from
the anchor, is its core. So windows can only be equal if their pieces have equal cores, and then they start at the same
distance before the core: pieces of one core are aligned by it.

Equal pieces that follow each other at equal steps, as in a text of one repeated byte, are one run: its first piece, the
number of them and the distance to the last.
"""

from __future__ import annotations

import numpy as np

from trawl.llm.shared import mix64, powers

LENGTH = 200
ANCHOR = 32
SPREAD = 85


_SALTED = mix64(np.arange(256, dtype=np.uint64) + np.uint64(77))


def byte_sums(data: np.ndarray, salted: bool = False) -> np.ndarray:
    """Prefix sums of a polynomial in the bytes, from which the hash of any string of data follows; salted: in a second one."""
    sums = np.zeros(len(data) + 1, np.uint64)
    values = _SALTED[data] if salted else data.astype(np.uint64) + np.uint64(1)
    np.cumsum(values * powers(len(data))[0][: len(data)], out=sums[1:])
    return sums


def string_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix64((sums[end] - sums[start]) * powers(len(sums) - 1)[1][start])


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of `width` values, by block-wise prefix and suffix minima."""
    n = len(values)
    pad = -n % width
    blocks = np.concatenate([values, np.full(pad, np.uint64(0xFFFFFFFFFFFFFFFF))]).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def pieces(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR, spread: int = SPREAD) -> dict[str, np.ndarray]:
    """Arrays by run of equal pieces: text (number), core_at (in data), left, right, core, piece, twin, times, reach.

    The first piece's windows start at core_at - left up to core_at + right - (spread - 1); its bytes are data[core_at - left :
    core_at + length - spread + 1 + right]. core and piece are hashes of the core, and of all bytes with the core's place; twin
    is a second one of the same. The core of the last of `times` pieces lies `reach` behind the first one's.
    """
    n, most = len(data), length - anchor + 1
    if n < length:
        none = np.zeros(0, np.int64)
        return dict.fromkeys(("text", "core_at", "left", "right", "times", "reach"), none) | dict.fromkeys(("core", "piece", "twin"), none.astype(np.uint64))
    sums = byte_sums(data)
    at = np.arange(n - anchor + 1)
    low = np.uint64(0xFFFFFFFF)
    ranked = (string_hash(sums, at, at + anchor) & ~low) | at.astype(np.uint64)
    place = (sliding_minimum(ranked, most) & low).astype(np.int64)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: n - length + 1]
    start = np.flatnonzero(np.arange(n - length + 1) + length <= offsets[1:][owner])
    place, owner = place[start], owner[start]
    part = (place - start) // spread
    head = np.ones(len(start), bool)
    head[1:] = (place[1:] != place[:-1]) | (part[1:] != part[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(head)
    last = np.append(first[1:], len(start)) - 1
    core_at = place[first] - part[first] * spread
    left, right = core_at - start[first], start[last] - core_at + spread - 1
    core_end = core_at + length - spread + 1
    core = mix64(string_hash(sums, core_at, core_end) + part[first].astype(np.uint64))
    shape = (left * 4096 + right).astype(np.uint64)
    piece = mix64(string_hash(sums, core_at - left, core_end + right) + mix64(shape + core))
    twin = mix64(string_hash(byte_sums(data, True), core_at - left, core_end + right) + mix64(shape))
    text = owner[first]
    # a run goes on while piece and step stay the same and the pieces' bytes touch
    step = np.diff(core_at)
    equal = (core[1:] == core[:-1]) & (piece[1:] == piece[:-1]) & (twin[1:] == twin[:-1]) & (text[1:] == text[:-1]) & (step <= length)
    goes_on = equal.copy()
    goes_on[1:] &= ~equal[:-1] | (step[1:] == step[:-1])
    runs = np.flatnonzero(np.concatenate([[True], ~goes_on])) if len(core) else np.zeros(0, np.int64)
    ends = np.append(runs[1:], len(core)) - 1
    out = {"text": text, "core_at": core_at, "left": left, "right": right, "core": core, "piece": piece, "twin": twin}
    return {k: v[runs] for k, v in out.items()} | {"times": ends - runs + 1, "reach": core_at[ends] - core_at[runs]}
