"""Column-wise construction of the order and common prefixes of many strings at once, in sequential external files.

As in the constructions of Bauer, Cox and Rosone and of Durbin, all strings grow by one symbol a round, from the right. The
next order is the stable sort of the present one by the symbols put in front, which are the round's column of the
Burrows-Wheeler transform; a common prefix is one more than the least prefix between two neighbours with equal symbols.

The strings are aligned at a core, which counts as one symbol, so equal windows lie in one column; order and prefixes are
kept by column, and a column that is done is dropped. Three kinds of files lie in a folder that the caller names, all
written once and read once from front to back: the columns of a block of strings, in the order of the rounds; the order; and
the prefixes. A round reads the last order and prefixes in blocks and writes the next ones symbol by symbol. In memory stay
a few bytes a string, not the strings.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np

from trawl.llm.shared import open_fs

#: Strings of one file of columns, and places of an order that are read at once.
BLOCK = 1 << 16


def range_minimum(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """min(values[low : high + 1]) for pairs low <= high, by tables of minima over powers of two."""
    level = np.frexp((high - low + 1).astype(float))[1] - 1
    out = np.empty(len(low), values.dtype)
    table, width = values, 1
    for k in range(int(level.max(initial=0)) + 1):
        own = np.flatnonzero(level == k)
        if len(own):
            out[own] = np.minimum(table[low[own]], table[high[own] - width + 1])
        if 2 * width <= len(values):
            table = np.minimum(table[:-width], table[width:])
            width *= 2
    return out


class Files:
    """The files of one collection, below a folder; a name is written anew under a number of its own."""

    def __init__(self, folder: str) -> None:
        self.fs, path = open_fs(f"{folder}/{uuid.uuid4().hex}")
        self.path, self.number = path, 0
        self.fs.create_dir(path)

    def write(self) -> tuple[str, object]:
        self.number += 1
        name = f"{self.path}/{self.number}"
        return name, self.fs.open_output_stream(name)

    def read(self, name: str):
        return self.fs.open_input_stream(name)

    def delete(self, name: str) -> None:
        self.fs.delete_file(name)

    def close(self) -> None:
        self.fs.delete_dir(self.path)


class Collection:
    """Strings left + core + right; core holds a number for each, left and right fewer than `spread` bytes."""

    def __init__(self, core: np.ndarray, left: list[bytes], right: list[bytes], spread: int, folder: str) -> None:
        self.n, self.spread, self.files = len(core), spread, Files(folder)
        self.core = np.unique(core, return_inverse=True)[1].ravel().astype(np.int64)
        self.left_size = np.array([len(x) for x in left], np.int64)
        self.right_size = np.array([len(x) for x in right], np.int64)
        self.blocks = []
        for at in range(0, self.n, BLOCK):
            name, out = self.files.write()
            with out:
                # right edges begin at the core and are put in from their end; left edges end at the core
                out.write(self._table(right[at : at + BLOCK], False)[::-1].tobytes())
                out.write(self._table(left[at : at + BLOCK], True)[::-1].tobytes())
            self.blocks.append((self.files.read(name), min(BLOCK, self.n - at)))

    def _table(self, edges: list[bytes], from_end: bool) -> np.ndarray:
        """Row c holds the symbols + 1 of column c, 0 where a string has none."""
        width = self.spread - 1
        sizes = np.array([len(x) for x in edges], np.int64)
        table = np.zeros((width, len(edges)), np.uint16)
        flat = np.frombuffer(b"".join(edges), np.uint8)
        owner = np.repeat(np.arange(len(edges)), sizes)
        nth = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        table[width - sizes[owner] + nth if from_end else nth, owner] = flat.astype(np.uint16) + 1
        return table

    def _column(self) -> np.ndarray:
        """The next column of all strings."""
        return np.concatenate([np.frombuffer(file.read(2 * n), np.uint16) for file, n in self.blocks])

    def columns(self) -> Iterator[tuple[int, Iterator[tuple[np.ndarray, np.ndarray]]]]:
        """(distance before the core, blocks of order and common prefixes) of each column from the core leftwards; order holds
        the strings that have reached the column, sorted by their suffix there; a prefix counts symbols shared with the one
        before."""
        state = None
        for _ in range(self.spread - 1):
            state = self._insert(state, self._column().astype(np.int64), False)
        state = self._insert(state, self.core + 1, False)
        yield 0, self._blocks(state)
        for distance in range(1, self.spread):
            symbol = self._column().astype(np.int64)
            if not symbol.any():
                return
            state = self._insert(state, symbol, True)
            yield distance, self._blocks(state)

    def close(self) -> None:
        for file, _ in self.blocks:
            file.close()
        self.files.close()

    def _blocks(self, state: tuple[str, str] | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The order and the prefixes of a state, read in sequence."""
        if state is None:
            for at in range(0, self.n, BLOCK):
                size = min(BLOCK, self.n - at)
                yield np.arange(at, at + size, dtype=np.int32), np.zeros(size, np.uint8)
            return
        with self.files.read(state[0]) as order, self.files.read(state[1]) as prefix:
            while True:
                part = order.read(4 * BLOCK)
                if not len(part):
                    return
                yield np.frombuffer(part, np.int32), np.frombuffer(prefix.read(len(part) // 4), np.uint8)

    def _insert(self, state: tuple[str, str] | None, symbol: np.ndarray, leave: bool) -> tuple[str, str]:
        """One round. Strings without a symbol (0) leave, or stay empty and share nothing with others."""
        most = int(symbol.max(initial=0)) + 1
        # by symbol: was it seen, and the least prefix since it was seen last
        seen, least = np.zeros(most, bool), np.full(most, 255, np.uint8)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for order, prefix in self._blocks(state):
            put = symbol[order]
            by = np.argsort(put, kind="stable")
            put = put[by]
            shared = np.zeros(len(order), np.uint8)
            same = np.flatnonzero(put[1:] == put[:-1]) + 1
            if len(same):
                shared[same] = np.minimum(254, range_minimum(prefix, by[same - 1] + 1, by[same])) + 1
            heads = np.flatnonzero(np.concatenate([[True], put[1:] != put[:-1]]))
            here = put[heads]
            until = np.minimum.accumulate(prefix)[by[heads]]
            shared[heads] = np.where(seen[here], np.minimum(254, np.minimum(least[here], until)) + 1, 0)
            after = np.append(np.minimum.accumulate(prefix[::-1])[::-1][1:], np.uint8(255))
            least = np.minimum(least, prefix.min())
            least[here] = after[by[np.append(heads[1:], len(by)) - 1]]
            seen[here] = True
            if put[0] == 0:
                none = int(np.searchsorted(put, 1))
                if leave:
                    put, by, shared = put[none:], by[none:], shared[none:]
                else:
                    shared[:none] = 0
            parts.append((put, order[by], shared))
        (order_name, order_out), (prefix_name, prefix_out) = self.files.write(), self.files.write()
        with order_out, prefix_out:
            if len(parts) == 1:
                order_out.write(parts[0][1].astype(np.int32).tobytes())
                prefix_out.write(parts[0][2].tobytes())
            else:
                for value in np.unique(np.concatenate([p[0] for p in parts])):
                    for put, order, shared in parts:
                        a, b = np.searchsorted(put, value), np.searchsorted(put, value, "right")
                        order_out.write(order[a:b].astype(np.int32).tobytes())
                        prefix_out.write(shared[a:b].tobytes())
        if state is not None:
            for name in state:
                self.files.delete(name)
        return order_name, prefix_name

    def repeated(self, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(string, first, last distance) of the runs of repeated windows: a window, which starts so far before the core, is
        repeated if its suffix shares `spread` symbols with a neighbour or if its string has a weight of over one."""
        first = np.full(self.n, -1, np.int16)
        runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def end(strings: np.ndarray, distance: int) -> None:
            runs.append((strings, first[strings].copy(), np.full(len(strings), distance - 1, np.int16)))
            first[strings] = -1

        for distance, blocks in self.columns():
            hit = (weight > 1) & (distance <= self.left_size)
            last = None
            for order, prefix in blocks:
                near = prefix >= self.spread
                hit[order[near]] = True
                hit[order[:-1][near[1:]]] = True
                if last is not None and near[0]:
                    hit[last] = True
                last = order[-1]
            hit &= distance >= self.spread - 1 - self.right_size
            end(np.flatnonzero(~hit & (first >= 0)), distance)
            first[hit & (first < 0)] = distance
        end(np.flatnonzero(first >= 0), distance + 1)
        return tuple(np.concatenate(c) for c in zip(*runs, strict=True))
