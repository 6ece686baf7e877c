"""Windows over a patch as whole-row operations on an array of rows, whatever the window's size.

A window's least, largest or total value comes by doubling: that of a run of two cells from two single ones, of four from
two runs of two, and so on, so a run of any length takes two such runs (least, largest) or one for each binary digit
(totals). A disc, square or diamond is one run per row, and its rows are put together row by row. Nothing is shuffled,
nothing is exploded, and no cell looks another one up by its index.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

import numpy as np

from ..functions import linear

# Expressions are SQL text: a footprint of a thousand cells has a hundred terms, and text is parsed at once where each
# Column would be a call to the JVM. Cells are read by their place in a row that is bound once; slices would copy rows.
Step = Callable[[str], str]
#: A term of a cell: the array of rows that it is read from, and how many rows and cells further on.
Term = tuple[str, int, int]


def as_rows(flat: str, height: int, width: int) -> str:
    """An array of rows of a row-major array."""
    return bound(flat, lambda g: f"transform(sequence(0, {height - 1}), i -> slice({g}, i * {width} + 1, {width}))")


def bound(value: str, use: Callable[[str], str]) -> str:
    """``use`` of a value that is worked out once. Were it merged into a function over rows, each row would repeat it."""
    return f"get(transform(array({value}), g -> {use('g')}), 0)"


def _ints(values: np.ndarray) -> str:
    return f"array({', '.join(str(int(v)) for v in values)})"


def padded(rows: str, height: int, width: int, up: int, down: int, left: int, right: int, mode: str = "reflect") -> str:
    """The rows with as many cells more at each side, read where the mode says."""
    by_y = _ints(linear.index_map(np.arange(-up, height + down), height, mode))
    by_x = _ints(linear.index_map(np.arange(-left, width + right), width, mode))
    wide = f"transform({rows}, r -> transform({by_x}, i -> get(r, i)))"
    return bound(wide, lambda g: f"transform({by_y}, i -> get({g}, i))")


def gathered(terms: list[Term], height: int, width: int, use: Callable[[list[str]], str]) -> str:
    """Rows of ``use`` of the terms' cells. The rows that the terms of a row read are bound together."""
    sources = {source: n for n, source in enumerate(dict.fromkeys(source for source, _, _ in terms))}
    lines = {key: n for n, key in enumerate(dict.fromkeys((source, dy) for source, dy, _ in terms))}
    held = ", ".join(f"get(get(g, {sources[source]}), y + {dy})" for source, dy in lines)
    cells = use([f"get(get(l, {lines[source, dy]}), x + {dx})" for source, dy, dx in terms])
    row = f"transform(sequence(0, {width - 1}), x -> {cells})"
    return bound(f"array({', '.join(sources)})", lambda g: f"transform(sequence(0, {height - 1}), y -> get(transform(array(array({held})), l -> {row}), 0))")


def _call(name: str) -> Callable[[list[str]], str]:
    return lambda cells: cells[0] if len(cells) == 1 else f"{name}({', '.join(cells)})"


LEAST, LARGEST, TOTAL = _call("least"), _call("greatest"), " + ".join


class Runs:
    """Runs of one, two, four ... cells along an axis, made as they are asked for, each by one step."""

    def __init__(self, rows: str, height: int, width: int, along_x: bool, join: Callable[[list[str]], str], step: Step) -> None:
        self.height, self.width, self.along_x, self.join, self.step = height, width, along_x, join, step
        self.doubled = [rows]

    def power(self, k: int) -> str:
        while len(self.doubled) <= k:
            size, last = 2 ** (len(self.doubled) - 1), self.doubled[-1]
            y, x = (0, size) if self.along_x else (size, 0)
            less = 2 * size - 1
            shape = (self.height, self.width - less) if self.along_x else (self.height - less, self.width)
            self.doubled.append(self.step(gathered([(last, 0, 0), (last, y, x)], *shape, self.join)))
        return self.doubled[k]

    def parts(self, length: int) -> list[Term]:
        """Runs that make up one of ``length`` without sharing cells."""
        out, at = [], 0
        for k in range(length.bit_length() - 1, -1, -1):
            if length >> k & 1:
                out.append((self.power(k), 0, at) if self.along_x else (self.power(k), at, 0))
                at += 2**k
        return out


def by_row(offsets: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """A footprint as runs ``dy, first dx, length``, longest first; rows without gaps."""
    rows = defaultdict(list)
    for dy, dx in offsets:
        rows[dy].append(dx)
    runs = [(dy, min(xs), max(xs) - min(xs) + 1) for dy, xs in rows.items()]
    if any(length != len(rows[dy]) for dy, _, length in runs):
        raise ValueError("a footprint's rows must have no gaps")
    return sorted(runs, key=lambda r: (-r[2], r[0]))


def extreme(rows: str, height: int, width: int, offsets: list[tuple[int, int]], largest: bool, step: Step) -> str:
    """Least (or largest, over the mirrored footprint) cell under a footprint, edges reflected.

    A run of any length is two runs of the largest power of two in it, which may share cells.
    """
    join = LARGEST if largest else LEAST
    runs = by_row([(-y, -x) for y, x in offsets] if largest else offsets)
    up, down = max(0, -min(r[0] for r in runs)), max(0, max(r[0] for r in runs))
    left, right = max(0, -min(r[1] for r in runs)), max(0, max(r[1] + r[2] - 1 for r in runs))
    rows = step(padded(rows, height, width, up, down, left, right))
    wide, terms = Runs(rows, height + up + down, width + left + right, True, join, step), []
    for dy, dx, length in runs:
        k = length.bit_length() - 1
        terms += [(wide.power(k), dy + up, dx + left + at) for at in dict.fromkeys((0, length - 2**k))]
    return step(gathered(terms, height, width, join))


def box_total(rows: str, height: int, width: int, size: int, step: Step) -> str:
    """Total of a square of ``size`` cells that begins half of it before each cell, edges reflected."""
    before = size // 2
    more = size - 1
    wide = Runs(step(padded(rows, height, width, before, more - before, before, more - before)), height + more, width + more, True, TOTAL, step)
    lines = step(gathered(wide.parts(size), height + more, width, TOTAL))
    return step(gathered(Runs(lines, height + more, width, False, TOTAL, step).parts(size), height, width, TOTAL))
