"""The nearest of very many centres, exactly, without comparing every row with all of them.

The centres stand in a tree of boxes: each box is halved at the median of its widest column until it holds about
``LEAF``. A row goes down to a last box; rows of the same one are a block. The boxes nearest to the block give each
row a distance that its nearest centre cannot exceed, so a box farther from the block than the largest of these
holds nobody's nearest centre; boxes are first ruled out in families of neighbours. The others are compared with
the whole block. Of centres that seem equally near but for the last digits, the distances are worked out in a fixed
order, and the least number is taken of equals: so a row's centre does not depend on the rows beside it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# Centres in a last box, rows in a block, boxes that a block is compared with first, and centres compared at once.
LEAF = 24
BLOCK = 256
FIRST = 12
WIDE = 8192
# Squared distances this near, as a part of the squared lengths, are worked out again; far above what a product loses.
CLOSE = 1e-9


@dataclass(frozen=True)
class CentreTree:
    """``centres`` and their ``numbers`` in the order of the last boxes, which begin at ``starts``.

    ``column`` and ``cut`` are the halvings, a box ``n`` having the halves 2n + 1 and 2n + 2. ``low`` and ``high``
    are the corners of what the last boxes hold, ``wide_low`` and ``wide_high`` those of families of as many each.
    """

    centres: np.ndarray
    numbers: np.ndarray
    starts: np.ndarray
    column: np.ndarray
    cut: np.ndarray
    low: np.ndarray
    high: np.ndarray
    wide_low: np.ndarray
    wide_high: np.ndarray

    def boxes(self, points: np.ndarray) -> np.ndarray:
        """The number of the last box that each point comes to; near numbers are near in space."""
        at, rows = np.zeros(len(points), np.int64), np.arange(len(points))
        for _ in range((len(self.column) + 1).bit_length() - 1):
            at = 2 * at + 1 + (points[rows, self.column[at]] > self.cut[at])
        return at - len(self.column)

    def nearest(self, points: np.ndarray) -> np.ndarray:
        """The number of the nearest centre of each point."""
        if np.isnan(points).any():
            raise ValueError("a row with a null or nan has no nearest centre")
        found = np.empty(len(points), np.int64)
        if not len(points):
            return found
        boxes = self.boxes(points)
        order = np.argsort(boxes, kind="stable")
        edges = np.flatnonzero(np.diff(boxes[order], prepend=-1))
        for low, high in zip(edges, np.append(edges[1:], len(order)), strict=True):
            for first in range(low, high, BLOCK):
                rows = order[first : min(first + BLOCK, high)]
                found[rows] = self._of_block(points[rows])
        return found

    def _of_block(self, points: np.ndarray) -> np.ndarray:
        least, most = points.min(axis=0), points.max(axis=0)
        squares = np.einsum("ij,ij->i", points, points)
        wide = _away(least, most, self.wide_low, self.wide_high)
        near = self._family(np.argpartition(wide, 1)[:2] if len(wide) > 2 else np.arange(len(wide)))
        away = _away(least, most, self.low[near], self.high[near])
        near = near[np.argpartition(away, FIRST)[:FIRST]] if len(away) > FIRST else near
        known = self._squares(points, squares, self.centres[self._members(near)]).min(axis=1)
        reach = (known + _slack(known, squares)).max()
        boxes = self._family(np.flatnonzero(wide <= reach))
        boxes = boxes[_away(least, most, self.low[boxes], self.high[boxes]) <= reach]
        return self._closest(points, squares, boxes)

    def _family(self, families: np.ndarray) -> np.ndarray:
        size = len(self.low) // len(self.wide_low)
        return np.add.outer(families * size, np.arange(size)).ravel()

    def _members(self, boxes: np.ndarray) -> np.ndarray:
        many = self.starts[boxes + 1] - self.starts[boxes]
        return np.repeat(self.starts[boxes] - (np.cumsum(many) - many), many) + np.arange(many.sum())

    def _squares(self, points: np.ndarray, squares: np.ndarray, centres: np.ndarray) -> np.ndarray:
        """Squared distances of all points to all centres, to about 14 digits of the squared lengths."""
        found = points @ (-2 * centres.T)
        found += np.einsum("ij,ij->i", centres, centres)
        found += squares[:, None]
        return found

    def _closest(self, points: np.ndarray, squares: np.ndarray, boxes: np.ndarray) -> np.ndarray:
        members = self._members(boxes)
        best = np.full(len(points), np.inf)
        number = np.full(len(points), -1)
        for low in range(0, len(members), WIDE):
            here = members[low : low + WIDE]
            centres = self.centres[here]
            found = self._squares(points, squares, centres)
            least = np.minimum(found.min(axis=1), best)
            rows, cells = np.nonzero(found <= (least + _slack(least, squares))[:, None])
            exact = np.zeros(len(rows))
            for x, c in zip(points.T, centres.T, strict=True):
                exact += (x[rows] - c[cells]) ** 2
            names = self.numbers[here[cells]]
            order = np.lexsort((names, exact, rows))
            firsts = order[np.flatnonzero(np.diff(rows[order], prepend=-1))]
            row, square, name = rows[firsts], exact[firsts], names[firsts]
            better = (square < best[row]) | ((square == best[row]) & (name < number[row]))
            best[row[better]], number[row[better]] = square[better], name[better]
        return number


def _away(least: np.ndarray, most: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The squared distance of a block to each box; without end for an empty one."""
    gaps = np.maximum(low - most, least - high)
    np.maximum(gaps, 0, out=gaps)
    return np.einsum("ij,ij->i", gaps, gaps)


def _slack(found: np.ndarray, squares: np.ndarray) -> np.ndarray:
    return CLOSE * (np.maximum(found, 0) + squares)


def centre_tree(centres: np.ndarray) -> CentreTree:
    """The tree of the centres, numbered as they come; there is at least one."""
    levels = (max(1, len(centres) - 1) // LEAF).bit_length()
    order = np.arange(len(centres))
    starts = np.array([0, len(centres)])
    column, cut = [], []
    for _ in range(levels):
        edges = [0]
        for first, last in zip(starts[:-1], starts[1:], strict=True):
            own = centres[order[first:last]]
            widest, value, many = 0, 0.0, 0
            if len(own):
                widest = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
                rank = np.argsort(own[:, widest], kind="stable")
                sorted_values = own[rank, widest]
                value = float(sorted_values[(len(rank) - 1) // 2])
                # Equal values stay on one side, where points of that value go down as well.
                many = int(np.searchsorted(sorted_values, value, side="right"))
                order[first:last] = order[first:last][rank]
            column.append(widest)
            cut.append(value)
            edges += [first + many, last]
        starts = np.array(edges)
    placed = centres[order]
    low, high = np.full((2, len(starts) - 1, centres.shape[1]), np.inf)
    high *= -1
    for box, (first, last) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
        if last > first:
            low[box], high[box] = placed[first:last].min(axis=0), placed[first:last].max(axis=0)
    family = 1 << (levels // 2)
    shape = (len(low) // family, family, centres.shape[1])
    wide_low, wide_high = low.reshape(shape).min(axis=1), high.reshape(shape).max(axis=1)
    return CentreTree(placed, order, starts, np.array(column, np.int64), np.array(cut), low, high, wide_low, wide_high)
