"""Bounded edit distances of many pairs of texts at once, by NumPy on 64 rows of the table in a word.

The table of a pair has a row for each character of the first text and a column
for each of the second.  Blocks of 64 rows are bit vectors (Myers 1999, in
blocks as of Hyyro 2003); a column of one block is a few operations on the words
of all pairs.  A path crosses the last row of every block.  Where the edits so
far and the difference of what is left are beyond ``most`` no path goes on: only
the columns that the others can reach are computed, and pairs without any are
done.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Pairs that are compared at once, and their columns of one block.
PAIRS, CELLS = 4096, 1 << 21
#: So few pairs, and one more for each 24 characters, are compared one by one.
FEW = 32
#: Bins of the counts of two characters in a row, texts that are counted at once, and pairs whose counts are.
BINS, COUNTED, PAIRS_COUNTED = 512, 2048, 4096
#: Bits of the bins of three characters in a row.
PLACED_BITS = 12
_ONE, _TOP, _ALL = np.uint64(1), np.uint64(63), ~np.uint64(0)


class Codes:
    """Texts as bytes, one for each character; ``exact`` if unlike characters have unlike bytes."""

    def __init__(self, texts: list[str]):
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        seen = np.zeros(int(points.max(initial=0)) + 1, bool)
        seen[points] = True
        number = np.cumsum(seen) - 1
        n = int(number[-1]) + 1
        self.exact, self.n = n <= 256, min(n, 256)
        self.flat = np.append(number.astype(np.uint8)[points], np.uint8(0))
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def far(self, rows: np.ndarray, others: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Which pairs are beyond ``most`` edits by their characters alone.

        An edit takes at most one character from a text, and two places of two
        characters in a row; so the edits are no fewer than the characters, or
        half of the places, that either text has more often than the other.
        Characters of one byte or bin, and counts beyond 32,767, are taken as
        equal, which tells of fewer pairs, but of no wrong one.
        """
        out = np.zeros(len(rows), bool)
        for edited in (1, 2):
            some = np.flatnonzero(~out)
            texts, which = np.unique(np.concatenate([rows[some], others[some]]), return_inverse=True)
            counts = self._counts(texts, edited)
            for a in range(0, len(some), PAIRS_COUNTED):
                part = some[a : a + PAIRS_COUNTED]
                more = counts[which[a : a + len(part)]] - counts[which[len(some) + a : len(some) + a + len(part)]]
                left, right = np.maximum(more, 0).sum(axis=1, dtype=np.int64), -np.minimum(more, 0).sum(axis=1, dtype=np.int64)
                out[part] = np.maximum(left, right) > edited * most[part]
        return out

    def apart(self, rows: np.ndarray, others: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Which pairs are beyond ``most`` edits by the places of three characters in a row.

        Where a path of so many edits leaves three characters as they are, they
        stand in the other text, and no further off than the path can be there.
        Of those that do not, each that overlaps none before takes an edit of
        its own.  Places are known to a 64th of a text and characters by bins,
        which tells of fewer pairs, but of no wrong one.
        """
        out = np.zeros(len(rows), bool)
        order, last = np.argsort(others, kind="stable"), -1
        parts = np.arange(64, dtype=np.uint64)
        for i, x, y, bound in zip(order.tolist(), rows[order].tolist(), others[order].tolist(), most[order].tolist()):
            n, m = int(self.lengths[x]), int(self.lengths[y])
            if min(n, m) < 3:
                continue
            if y != last:
                last, step, places = y, -(-m // 64), np.zeros(1 << PLACED_BITS, np.uint64)
                np.bitwise_or.at(places, self._threes(y), np.repeat(_ONE << parts, step)[: m - 2])
            skew, starts = m - n, np.arange(0, n - 2, step)
            first = ((starts - (bound - skew) // 2) // step).clip(0, 63).astype(np.uint64)
            end = ((starts + step - 1 + (bound + skew) // 2) // step).clip(0, 63).astype(np.uint64)
            near = np.repeat(_ALL << first & _ALL >> _TOP - end, step)[: n - 2]
            edited, free = 0, 0
            for place in np.flatnonzero(places.take(self._threes(x)) & near == 0).tolist():
                if place >= free:
                    edited, free = edited + 1, place + 3
                    if edited > bound:
                        break
            out[i] = edited > bound
        return out

    def _threes(self, text: int) -> np.ndarray:
        """The bins of each three characters in a row of a text."""
        start = int(self.starts[text])
        own = self.flat[start : start + int(self.lengths[text])].astype(np.uint32)
        return (own[:-2] << np.uint32(16) | own[1:-1] << np.uint32(8) | own[2:]) * np.uint32(0x9E3779B1) >> np.uint32(32 - PLACED_BITS)

    def _counts(self, texts: np.ndarray, in_a_row: int) -> np.ndarray:
        """For each text how often it has each character, or each bin of two in a row."""
        bins = self.n if in_a_row == 1 else BINS
        out = np.zeros((len(texts), bins), np.int16)
        for a in range(0, len(texts), COUNTED):
            part = texts[a : a + COUNTED]
            n = np.maximum(self.lengths[part] - in_a_row + 1, 0)
            own = np.repeat(np.arange(len(part)), n)
            at = np.arange(len(own)) + np.repeat(self.starts[part] - np.cumsum(n) + n, n)
            bin_ = self.flat[at].astype(np.int64)
            if in_a_row == 2:
                bin_ = (bin_ << 8 | self.flat[at + 1]) * 40503 >> 7 & BINS - 1
            out[a : a + len(part)] = np.bincount(own * bins + bin_, minlength=len(part) * bins).clip(max=32767).reshape(len(part), bins)
        return out

    def within(self, rows: np.ndarray, others: np.ndarray, most: np.ndarray, one: Callable[[int, int, int], bool]) -> np.ndarray:
        """Which pairs are within ``most`` edits; ``one`` tells it of a single pair, and gets those of lengths that few pairs have."""
        out = np.zeros(len(rows), bool)
        order = np.argsort(self.lengths[others], kind="stable")
        lengths = self.lengths[others][order]
        i = 0
        while i < len(order):
            longest = int(lengths[i]) * 3 // 2 + 16
            end = min(int(np.searchsorted(lengths, longest, side="right")), i + PAIRS, i + CELLS // (64 + longest // 2))
            some = order[i : max(end, i + 1)]
            if len(some) < FEW + longest // 24:
                left = some
            else:
                found = self._within(rows[some], others[some], most[some])
                out[some] = found
                left = some[:0] if self.exact else some[found]
            out[left] = [one(x, y, m) for x, y, m in zip(rows[left].tolist(), others[left].tolist(), most[left].tolist())]
            i += len(some)
        return out

    def _matches(self, texts: np.ndarray, at: int) -> np.ndarray:
        """For each text and character, the places from ``at`` on that have the character, as bits."""
        out = np.zeros((len(texts), self.n), np.uint64)
        starts, lengths = self.starts[texts] + at, self.lengths[texts] - at
        for bit in range(min(64, int(lengths.max()))):
            has = np.flatnonzero(lengths > bit)
            out[has, self.flat[starts[has] + bit]] |= np.uint64(1 << bit)
        return out.ravel()

    def _within(self, rows: np.ndarray, others: np.ndarray, most: np.ndarray) -> np.ndarray:
        """``within`` of pairs in order of the length of the others; if not ``exact``, maybe also some that are not."""
        out, live = np.zeros(len(rows), bool), np.arange(len(rows))
        skew = self.lengths[others] - self.lengths[rows]
        at, first, top = 0, 0, None
        last_from = last_to = 0
        reach = int((np.maximum(skew, 0) + (most - np.abs(skew)) // 2).max())
        while len(live):
            n_rows, n_cols, bound = self.lengths[rows[live]], self.lengths[others[live]], most[live]
            end = max(first, min(int(n_cols[-1]), at + 64 + reach))
            n = end - first
            # The row above: edits at column ``first``, and whether the next columns have one more or one less.
            if top is None:
                above = np.broadcast_to(np.arange(n + 1, dtype=np.int32)[:, None], (n + 1, len(live)))
                more = less = None
            else:
                edits, more, less = top
                known = min(last_to, end) - first
                above = np.empty((n + 1, len(live)), np.int32)
                above[: known + 1] = edits[first - last_from : first - last_from + known + 1]
                above[known + 1 :] = above[known] + np.arange(1, n - known + 1, dtype=np.int32)[:, None]
                more, less = (x[first - last_from : first - last_from + known] for x in (more, less))
            below, up, down, more, less = self._block(rows[live], others[live], n_cols, at, first, end, above[0], more, less)
            # Ends of the table.
            ends = n_rows <= at + 64
            mask = (_ONE << (n_rows - at).clip(0, 63).astype(np.uint64)) - _ONE
            mask[n_rows >= at + 64] = ~np.uint64(0)
            mask[n_rows <= at] = 0
            spots = (n_cols - first).clip(0, n)
            last = above[spots, np.arange(len(live))] + np.bitwise_count(up & mask).astype(np.int32) - np.bitwise_count(down & mask)
            out[live] = ends & (last <= bound)
            at += 64
            columns = np.arange(first, end + 1, dtype=np.int32)[:, None]
            aside = columns - (at + skew[live]).astype(np.int32)
            left = bound.astype(np.int32) - below - np.abs(aside)
            left[columns > n_cols.astype(np.int32)] = -1
            left[:, ends] = -1
            may = left >= 0
            goes_on = np.flatnonzero(may.any(axis=0))
            if not len(goes_on):
                break
            # To leave the last diagonal and come back costs two edits for each column.
            np.right_shift(left, 1, out=left)
            np.maximum(aside, 0, out=aside)
            reach = int((np.where(may, left + aside, -1).max(axis=0)[goes_on] + skew[live[goes_on]]).max())
            top = below[:, goes_on], more[:, goes_on], less[:, goes_on]
            live, last_from, last_to, first = live[goes_on], first, end, first + int(may.any(axis=1).argmax())
        return out

    def _block(self, rows, others, n_cols, at, first, end, edits, more, less):
        """Edits in the last row from column ``first`` to ``end``, the bits of each pair's last column, and whether the last row has one more or one less in each column."""
        m, n = len(rows), end - first
        texts, which = np.unique(rows, return_inverse=True)
        matches, base = self._matches(texts, at), which.astype(np.int64) * self.n
        chars = self.flat.take(self.starts[others] + np.arange(first, end)[:, None], mode="clip")
        spots = np.searchsorted(n_cols, np.arange(first, end + 2)).tolist()
        up, down = np.full(m, ~np.uint64(0)), np.zeros(m, np.uint64)
        last_up, last_down = up.copy(), down.copy()
        has_more, has_less = np.empty((n, m), np.uint8), np.empty((n, m), np.uint8)
        place, same, both, x, y = np.empty(m, np.int64), *(np.empty(m, np.uint64) for _ in range(4))
        one_more, one_less = np.ones(m, np.uint64), np.zeros(m, np.uint64)
        x_top, y_top = x.view(np.uint8)[7::8], y.view(np.uint8)[7::8]
        known = 0 if more is None else len(more)
        for j in range(n):
            np.add(base, chars[j], out=place)
            matches.take(place, out=same, mode="clip")
            np.bitwise_or(same, down, out=both)
            if j < known:
                np.copyto(one_more, more[j])
                np.copyto(one_less, less[j])
                np.bitwise_or(same, one_less, out=same)
            elif j == known:
                one_more[:], one_less[:] = 1, 0
            # Diagonals without an edit.
            np.bitwise_and(same, up, out=x)
            np.add(x, up, out=x)
            np.bitwise_xor(x, up, out=x)
            np.bitwise_or(x, same, out=same)
            # To the right one more (x), one less (y).
            np.bitwise_or(same, up, out=x)
            np.invert(x, out=x)
            np.bitwise_or(x, down, out=x)
            np.bitwise_and(up, same, out=y)
            np.right_shift(x_top, 7, out=has_more[j])
            np.right_shift(y_top, 7, out=has_less[j])
            np.left_shift(x, _ONE, out=x)
            np.bitwise_or(x, one_more, out=x)
            np.left_shift(y, _ONE, out=y)
            if j < known:
                np.bitwise_or(y, one_less, out=y)
            # Downwards.
            np.bitwise_and(x, both, out=down)
            np.bitwise_or(both, x, out=x)
            np.invert(x, out=x)
            np.bitwise_or(x, y, out=up)
            a, b = spots[j + 1], spots[j + 2]
            if a < b:
                last_up[a:b], last_down[a:b] = up[a:b], down[a:b]
        below = np.empty((n + 1, m), np.int32)
        below[0] = edits + 64
        np.subtract(has_more.view(np.int8), has_less.view(np.int8), out=below[1:], dtype=np.int32)
        np.cumsum(below, axis=0, out=below)
        return below, last_up, last_down, has_more, has_less
