"""A run-length compressed index of the Burrows-Wheeler transform.

``RunIndex`` is built over strings that end in terminators of rising rank. Kept are the
transform's runs, per-symbol counts before each run, the suffix position at the end of each
run, and for every maximal interval of rows that share their first ``LENGTH`` bytes the least
owner of the strings in it. ``stream`` walks all strings backwards by LF steps and reports,
for each position with ``LENGTH`` bytes left, the least owner of a string with the same bytes
there. ``find`` is backward search for one pattern, with a position from the run samples.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

LENGTH = 50


def _ranks(keys: np.ndarray, stable: bool) -> tuple[np.ndarray, np.ndarray]:
    """Order of the keys, and each key's dense rank, which doesn't depend on the order of ties."""
    order = np.argsort(keys, kind="stable" if stable else "quicksort")
    new = np.concatenate(([True], keys[order][1:] != keys[order][:-1])) if len(keys) else np.zeros(0, bool)
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.cumsum(new)
    return order, rank


class RunIndex:
    def __init__(self, strings: list[bytes], owners: np.ndarray, length: int = LENGTH) -> None:
        self.length, self.owners = length, owners
        lens = np.fromiter(map(len, strings), np.int64, len(strings))
        ends = np.cumsum(lens + 1) - 1  # where the terminators stand
        n = int(ends[-1]) + 1 if len(ends) else 0
        text = np.zeros(n, np.int64)
        body = np.ones(n, bool)
        body[ends] = False
        text[body] = np.frombuffer(b"".join(strings), np.uint8).astype(np.int64) + 1
        left = np.repeat(ends, lens + 1) - np.arange(n)  # bytes before the terminator
        self.size, self.ends, self.lens = n, ends, lens

        def ahead(values: np.ndarray, k: int) -> np.ndarray:
            out = np.zeros(n, np.int64)
            out[: max(0, n - k)] = values[k:]
            out[left < k] = 0
            return out

        keys = np.zeros(n, np.int64)
        for k in range(7):
            keys = keys * 257 + ahead(text, k)
        known = 7
        groups = None
        longest = int(lens.max()) + 1 if len(lens) else 0
        order, rank = _ranks(keys, known >= max(length, longest))
        while known < length or known < longest:
            step = min(known, length - known) if known < length else known
            known += step
            order, rank = _ranks(rank * (n + 2) + ahead(rank, step), known >= max(length, longest))
            if known == length:
                groups = rank
        # Equal suffixes keep text order, which is the order of their terminators.
        del keys
        owner = np.repeat(owners, lens + 1)[order]
        before = order - 1
        bwt = np.where((before >= 0) & (text[before] > 0), text[before], 0)
        head = np.flatnonzero(np.concatenate(([True], bwt[1:] != bwt[:-1]))) if n else np.zeros(0, np.int64)
        width = np.diff(np.concatenate((head, [n])))
        symbol = bwt[head] if n else np.zeros(0, np.int64)
        self.runs = len(head)
        self.run_end_sample = order[head + width - 1] if n else order
        by = np.lexsort((head, symbol))
        self.key = symbol[by] * (n + 1) + head[by]
        self.head, self.width, self.symbol = head[by], width[by], symbol[by]
        # Rows that start with a smaller symbol, then rows of this symbol before the run: LF of the run's first row.
        # Terminators sort first in text order, so only real symbols take LF steps.
        counts = np.bincount(text, minlength=258)
        first = np.concatenate(([0], np.cumsum(counts)))
        total = np.concatenate(([0], np.cumsum(self.width)))[:-1]
        base = total - total[np.searchsorted(self.symbol, self.symbol)]
        self.target = first[self.symbol] + base
        self.run_symbol, self.run_head, self.counts, self.first = symbol, head, counts, first
        self.run_shift = np.empty(self.runs, np.int64)  # what LF adds to a row of the run
        self.run_shift[by] = self.target - self.head
        same = groups[order] if n else np.zeros(0, np.int64)
        self.group_head = np.flatnonzero(np.concatenate(([True], same[1:] != same[:-1]))) if n else np.zeros(0, np.int64)
        self.group_owner = np.minimum.reduceat(owner, self.group_head) if n else owner

    def step(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """LF of rows, and the symbols stepped over (0: a string's start)."""
        run = np.searchsorted(self.run_head, rows, "right") - 1
        return self.run_shift[run] + rows, self.run_symbol[run]

    def stream(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(strings, positions, least owners) for all positions with ``length`` bytes left, from the right."""
        at = np.arange(len(self.lens))
        rows = np.arange(len(self.lens))  # terminators are the first rows
        # Directories over the rows, for as long as the strings are walked: which run and which group a row is in.
        run = np.repeat(np.arange(self.runs, dtype=np.int32), np.diff(self.run_head, append=self.size))
        group = np.repeat(np.arange(len(self.group_head), dtype=np.int32), np.diff(self.group_head, append=self.size))
        for left in range(1, int(self.lens.max(initial=0)) + 1):
            live = self.lens[at] >= left
            at, rows = at[live], rows[live]
            rows = rows + self.run_shift[run[rows]]
            if left >= self.length:
                yield at, self.lens[at] - left, self.group_owner[group[rows]]

    def find(self, pattern: bytes) -> tuple[int, int | None]:
        """How often the pattern occurs, and the text position of one occurrence.

        The position follows the run samples: whenever the interval's last row does not carry
        the next symbol, the last run of it inside gives a new sampled position.
        """
        lo, hi, where = 0, self.size, None
        for k, c in enumerate(reversed(pattern)):
            c += 1
            a, b = np.searchsorted(self.symbol, [c, c + 1])
            heads, widths, targets = self.head[a:b], self.width[a:b], self.target[a:b]
            if not len(heads):
                return 0, None

            def rank(row: int, heads=heads, widths=widths, targets=targets) -> int:
                i = int(np.searchsorted(heads, row, "left")) - 1
                return int(targets[0]) if i < 0 else int(targets[i] + min(row - heads[i], widths[i]))

            new_lo, new_hi = rank(lo), rank(hi)
            if new_lo >= new_hi:
                return 0, None
            i = int(np.searchsorted(heads, hi, "left")) - 1
            if heads[i] + widths[i] <= hi:
                run = int(np.searchsorted(self.run_head, heads[i], "right")) - 1
                where = int(self.run_end_sample[run]) - 1
            else:
                where = where - 1 if where is not None and k else None
            lo, hi = new_lo, new_hi
        return hi - lo, where
