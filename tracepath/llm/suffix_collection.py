"""The suffixes of a collection of texts in order, with their common prefixes, built column by column.

Round j inserts, for each text that is long enough, the suffix of j symbols. Kept are the Burrows-Wheeler transform of what is
inserted so far (the symbol before each suffix), the common prefix of each suffix with the one above it, and the suffixes' numbers:
three files, which a round reads once in sequence, a chunk at a time, to find where its suffixes belong and what
prefixes they share, and writes once in sequence with its suffixes merged in. Memory holds a chunk, a column of symbols and a few numbers
a text; small files stay in memory until they outgrow ``SPOOL``. The files have no name and belong to the task that writes them.

A suffix c + s stands behind all that start with a smaller symbol, at the rank that c has before s in the transform; it shares one
symbol more with its neighbour than s shares with the last suffix before it that c stands before.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

SPOOL = 8 << 20
CHUNK = 1 << 18


class Column:
    """Numbers of one type in a file that is written once and read in sequence."""

    def __init__(self, dtype: np.dtype):
        self.dtype, self.file, self.n = np.dtype(dtype), tempfile.SpooledTemporaryFile(SPOOL), 0

    def write(self, values: np.ndarray) -> None:
        self.file.write(np.ascontiguousarray(values, self.dtype).data)
        self.n += len(values)

    def chunks(self, size: int) -> Iterator[np.ndarray]:
        self.file.seek(0)
        for at in range(0, self.n, size):
            yield np.frombuffer(bytearray(self.file.read(min(size, self.n - at) * self.dtype.itemsize)), self.dtype)

    def close(self) -> None:
        self.file.close()


class Collection:
    """``chunks`` yields (text's number, suffix's length, common prefix with the suffix above) in the order of suffixes."""

    def __init__(self, texts: list[bytes], chunk: int = CHUNK):
        self.m, self.chunk = len(texts), chunk
        lengths = np.array([len(t) for t in texts], np.int64)
        longest = int(lengths.max()) if self.m else 0
        flat = np.frombuffer(b"".join(texts), np.uint8)
        used = np.flatnonzero(np.bincount(flat, minlength=256))
        symbol = np.zeros(256, np.uint8 if len(used) < 256 else np.uint16)
        symbol[used] = np.arange(1, len(used) + 1)  # 0: nothing stands before
        self.symbols, self.longest = len(used) + 1, longest
        # row j: the symbol before the suffix of j symbols
        self.columns = np.zeros((longest + 1, self.m), symbol.dtype)
        text = np.repeat(np.arange(self.m), lengths)
        ends = np.cumsum(lengths)
        self.columns[np.repeat(ends, lengths) - 1 - np.arange(len(flat)), text] = symbol[flat]
        self.kinds = (symbol.dtype, np.dtype(np.uint16 if longest < 65535 else np.uint32), np.dtype(np.int32 if (longest + 1) * self.m < 1 << 31 else np.int64))
        self.before, self.shared, self.suffix = self._build()

    def _new(self) -> list[Column]:
        return [Column(k) for k in self.kinds]

    def _build(self) -> list[Column]:
        files = self._new()
        for f, values in zip(files, (self.columns[0], np.zeros(self.m), np.arange(self.m))):
            f.write(values)
        totals = np.bincount(self.columns[0], minlength=self.symbols)
        at, text = np.arange(self.m), np.arange(self.m)  # places of the suffixes of the last round that go on
        at, text = at[self.columns[0] > 0], text[self.columns[0] > 0]
        for j in range(1, self.longest + 1):
            if not len(at):
                break
            base = self.m + np.concatenate([[0, 0], np.cumsum(totals[1:])[:-1]])
            place, shares, changed, change = self._places(files, at, base, totals)
            order = np.argsort(place)
            place, text = place[order], text[order]
            before = self.columns[j][text]
            files = self._merged(files, place, (before, shares[order], j * self.m + text), changed, change)
            totals += np.bincount(before, minlength=self.symbols)
            at, text = place[before > 0], text[before > 0]
        return files

    def _places(self, files: list[Column], at: np.ndarray, base: np.ndarray, totals: np.ndarray) -> tuple[np.ndarray, ...]:
        """For the suffixes at ``at``: where the suffixes one symbol longer go and what they share with the one above there; and the
        places of those suffixes that stand below one of them, with what they share now."""
        none = np.iinfo(self.kinds[1]).max
        ranks = np.zeros(self.symbols, np.int64)
        least = np.full(self.symbols, none, self.kinds[1])  # since a symbol's last place; none: there is no such place
        met, newest = np.zeros(self.symbols, bool), np.zeros(self.symbols, bool)
        place, shares, changed, change = np.empty(len(at), np.int64), np.empty(len(at), self.kinds[1]), [], []
        start, size = 0, files[0].n
        for before, shared in zip(files[0].chunks(self.chunk), files[1].chunks(self.chunk)):
            n = len(before)
            new = np.zeros(n, bool)
            a, b = np.searchsorted(at, (start, start + n))
            new[at[a:b] - start] = True
            order = np.argsort(before, kind="stable")
            counts = totals if n == size else np.bincount(before, minlength=self.symbols)
            first = np.cumsum(counts) - counts  # of each symbol, in order
            there = np.flatnonzero(counts)
            current = new[order]
            wanted = current.copy()
            wanted[1:] |= current[:-1]
            wanted[first[there]] = current[first[there]] | newest[there]
            wanted[: counts[0]] = False  # nothing stands before these
            asked = np.flatnonzero(wanted)
            c = before[order[asked]].astype(np.int64)
            value = np.zeros(len(asked), self.kinds[1])
            from_before = asked == first[c]
            if start:
                k = c[from_before]
                so_far = np.minimum.accumulate(shared)
                value[from_before] = np.where(met[k], np.minimum(least[k], so_far[order[asked[from_before]]]) + 1, 0)
            k = asked[~from_before]
            if len(k):
                upper, lower = order[k - 1] + 1, order[k] + 1
                by = np.argsort(-lower)  # then no stretch between two ranges is looked at
                ends = np.empty(2 * len(k), np.int64)
                ends[::2], ends[1::2] = upper[by], lower[by]
                found = np.empty(len(k), self.kinds[1])
                found[by] = np.minimum.reduceat(np.append(shared, none), ends)[::2]
                value[~from_before] = found + 1
            to = base[c] + ranks[c] + asked - first[c]
            mine = current[asked]
            own = np.searchsorted(at, start + order[asked[mine]])
            place[own], shares[own] = to[mine], value[mine]
            changed.append(to[~mine])
            change.append(value[~mine])
            start += n
            if start < size:  # what later chunks ask for
                last = order[(first + counts - 1)[there]]
                from_here = np.append(np.minimum.accumulate(shared[::-1])[::-1], none)
                least = np.minimum(least, from_here[0])
                least[there], newest[there], met[there] = from_here[last + 1], new[last], True
                ranks += counts
        return place, shares, np.concatenate(changed), np.concatenate(change)

    def _merged(self, files: list[Column], place: np.ndarray, new: tuple[np.ndarray, ...], changed: np.ndarray, change: np.ndarray) -> list[Column]:
        out = self._new()
        at = place - np.arange(len(place))  # before which of the old ones
        by = np.argsort(changed)
        changed, change = changed[by], change[by]
        changed = changed - np.searchsorted(place, changed)
        start, n = 0, files[0].n
        for old in zip(*(f.chunks(self.chunk) for f in files)):
            stop = start + len(old[0])
            a, b = np.searchsorted(at, start), len(at) if stop == n else np.searchsorted(at, stop)
            u, v = np.searchsorted(changed, (start, stop))
            old[1][changed[u:v] - start] = change[u:v]
            places = at[a:b] - start + np.arange(b - a)
            rest = np.ones(stop - start + b - a, bool)
            rest[places] = False
            for g, x, y in zip(out, old, new):
                both = np.empty(len(rest), x.dtype)
                both[places], both[rest] = y[a:b], x
                g.write(both)
            start = stop
        for f in files:
            f.close()
        return out

    def chunks(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for suffix, shared in zip(self.suffix.chunks(self.chunk), self.shared.chunks(self.chunk)):
            yield suffix % self.m, suffix // self.m, shared.astype(np.int64)

    def close(self) -> None:
        for f in (self.before, self.shared, self.suffix):
            f.close()
