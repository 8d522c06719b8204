"""External induced suffix sorting with common-prefix values, for one shard of text that need not fit into memory.

The order of the S* suffixes (left-most smaller ones) is found on the reduced string of their substrings, then it is carried to
all others: left to right to the larger (L) suffixes, right to left to the smaller (S) ones. A suffix enters the order when
its successor leaves a priority queue, as a tuple (position, common prefix with the one before). Keys of the
queue are first characters, and tuples of one character come out as they went in, so the queue is one file-backed
sequence per character; all sequences share one budget of ``memory`` tuples and spill the rest to files.

The reduced string has as many letters as there are different substrings, too many for a sequence each. It is
put in order by doubling: pairs of ranks are sorted in runs of ``memory`` pairs on file, and the runs are merged range by range.

Text, types, hashes, the S* positions, their names and ranks are memory-mapped files. Every step works on blocks with
numpy, so memory follows ``memory`` and the number of letters, not the length of the text.

A common prefix is one more than the least value between the two successors, carried along with the tuples; values are capped at
``depth``. Suffixes that agree on ``depth`` characters may come in any order.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np

from wattshift.llm.common import BASE

BLOCK = 1 << 16


class Budget:
    """Tuples that the queues of a shard hold in memory together."""

    def __init__(self, limit: int) -> None:
        self.limit, self.held = limit, 0


class DiskQueue:
    """A sequence of (position, prefix) tuples, first in first out; what exceeds the shared budget goes to a file.

    Tuples pushed one after another gather in a block, which is closed when it is full or asked for. ``kinds`` are the
    integer types that hold positions and prefixes.
    """

    def __init__(self, folder: str, budget: Budget, kinds: tuple[type, type] = (np.int64, np.int64)) -> None:
        self.folder, self.budget, self.kinds = folder, budget, kinds
        self.blocks: list[tuple[np.ndarray, np.ndarray] | tuple[int, int]] = []
        self.tail: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = self.held = self.at = 0
        self.file = None

    def __len__(self) -> int:
        return len(self.blocks) + bool(self.tail)

    def push(self, positions: np.ndarray, prefix: np.ndarray) -> None:
        self.tail.append((positions.astype(self.kinds[0]), prefix.astype(self.kinds[1])))
        self.waiting += len(positions)
        if self.waiting >= BLOCK:
            self._close_block()

    def _close_block(self) -> None:
        block = tuple(np.concatenate([x[k] for x in self.tail]) for k in (0, 1))
        self.tail, self.waiting = [], 0
        if self.budget.held + len(block[0]) > self.budget.limit:
            if self.file is None:
                self.file = tempfile.TemporaryFile(dir=self.folder)
            self.file.seek(self.at)
            self.file.write(block[0].tobytes() + block[1].tobytes())
            self.blocks.append((self.at, len(block[0])))
            self.at += block[0].nbytes + block[1].nbytes
        else:
            self.blocks.append(block)
            self.held += len(block[0])
            self.budget.held += len(block[0])

    def get(self, i: int) -> np.ndarray:
        """Block i as rows of positions and prefixes, a copy."""
        if i == len(self.blocks):
            self._close_block()
        first, second = self.blocks[i]
        if isinstance(first, int):
            self.file.seek(first)
            first, second = (np.frombuffer(self.file.read(second * np.dtype(k).itemsize), k) for k in self.kinds)
        return np.array([first, second], np.int64)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
        self.budget.held -= self.held
        self.blocks, self.tail, self.held = [], [], 0


def suffix_types(t: np.ndarray, after: bool) -> np.ndarray:
    """True for S suffixes: smaller than the next one. ``after`` is the type of the last place."""
    turn = np.flatnonzero(t[1:] != t[:-1])                     # last place of each run but the last run
    rises = t[turn + 1] > t[turn]
    lengths = np.diff(np.concatenate(([-1], turn, [len(t) - 1])))
    return np.repeat(np.append(rises, after), lengths)


def spans(n: int, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    return ((a, min(a + size, n)) for a in range(0, n, size))


class Shard:
    """Suffixes of a text of small non-negative integers, to be put in order of their first ``depth`` characters."""

    def __init__(self, text: np.ndarray, depth: int, folder: str, memory: int = 1 << 22) -> None:
        self.t, self.depth, self.folder, self.memory = text, depth, folder, max(memory, 1)
        self.budget = Budget(memory)
        n = len(text)
        self.kinds = (np.uint32 if n < 1 << 32 else np.int64, np.uint8 if depth < 256 else np.int64)
        self.letters = int(text.max()) + 1 if n else 1
        self.s = self._file("types", np.bool_, n)
        for a, b in reversed(list(spans(n))):                  # the end counts as smaller than all, so the last suffix is L
            last = b < n and (self.s[b] if text[b - 1] == text[b] else text[b - 1] < text[b])
            self.s[a:b] = suffix_types(text[a:b], bool(last))
        with open(os.path.join(folder, "stars"), "wb") as f:
            for a, b in spans(n):
                here = np.arange(a, b)
                f.write(here[self._is_star(here)].astype(self.kinds[0]).tobytes())
            size = f.tell() // np.dtype(self.kinds[0]).itemsize
        self.star = np.memmap(os.path.join(folder, "stars"), self.kinds[0], "r", shape=size) if size else np.zeros(0, self.kinds[0])
        self.powers = [np.multiply.accumulate(np.append(np.uint64(1), np.full(k, base, np.uint64)))
                       for k, base in ((BLOCK - 1, BASE), (n // BLOCK, pow(int(BASE), BLOCK, 1 << 64)))]
        self.hash = self._file("hash", np.uint64, n + 1)
        self.hash[0] = 0
        for a, b in spans(n):
            self.hash[a + 1: b + 1] = self.hash[a] + np.cumsum((text[a:b].astype(np.uint64) + np.uint64(1)) * self._power(np.arange(a, b)))

    def _file(self, name: str, kind: type, n: int) -> np.ndarray:
        return np.memmap(os.path.join(self.folder, name), kind, "w+", shape=max(1, n))[:n]

    def _drop(self, *names: str) -> None:
        for name in names:
            os.unlink(os.path.join(self.folder, name))

    def _power(self, n: np.ndarray) -> np.ndarray:
        """Powers of the hash base, from two tables."""
        return self.powers[0][n % BLOCK] * self.powers[1][n // BLOCK]

    def _is_star(self, positions: np.ndarray) -> np.ndarray:
        return (positions > 0) & self.s[positions] & ~self.s[positions - 1]

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefixes of suffix pairs, up to depth, by bisection over prefix hashes."""
        n = len(self.t)
        low = np.zeros(len(a), np.int64)
        high = np.minimum(self.depth, n - np.maximum(a, b))
        first, last = np.minimum(a, b), np.maximum(a, b)
        while np.any(low < high):
            mid = (low + high + 1) >> 1
            same = (self.hash[first + mid] - self.hash[first]) * self._power(last - first) == self.hash[last + mid] - self.hash[last]
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def _induce(self, seeds: list[DiskQueue], to_s: bool) -> list[DiskQueue]:
        """One pass over the seeds' order. to_s False: from S* seeds to L suffixes, ascending; True: from L to S, descending.

        In a pass a character's own suffixes come before its seeds.
        """
        made = [DiskQueue(self.folder, self.budget, self.kinds) for _ in range(self.letters)]
        open_ = np.full(self.letters, -1, np.int64)     # least prefix since the last tuple pushed to a character; -1: none yet

        def process(block: np.ndarray) -> None:
            positions, prefix = block
            before = positions - 1
            ok = (before >= 0) & (self.s[before] == to_s)
            open_after = np.minimum(open_, prefix.min())
            j = np.flatnonzero(ok)
            if len(j):
                c = self.t[before[j]]
                order = np.argsort(c, kind="stable")
                c, j = c[order].astype(np.int64), j[order]
                new = np.concatenate(([True], c[1:] != c[:-1]))
                start = np.where(new, 0, np.concatenate(([0], j[:-1] + 1)))
                least = np.minimum.reduceat(np.append(prefix, self.depth), np.stack((start, j + 1), 1).ravel())[::2]
                least[new] = np.minimum(least[new], open_[c[new]])
                value = np.minimum(least + 1, self.depth)
                cuts = np.append(np.flatnonzero(new), len(c))
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                    made[c[a]].push(before[j[a:b]], value[a:b])
                    rest = prefix[j[b - 1] + 1:]
                    open_after[c[a]] = rest.min() if len(rest) else self.depth
            open_[:] = open_after

        if not to_s:      # the empty suffix comes first of all and leads to the text's last suffix
            made[self.t[-1]].push(np.array([len(self.t) - 1]), np.array([0]))
            open_[self.t[-1]] = self.depth
        for c in range(self.letters - 1, -1, -1) if to_s else range(self.letters):
            last, i = None, 0
            while i < len(made[c]):
                block = made[c].get(i)
                process(block)
                last, i = block[0, -1], i + 1
            for k in range(len(seeds[c])):
                block = seeds[c].get(k)
                if k == 0:
                    block[1, 0] = 0 if last is None else self.common(block[0, :1], np.array([last]))[0]
                process(block)
        return made

    def _by_letter(self, blocks: Iterator[tuple[np.ndarray, np.ndarray]]) -> list[DiskQueue]:
        out = [DiskQueue(self.folder, self.budget, self.kinds) for _ in range(self.letters)]
        for positions, prefix in blocks:
            c = self.t[positions]
            order = np.argsort(c, kind="stable")
            c, positions, prefix = c[order], positions[order], prefix[order]
            cuts = np.concatenate(([0], np.flatnonzero(c[1:] != c[:-1]) + 1, [len(c)]))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                out[c[a]].push(positions[a:b], prefix[a:b])
        return out

    def _reversed(self, queues: list[DiskQueue]) -> list[DiskQueue]:
        """The same tuples in falling order; a prefix value then belongs to the pair's other suffix."""
        out = [DiskQueue(self.folder, self.budget, self.kinds) for _ in range(self.letters)]
        for queue, other in zip(queues, out):
            shift = 0
            for i in range(len(queue) - 1, -1, -1):
                block = queue.get(i)[:, ::-1]
                other.push(block[0], np.append(shift, block[1, :-1]))
                shift = block[1, -1]
        return out

    def _both(self, blocks: Iterator[tuple[np.ndarray, np.ndarray]]):
        """Queues of the L and of the S suffixes, from blocks of S* suffixes in the order of their letters."""
        seeds = self._by_letter(blocks)
        larger = self._induce(seeds, False)
        for queue in seeds:
            queue.close()
        falling = self._reversed(larger)
        smaller = self._induce(falling, True)
        for queue in falling:
            queue.close()
        return larger, smaller

    def _stars(self, a: int, b: int) -> np.ndarray:
        return self.star[a:b].astype(np.int64)

    def _same(self, a: np.ndarray, b: np.ndarray, stops: np.ndarray) -> np.ndarray:
        """Pairs of S* positions with the same substring, up to and with the next S* position."""
        size, n = stops[a >> 1] - a, len(self.t)
        first, last = np.minimum(a, b), np.maximum(a, b)
        fits = np.minimum(size, n - last)
        return (size == stops[b >> 1] - b) & (
            (self.hash[first + fits] - self.hash[first]) * self._power(last - first) == self.hash[last + fits] - self.hash[last])

    def _named(self, order: np.ndarray) -> tuple[np.ndarray, int]:
        """The reduced string (a rank from 1 for every S* substring, in text order) and its number of letters; the order of
        substrings goes to ``order``. S* positions lie two apart at least, so half a position is a place of its own."""
        n, m = len(self.t), len(self.star)
        stops, names = (self._file(name, self.kinds[0], n // 2 + 1) for name in ("stops", "names"))
        for a, b in spans(m):
            here = self._stars(a, b + 1)
            stops[here[: b - a] >> 1] = np.append(here[1:] + 1, n)[: b - a]
        larger, smaller = self._both((self._stars(a, b), np.zeros(b - a, np.int64)) for a, b in spans(m))
        for queue in larger:
            queue.close()
        at = rank = 0
        last = np.zeros(0, np.int64)
        for queue in smaller:
            for i in range(len(queue) - 1, -1, -1):
                found = queue.get(i)[0, ::-1]
                found = found[self._is_star(found)]
                if not len(found):
                    continue
                both = np.concatenate((last, found))
                new = np.concatenate((np.ones(1 - len(last), bool), ~self._same(both[:-1], both[1:], stops)))
                ranks = rank + np.cumsum(new)
                names[found >> 1] = ranks
                order[at: at + len(found)] = found
                at, rank, last = at + len(found), int(ranks[-1]), found[-1:]
            queue.close()
        del stops
        self._drop("stops")
        reduced = self._file("ranks-1", self.kinds[0], m)
        for a, b in spans(m):
            reduced[a:b] = names[self._stars(a, b) >> 1]
        del names
        self._drop("names")
        return reduced, rank

    def _doubled(self, rank: np.ndarray, span: int, order: np.ndarray) -> tuple[np.ndarray, int]:
        """Ranks of twice the span and their number; the order goes to ``order``.

        Runs of ``memory`` pairs are sorted on file. Keys sampled from the runs cut the keys into ranges: single sampled keys, which
        need no sorting, and what lies between two of them, at most ``memory`` pairs over all runs together.
        """
        m, size = len(rank), self.memory
        keys, places = ((np.empty(m, kind) if m <= size else self._file(name, kind, m))
                        for name, kind in (("keys", np.int64), ("places", self.kinds[0])))
        new = self._file(f"ranks-{2 * span}", self.kinds[0], m)
        runs = list(spans(m, size))
        for a, b in runs:
            key = rank[a:b].astype(np.int64) * (m + 2)
            more = rank[a + span: b + span].astype(np.int64)
            key[: len(more)] += more
            by_key = np.argsort(key, kind="stable")
            keys[a:b], places[a:b] = key[by_key], by_key + a
        step = max(1, size // len(runs))
        sample = np.unique(np.concatenate([keys[a:b:step] for a, b in runs]))
        bounds = np.unique(np.concatenate((sample, sample + 1)))
        cuts = np.array([np.append(a + np.searchsorted(keys[a:b], bounds), b) for a, b in runs])
        sizes = np.diff(cuts, axis=1).sum(0)
        at = last = k = 0
        while k < len(sizes):
            stop = k + 1
            while stop < len(sizes) and sizes[k:stop + 1].sum() <= size:
                stop += 1
            parts = [(low, high) for low, high in zip(cuts[:, k].tolist(), cuts[:, stop].tolist()) if low < high]
            if sizes[k] > size and stop == k + 1:              # one key that many pairs share
                last += 1
                pieces = ((places[low + x: low + y].astype(np.int64), last) for low, high in parts for x, y in spans(high - low))
            elif parts:
                key, place = (np.concatenate([f[low:high] for low, high in parts]) for f in (keys, places))
                by_key = np.argsort(key, kind="stable")
                key = key[by_key]
                ranks = last + np.cumsum(np.concatenate(([True], key[1:] != key[:-1])))
                last = int(ranks[-1])
                pieces = ((place[by_key].astype(np.int64), ranks),)
            else:
                pieces = ()
            for place, ranks in pieces:
                new[place] = ranks
                order[at: at + len(place)] = self.star[place]
                at += len(place)
            k = stop
        if m > size:
            self._drop("keys", "places")
        return new, last

    def _star_order(self) -> np.ndarray:
        """S* suffixes in order of their first depth characters, on file."""
        m = len(self.star)
        if m < 2:
            return self.star
        order = self._file("order", self.kinds[0], m)
        rank, letters = self._named(order)
        span = 1
        while 2 * span <= self.depth and letters < m:          # a substring spans two characters at least
            rank, letters = self._doubled(rank, span, order)
            self._drop(f"ranks-{span}")
            span *= 2
        self._drop(f"ranks-{span}")
        return order

    def _with_prefixes(self, order: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for a, b in spans(len(order)):
            here = order[max(a - 1, 0): b].astype(np.int64)
            prefix = self.common(here[:-1], here[1:])
            yield (here[1:], prefix) if a else (here, np.append(0, prefix))

    def order(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of (positions, prefixes) of all suffixes in order; a prefix is what a suffix shares with the one before,
        up to depth."""
        if not len(self.t):
            return
        larger, smaller = self._both(self._with_prefixes(self._star_order()))
        last = None
        for low, high in zip(larger, self._reversed(smaller)):
            for queue in (low, high):
                for i in range(len(queue)):
                    block = queue.get(i)
                    if i == 0:
                        block[1, 0] = 0 if last is None else self.common(block[0, :1], np.array([last]))[0]
                    last = block[0, -1]
                    yield block[0], block[1]
                queue.close()
        for queue in smaller:
            queue.close()
