"""Suffix order and common prefixes of a shard by external induced sorting.

A shard is a row of snippets, each closed by its own end mark. Suffixes smaller than the one behind
them (S) and larger ones (L) are told apart; the leftmost S suffixes are sorted first, by
naming the pieces between them and ordering the string of names; all others are induced from
them, L suffixes in rising order, then S suffixes in falling order. What a suffix induces waits
in a queue under its first character together with the common prefix it has with the suffix
before it: one more than the least common prefix between their sources. A queue is read only
when its character's turn has come, so queues live in memory up to a bound and on disk beyond.
"""

from __future__ import annotations

import os
import tempfile

import numpy as np

END = 0
MEMORY = 64 << 20


class BucketQueue:
    """A priority queue of (suffix, common prefix) by first character, first in first out in each.

    Whatever exceeds ``memory`` bytes goes to one temporary file of the task, in whole runs, and is
    read back when its character is taken. The file goes with the queue.
    """

    def __init__(self, memory: int = MEMORY):
        self.memory, self.held, self.file, self.size = memory, 0, None, 0
        self.runs: dict[int, list] = {}

    def push(self, character: int, suffixes: np.ndarray, common: np.ndarray) -> None:
        entry = np.stack([suffixes.astype(np.int64), common.astype(np.int64)])
        self.runs.setdefault(character, []).append(entry)
        self.held += entry.nbytes
        if self.held > self.memory:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        for character, runs in self.runs.items():
            for k, run in enumerate(runs):
                if isinstance(run, np.ndarray):
                    self.file.seek(0, os.SEEK_END)
                    runs[k] = (self.file.tell(), run.shape[1])
                    self.file.write(run.tobytes())
            self.runs[character] = runs
        self.held = 0

    def take(self, character: int) -> tuple[np.ndarray, np.ndarray]:
        """Everything waiting under a character, in the order in which it came."""
        runs = []
        for run in self.runs.pop(character, []):
            if isinstance(run, tuple):
                self.file.seek(run[0])
                run = np.frombuffer(self.file.read(16 * run[1]), np.int64).reshape(2, -1)
            else:
                self.held -= run.nbytes
            runs.append(run)
        if not runs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        joined = np.concatenate(runs, 1)
        return joined[0], joined[1]

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def _least_between(common: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For places a < b < … in a sorted sequence: the common prefix of each with the one before."""
    if len(at) < 2:
        return np.zeros(0, np.int64)
    padded = np.append(common, 0)
    bounds = np.stack([at[:-1] + 1, at[1:] + 1], 1).ravel()
    return np.minimum.reduceat(padded, bounds)[::2]


class Shard:
    """Text, types and runs of a shard; ``text`` holds bytes plus one, and END behind each snippet."""

    def __init__(self, text: np.ndarray):
        self.text, n = text, len(text)
        self.ends = np.flatnonzero(text == END)
        change = np.flatnonzero(np.append(text[1:] != text[:-1], True))
        run_end = np.repeat(change, np.diff(np.append(-1, change)))
        self.run = run_end - np.arange(n) + 1
        after = text[np.minimum(run_end + 1, n - 1)]
        self.smaller = (text < after) | (text == END)
        self.smaller[run_end == n - 1] |= text[run_end == n - 1] == END
        self.leftmost = np.flatnonzero(self.smaller & np.append(False, ~self.smaller[:-1]))
        if n and text[0] == END:
            self.leftmost = np.append(0, self.leftmost)
        self.to_end = self.ends[np.searchsorted(self.ends, np.arange(n))] - np.arange(n)

    def _pass(self, incoming: BucketQueue, fixed: dict[int, tuple], upward: bool, memory: int) -> dict[int, tuple]:
        """One inducing pass; ``fixed`` holds, by character, the sorted suffixes that are known.

        Upward, the L suffixes of a character come first and the known S suffixes behind them.
        Downward everything is turned round: S suffixes first, then the known L suffixes.
        """
        text, made = self.text, {}
        characters = range(0, 257) if upward else range(256, -1, -1)
        present = np.bincount(text, minlength=257) > 0
        for c in characters:
            if not present[c]:
                continue
            own, common = incoming.take(c)
            wave, wave_common, k = own, common, 1
            parts, commons = [own], [common]
            while len(wave) and c != END:
                at = np.flatnonzero((wave > 0) & (text[wave - 1] == c) & (self.smaller[wave - 1] != upward))
                if not len(at):
                    break
                step = np.append(k, 1 + _least_between(wave_common, at)) if len(at) else at
                wave, wave_common = wave[at] - 1, step
                parts.append(wave)
                commons.append(wave_common)
                k += 1
            own, common = np.concatenate(parts), np.concatenate(commons)
            made[c] = own, common
            known, known_common = fixed.get(c, (own[:0], own[:0]))
            if len(known):
                known_common = known_common.copy()
                known_common[0] = min(self.run[own[-1]], self.run[known[0]]) if len(own) else 0
                whole, between = np.concatenate([own, known]), np.concatenate([common, known_common])
            else:
                whole, between = own, common
            if not len(whole):
                continue
            at = np.flatnonzero((whole > 0) & (text[whole - 1] != c))
            before = text[whole[at] - 1]
            good = (before > c) if upward else (before < c) & (before != END)
            good &= self.smaller[whole[at] - 1] != upward
            at, before = at[good], before[good]
            order = np.argsort(before, kind="stable")
            at, before = at[order], before[order]
            starts = np.flatnonzero(np.append(True, before[1:] != before[:-1])) if len(before) else []
            for low, high in zip(starts, np.append(starts[1:], len(before)) if len(before) else [], strict=True):
                group = at[low:high]
                target = int(before[low])
                first = 1 if target in incoming.runs else 0
                incoming.push(target, whole[group] - 1, np.append(first, 1 + _least_between(between, group)))
        incoming.close()
        return made

    def induce(self, leftmost: np.ndarray, common: np.ndarray, memory: int = MEMORY) -> tuple[np.ndarray, np.ndarray]:
        """All suffixes in order with the common prefix of each with the one before."""
        first = self.text[leftmost]
        bounds = np.searchsorted(first, np.arange(258))
        seeds = {c: (leftmost[a:b], common[a:b]) for c, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if b > a}
        large = self._pass(BucketQueue(memory), seeds, True, memory)
        turned = {}
        for c, (own, between) in large.items():
            if len(own):
                turned[c] = own[::-1], np.append(0, between[:0:-1])
        small = self._pass(BucketQueue(memory), turned, False, memory)
        order, prefixes = [self.ends], [np.zeros(len(self.ends), np.int64)]
        for c in range(1, 257):
            rising, a = large.get(c, (self.ends[:0], self.ends[:0]))
            falling, b = small.get(c, (self.ends[:0], self.ends[:0]))
            if len(falling):
                b = np.append(0, b[:0:-1])
                falling = falling[::-1]
                if len(rising):
                    b[0] = min(self.run[rising[-1]], self.run[falling[0]])
            if len(rising):
                a = a.copy()
                a[0] = 0
            order += [rising, falling]
            prefixes += [a, b]
        return np.concatenate(order), np.concatenate(prefixes)

    def _equal(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefix of the suffixes a[k] and b[k]; end marks differ from each other."""
        n = len(self.text)
        padded = np.append(self.text, np.zeros(8, self.text.dtype)).astype(np.uint8)
        words = np.ndarray((n + 1,), "<u8", padded.tobytes(), strides=(1,))
        most = np.minimum(self.to_end[a], self.to_end[b])
        found, alive, at = most.copy(), np.arange(len(a)), 0
        while len(alive):
            alive = alive[most[alive] > at]
            x = words[np.minimum(a[alive] + at, n)] ^ words[np.minimum(b[alive] + at, n)]
            differ = np.flatnonzero(x)
            low = (x[differ] & (~x[differ] + np.uint64(1))).astype(np.float64)
            place = at + (np.log2(low) // 8).astype(np.int64)
            found[alive[differ]] = np.minimum(most[alive[differ]], place)
            alive = np.delete(alive, differ)
            at += 8
        return found

    def sorted_leftmost(self, memory: int = MEMORY) -> np.ndarray:
        """Leftmost S suffixes in order: pieces named by an inducing pass, names ordered as a string."""
        lms = self.leftmost
        by_first = lms[np.argsort(self.text[lms], kind="stable")]
        order, _ = self.induce(by_first, np.zeros(len(lms), np.int64), memory)
        is_lms = np.zeros(len(self.text), bool)
        is_lms[lms] = True
        pieces = order[is_lms[order]]
        place = np.empty(len(self.text), np.int64)
        place[lms] = np.arange(len(lms))
        length = np.diff(np.append(lms, len(self.text) - 1))[place[pieces]]
        same = (length[1:] == length[:-1]) & (self._equal(pieces[1:], pieces[:-1]) > length[1:])
        names = np.empty(len(lms), np.int64)
        names[place[pieces]] = np.cumsum(np.append(True, ~same)) - 1
        return lms[ordered_names(names)]


def ordered_names(names: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of names, by ranks of doubling length."""
    n, width, ranks = len(names), 1, names
    while n and ranks.max() + 1 < n and width < n:
        behind = np.append(ranks[width:] + 1, np.zeros(min(width, n), np.int64))[:n]
        _, ranks = np.unique(ranks * (n + 1) + behind, return_inverse=True)
        width *= 2
    return np.argsort(ranks, kind="stable")


def suffix_order(snippets: list[bytes], memory: int = MEMORY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffixes in order, common prefix with the one before, start of each snippet)."""
    sizes = np.array([len(s) + 1 for s in snippets])
    text = np.frombuffer(b"\xff".join(snippets) + b"\xff", np.uint8)
    shard = Shard((text + np.uint8(1)).astype(np.int16))
    lms = shard.sorted_leftmost(memory)
    common = np.append(0, shard._equal(lms[1:], lms[:-1])) if len(lms) else lms
    order, prefixes = shard.induce(lms, common, memory)
    return order, prefixes, np.cumsum(sizes) - sizes
