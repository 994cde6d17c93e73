"""Winnowed seeds: how the repeated-substring operators find windows that may repeat.

A window is N consecutive tokens (bytes or words). Its seed is the least fingerprint among the
W = N-K+1 stretches of K tokens in it, leftmost on ties, so that equal windows have equal seeds
at equal places. Consecutive windows with one seed form a run, named by the seed's fingerprint
and by the fingerprint of all tokens the run's windows cover.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from terralith.llm import _text as T

#: Bits of a fingerprint that give way to the place, so that a minimum tells where it lies.
PLACE = (1 << 28) - 1
#: Tokens of one text worked on at a time; the next piece overlaps by a window less one token.
PIECE = 1 << 17


class Runs(NamedTuple):
    row: np.ndarray
    first: np.ndarray  # the first and last window start, within the text
    last: np.ndarray
    seed: np.ndarray
    name: np.ndarray  # of seed, place and content together
    place: np.ndarray  # where the seed begins, within the text

    @staticmethod
    def of(parts: list[Runs]) -> Runs:
        return Runs(*(np.concatenate(x) for x in zip(*parts, strict=True))) if parts else Runs(*(np.zeros(0, np.int64),) * 3, *(np.zeros(0, np.uint64),) * 2, np.zeros(0, np.int64))


def pieces(sizes: np.ndarray, starts: np.ndarray, window: int, limit: int):
    """Stretches (first row, row after, token from, token to) of about limit tokens that hold every window once."""
    i, n = 0, len(sizes)
    while i < n:
        if sizes[i] > limit + window:
            for at in range(0, int(sizes[i]) - window + 1, limit):
                yield i, i + 1, int(starts[i]) + at, int(starts[i]) + min(int(sizes[i]), at + limit + window - 1)
            i += 1
        else:
            j, total = i, 0
            while j < n and sizes[j] <= limit + window and (j == i or total + sizes[j] <= limit):
                total += sizes[j]
                j += 1
            yield i, j, int(starts[i]), int(starts[j - 1] + sizes[j - 1])
            i = j


def runs_of(values: np.ndarray, starts: np.ndarray, k: int, window: int, limit: int = PIECE) -> Runs:
    """The runs of rows whose tokens' values lie end to end; starts has where each row begins and the end."""
    w, out = window - k + 1, []
    for i, j, lo, hi in pieces(np.diff(starts), starts[:-1], window, limit):
        n = hi - lo
        if n < window:
            continue
        h = T.prefix_hash(values[lo:hi])
        grams = T.gram_hash(h, k)
        at = (T.slide_min((grams & T.U(~PLACE % 2**64)) | np.arange(len(grams), dtype=np.uint64), w) & T.U(PLACE)).astype(np.int64)
        inside = np.ones(len(at), bool)
        row = np.full(len(at), i)
        if j - i > 1:
            edges = starts[i : j + 1] - lo
            of = np.repeat(np.arange(i, j), np.diff(edges))
            row = of[: len(at)]
            inside = row == of[window - 1 :]
        new = np.empty(len(at), bool)
        new[0], new[1:] = True, (at[1:] != at[:-1]) | ~inside[:-1] | (row[1:] != row[:-1])
        end = np.empty(len(at), bool)
        end[-1], end[:-1] = True, new[1:] | ~inside[1:]
        first, last = np.flatnonzero(new & inside), np.flatnonzero(end & inside)
        if len(first):
            seed = grams[at[first]]
            name = T.mix(T.span_hash(h, first, last + window) ^ T.mix(seed + (at[first] - first).astype(np.uint64)))
            base = starts[row[first]] - lo
            out.append(Runs(row[first], first - base, last - base, seed, name, at[first] - base))
    return Runs.of(out)


def windows_of(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every window start of the runs, and the run it belongs to."""
    n = last - first + 1
    run = np.repeat(np.arange(len(n)), n)
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[run], run


def covered(size: int, starts: np.ndarray, window: int) -> np.ndarray:
    """Which of size tokens lie in a window that begins at one of the starts."""
    step = np.zeros(size + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, starts + window, -1)
    return np.cumsum(step[:-1]) > 0


def find(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Where each key lies in a sorted table, or -1."""
    if not len(table):
        return np.full(len(keys), -1)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return np.where(table[at] == keys, at, -1)
