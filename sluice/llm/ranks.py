"""Names for repeated stretches of words by prefix doubling: exact, without hashes."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np


def split_words(text: str) -> list[bytes]:
    """The words [^\\x20\\x09-\\x0D]+ of a text as UTF-8. bytes.split() without arguments parts at just these bytes."""
    return text.encode("utf-8", "replace").split()


def name_words(words: Iterable[bytes], count: int) -> np.ndarray:
    """A number for each word; equal words have equal numbers."""
    names: dict[bytes, int] = {}
    return np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, count)


def repeated(names: np.ndarray, group: np.ndarray | None = None) -> np.ndarray:
    """Ranks of the words that occur twice or more (within a group), -1 for all others and for negative names."""
    rank = np.full(len(names), -1, np.int64)
    at = np.flatnonzero(names >= 0)
    if len(at):
        keys = names[at] if group is None else group[at] * (int(names.max()) + 1) + names[at]
        _keep(rank, at, keys)
    return rank


def joined(rank: np.ndarray, step: int) -> np.ndarray:
    """Ranks of what begins at each place, made of the stretch there and the one `step` places on.

    rank names stretches of one length. A place keeps a rank if the longer
    stretch occurs twice or more; the others cannot begin a repeat and get -1.
    """
    out = np.full(len(rank), -1, np.int64)
    at = np.flatnonzero(rank[: len(rank) - step] >= 0) if step < len(rank) else np.zeros(0, np.int64)
    at = at[rank[at + step] >= 0]
    if len(at):
        _keep(out, at, rank[at] * (int(rank.max()) + 1) + rank[at + step])
    return out


def _keep(rank: np.ndarray, at: np.ndarray, keys: np.ndarray) -> None:
    _, which, count = np.unique(keys, return_inverse=True, return_counts=True)
    more = count[which] > 1
    rank[at[more]] = which[more]


class Stretches:
    """Ranks of stretches of growing length, from those of single words. Ask for lengths in ascending order."""

    def __init__(self, rank: np.ndarray):
        self.rank, self.length = rank, 1

    def of(self, length: int) -> np.ndarray:
        while 2 * self.length <= length:
            self.rank = joined(self.rank, self.length)
            self.length *= 2
        return self.rank if self.length == length else joined(self.rank, length - self.length)

    def any(self) -> bool:
        return bool((self.rank >= 0).any())
