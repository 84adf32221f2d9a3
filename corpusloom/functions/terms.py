"""The fold of terms and their variants, one term after the other."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable


class TermFold:
    """The terms that stay of those added so far, as (key, length, row) in order.

    A term meets the first that stays of which the key holds its own, or the other way round: the longer one stays, at that
    place; a term that meets none goes to the end. Keys inside a new key are looked up by its pieces, keys around it by
    its rarest run of up to three characters. Where a key led is known until a place gets another key."""

    def __init__(self) -> None:
        self.kept: list[tuple[str, int, tuple]] = []
        self._places: dict[str, set[int]] = defaultdict(set)
        self._grams: dict[str, set[int]] = defaultdict(set)
        self._sizes: dict[int, int] = defaultdict(int)
        self._led: dict[str, int] = {}

    def add(self, key: str, length: int, row: Callable[[], tuple]) -> None:
        at = self._led.get(key)
        if at is None:
            at = self._first(key)
        if at is None:
            at = len(self.kept)
            self.kept.append((key, length, row()))
            self._index(key, at)
        elif length > self.kept[at][1]:
            old = self.kept[at][0]
            self.kept[at] = key, length, row()
            if old != key:
                self._forget(old, at)
                self._index(key, at)
                self._led.clear()
        self._led[key] = at

    def _first(self, key: str) -> int | None:
        n = len(key)
        found = [min(self._places[piece]) for size in self._sizes if size <= n for piece in {key[i : i + size] for i in range(n - size + 1)} if piece in self._places]
        first = min(found, default=len(self.kept))
        runs = [self._grams.get(g) for g in _grams(key, min(3, n))]
        if all(runs):
            first = min((at for at in min(runs, key=len) if at < first and key in self.kept[at][0]), default=first)
        return first if first < len(self.kept) else None

    def _index(self, key: str, at: int) -> None:
        self._places[key].add(at)
        self._sizes[len(key)] += 1
        for size in (1, 2, 3):
            for g in _grams(key, size):
                self._grams[g].add(at)

    def _forget(self, key: str, at: int) -> None:
        self._places[key].discard(at)
        if not self._places[key]:
            del self._places[key]
        self._sizes[len(key)] -= 1
        if not self._sizes[len(key)]:
            del self._sizes[len(key)]
        for size in (1, 2, 3):
            for g in _grams(key, size):
                self._grams[g].discard(at)


def _grams(key: str, size: int) -> set[str]:
    return {key[i : i + size] for i in range(len(key) - size + 1)}
