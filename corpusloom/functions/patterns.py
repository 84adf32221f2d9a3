"""Many words at once: an automaton over all words of a block of rules, run along each text once. Free of Spark."""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import ahocorasick


class RuleBlock:
    """Rules in order, each (any_words, and_any, none_words): the first one that a text meets.

    A rule is met if the text holds one of any_words, one of each group of and_any and none of none_words; a rule without
    any_words is never met. The automaton finds all words of all rules in one pass; rules are then decided on the set of
    words met, lowest first, and only those one of whose any_words is in it.
    """

    def __init__(self, rules: Iterable[tuple[list[str] | None, list[list[str]] | None, list[str] | None]]):
        self.numbers: dict[str, int] = {}
        self.rules: list[tuple[list[frozenset[int]], frozenset[int]]] = []
        self.by_word: dict[int, list[int]] = {}
        for k, (any_words, groups, none_words) in enumerate(rules):
            for w in dict.fromkeys(self._ids(any_words)):
                self.by_word.setdefault(w, []).append(k)
            self.rules.append(([frozenset(self._ids(g)) for g in groups or []], frozenset(self._ids(none_words))))
        self.always = {n for w, n in self.numbers.items() if w == ""}
        self.automaton = ahocorasick.Automaton()
        for word, n in self.numbers.items():
            if word:
                self.automaton.add_word(word, n)
        self.automaton.make_automaton()

    def _ids(self, words: list[str] | None) -> list[int]:
        return [self.numbers.setdefault(w, len(self.numbers)) for w in words or [] if w is not None]

    def first(self, text: str | None) -> int | None:
        """The place of the first rule that text meets; null texts meet none."""
        if text is None:
            return None
        met = set(self.always)
        if len(self.automaton):
            met.update(n for _, n in self.automaton.iter(text))
        for k in heapq.merge(*(self.by_word[w] for w in met if w in self.by_word)):
            groups, none = self.rules[k]
            if none.isdisjoint(met) and not any(g.isdisjoint(met) for g in groups):
                return k
        return None
