"""Trigram word similarity: words are padded with two blanks before and one after, and cut in threes."""

from __future__ import annotations

import re


def trigrams_of(text: str) -> list[str]:
    """In order of appearance."""
    return [padded[i : i + 3] for word in re.findall(r"\w+", text.lower()) for padded in [f"  {word} "] for i in range(len(padded) - 2)]


def word_similarity_of(query: str, text: str, above: float = 0.0) -> float:
    """The most that shared / (all of the query, and what else the extent has) reaches over continuous extents of the
    text's trigrams; 0 if it is not above the given value. An extent starts and ends at trigrams of the query, and ends
    where what else it has rules a better share out."""
    wanted = set(trigrams_of(query))
    have = trigrams_of(text)
    spots = [i for i, t in enumerate(have) if t in wanted]
    if not wanted or len({have[i] for i in spots}) <= above * len(wanted):
        return 0.0
    best = above
    for a, start in enumerate(spots):
        most = len(wanted) / best - len(wanted) if best else len(have)
        both, others = set(), set()
        upto = start
        for end in spots[a:]:
            others.update(have[upto:end])
            others -= wanted
            both.add(have[end])
            upto = end + 1
            if len(others) > most:
                break
            best = max(best, len(both) / (len(wanted) + len(others)))
    return best if best > above else 0.0
