"""References to articles of acts in running text: a scanner that keeps track of which act is spoken of.

Small helpers for Arrow batches (operators.citations), free of Spark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

#: Words of the notation. White space and middle dots do not count in names.
BLANK = re.compile(r"[\s·ㆍ‧•]+")
QUOTED = re.compile(r"「([^」]{2,60})」")
LATER = re.compile(r"\([^()]{0,80}?이하[^()]{0,80}?\)")
ALIAS = re.compile(r"이하\s*['\"‘’“”]?\s*([가-힣A-Za-z]{1,10})\s*['\"‘’“”]?\s*(?:이라|라)\s*한다")
SAME = re.compile(r"(?:같은|동)\s*법\s*(시행규칙|시행령)?")
SHORT = re.compile(r"(?<![가-힣])(시행규칙|시행령|법률|규정|규칙|기준|고시|법|영)(?=\s*(?:\([^()]{0,80}\)\s*)?제\s*\d+\s*조)")
ARTICLE = re.compile(r"제\s*(\d+)\s*조(?:\s*의\s*(\d+)|(\d+))?")
LOWER = re.compile(r"\s*(시행령|시행규칙)(?![가-힣])")
DECREE = re.compile(r"\s*시행(령|규칙)$")
BEHIND_NAME = re.compile(r"\s*(?:\([^()]{0,60}\)\s*)?제\s*\d+\s*조")
CITABLE = re.compile(r"(법|법률|시행령|시행규칙|규칙|규정|고시|기준|세칙|분배표|협정)$")
ADDENDUM = "부칙"
CIRCLED = "①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳"
PURPOSE = re.compile(r"이\s*(?:고시|기준|규정|지침|훈령|예규|요령|세칙|시험방법|방법|규칙|기술기준|공고|협정|절차)\s*[은는]")
BASIS_END = re.compile(
    r"에서\s*정[하한]는?\s*바에\s*(?:따라|의하여)|의?\s*규정에\s*(?:따라|따른|의하여|의한)|에서\s*[^,·ㆍ]{0,25}?위임한|에\s*(?:따라|따른|의하여|의한)"
)

#: What may stand right behind an article: its title, paragraphs and items.
TITLE = re.compile(r"\s?\(([^()]{1,40})\)")
PART = re.compile(r"\s*(?:[·ㆍ,]|및|또는)?\s*(?:제\s*(?P<para>\d+)\s*항|(?P<ring>[①-⑳])|제?\s*(?P<item>\d{1,3})\s*호(?:\s*의\s*(?P<branch>\d+))?)")
RANGE = re.compile(r"\s*(?:[~∼〜～]|부터)\s*$")
#: A range of articles is filled in up to this many; of a wider one the two ends count.
WIDEST = 6
#: Names as written that a worker remembers the meaning of.
REMEMBERED = 10_000


def key_of(name: str) -> str:
    return BLANK.sub("", name).lower()


class Names:
    """The names of a registry: a trie over their letters for the longest name at a place, and their keys for lookups."""

    def __init__(self, names: list[str], aliases: dict[str, str] | None = None):
        self.canonical: dict[str, str] = {}
        for name in sorted(names):
            self.canonical.setdefault(key_of(name), name)
        self.aliases = {key_of(a): n for a, n in (aliases or {}).items()}
        self.tails: dict[str, set[str]] = {}
        self.trie: dict = {}
        official = {a: self.canonical.get(key_of(n), n) for a, n in self.aliases.items()}
        for key, name in [*self.canonical.items(), *official.items()]:
            node = self.trie
            for c in key:
                node = node.setdefault(c, {})
            node.setdefault("", name)
        first = "".join(re.escape(c) for c in self.trie)
        self.starts = re.compile(f"(?<![^\\W_])[{first}]", re.IGNORECASE) if first else None
        self.known: dict[str, tuple[str | None, bool]] = {}
        for name in self.canonical.values():
            words = name.split()
            for k in range(1, len(words)):
                self.tails.setdefault(key_of(" ".join(words[k:])), set()).add(name)

    def at(self, text: str, place: int) -> tuple[int, str] | None:
        """Where the longest name that starts at place ends, and the name."""
        node, found, i = self.trie, None, place
        while i < len(text):
            c = text[i]
            if (below := node.get(c.lower())) is not None:
                node = below
                if "" in node:
                    found = (i + 1, node[""])
            elif i == place or not BLANK.match(c):
                break
            i += 1
        return found

    def find(self, text: str) -> Iterator[tuple[int, int, str]]:
        """start, end, name of the longest names that start a word."""
        i = 0
        while self.starts and (m := self.starts.search(text, i)):
            if hit := self.at(text, m.start()):
                yield m.start(), *hit
                i = hit[0]
            else:
                i = m.end()

    def resolve(self, raw: str) -> tuple[str | None, bool]:
        """The name meant, and whether the registry has it; None if it is no name of an act."""
        if (told := self.known.get(raw)) is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            told = self.known[raw] = self._resolved(raw)
        return told

    def _resolved(self, raw: str) -> tuple[str | None, bool]:
        name = re.sub(r"\s*\([^)]*\)\s*$", "", raw.strip(" 「」\t\n")).strip()
        key = key_of(name)
        if len(name) < 2:
            return None, False
        if key in self.canonical:
            return self.canonical[key], True
        if key in self.aliases:
            official = self.aliases[key]
            return self.canonical.get(key_of(official), official), key_of(official) in self.canonical
        return (name, False) if CITABLE.search(name) else (None, False)

    def ending_in(self, raw: str) -> list[str]:
        """The registry's names of which raw is the last words, in order."""
        return sorted(self.tails.get(key_of(raw), ()))


def act_of(name: str) -> str:
    return DECREE.sub("", name).strip()


def _events(text: str, names: Names) -> list[tuple[int, int, str, str]]:
    """start, end, kind and value of all that bears on references, left to right, without overlaps.

    Of events that start together the first kind in the order quoted, later, same, known, short, article wins, of those
    that overlap the earlier one.
    """
    found = [(m.start(), 0, m.end(), "quoted", m[1]) for m in QUOTED.finditer(text)]
    if "이하" in text:
        found += [(m.start(), 1, m.end(), "later", m[0]) for m in LATER.finditer(text)]
    found += [(m.start(), 2, m.end(), "same", m[1] or "") for m in SAME.finditer(text) if m.start() == 0 or not text[m.start() - 1].isalnum()]
    for start, end, name in names.find(text):
        more = LOWER.match(text, end) if not DECREE.search(name) else None
        found.append((start, 3, more.end(), "derived", f"{name} {more[1]}") if more else (start, 3, end, "known", name))
    found += [(m.start(), 4, m.end(), "short", m[1]) for m in SHORT.finditer(text)]
    found += [(m.start(), 5, m.end(), "article", f"{int(m[1])}조" + (f"의{int(m[2] or m[3])}" if m[2] or m[3] else "")) for m in ARTICLE.finditer(text)]
    out, at = [], 0
    for start, _, end, kind, value in sorted(found):
        if start >= at:
            out.append((start, end, kind, value))
            at = end
    return out


@dataclass
class Context:
    """Which act the text speaks of: the last name, the last act among names, and what stands for which name."""

    names: Names
    only_act: str | None = None
    current: str | None = None
    last_act: str | None = None
    aliases: dict[str, str] = field(default_factory=dict)

    def named(self, name: str | None) -> None:
        self.current = name
        if name and not DECREE.search(name):
            self.last_act = name

    def alias(self, words: str) -> None:
        if (m := ALIAS.search(words)) and self.current:
            self.aliases[m[1]] = self.current

    def same(self, kind: str) -> None:
        base = self.last_act or (act_of(self.current) if self.current else None)
        self.current = f"{base} {kind}".strip() if base else None

    def short(self, word: str) -> bool:
        """Follows a short word (the act, the decree); whether it is settled what it stands for."""
        target = self.aliases.get(word)
        if target is None and word in ("법", "법률"):
            target = self.only_act
        if target is None and word in ("영", "시행령", "시행규칙"):
            base = act_of(self.aliases.get("법") or self.only_act or self.last_act or "")
            target = f"{base} {'시행규칙' if word == '시행규칙' else '시행령'}" if base else None
        self.current = (self.names.resolve(target)[0] or target) if target else None
        return target is not None


def _only_act(text: str, names: Names) -> str | None:
    """The act that text names in quotes, if it names one only (its decrees aside)."""
    acts = {n for m in QUOTED.finditer(text) if (n := names.resolve(m[1])[0]) and not DECREE.search(n)}
    return acts.pop() if len(acts) == 1 else None


def basis_of(text: str, strict: bool = True, most: int = 400) -> str:
    """The part of a first article that says on what it is based: from its opening words on (strict: nothing without
    them, which have to stand in its first most characters) to the words of delegation, else most characters."""
    opened = PURPOSE.search(text[:most])
    if opened is None and strict:
        return ""
    text = text[opened.start() :] if opened else text
    end = BASIS_END.search(text)
    return text[: end.end()] if end else text[:most]


def delegations(basis: str, names: Names) -> tuple[list[tuple[str, str, bool]], list[tuple[str, str]]]:
    """(parent, article, resolved) that a basis text refers to, each once and in order, and (words, reason) of what is
    dropped, as a wrong link is worse than none.

    The first pass finds the only act that is named; in the second a name, a word for the same act, an alias or a short
    word says whose the articles that follow are. A name without quotes counts right before an article only.
    """
    seen = Context(names, _only_act(basis, names))
    found: list[tuple[str, str, bool]] = []
    dropped: list[tuple[str, str]] = []
    for start, end, kind, value in _events(basis, names):
        if kind == "quoted":
            name, _ = names.resolve(value)
            seen.named(name)
            if name is None:
                dropped.append((value, "no act"))
        elif kind == "later":
            seen.alias(value)
        elif kind == "same":
            seen.same(value)
        elif kind in ("known", "derived"):
            if BEHIND_NAME.match(basis, end):
                seen.named(value)
        elif kind == "short":
            if not seen.short(value):
                dropped.append((value, "undetermined"))
        elif seen.current is None:
            dropped.append((value, "no act before it"))
        elif ADDENDUM in basis[max(0, start - 6) : start]:
            dropped.append((value, "addendum"))
        else:
            pair = (seen.current, value, names.resolve(seen.current)[1])
            if pair not in found:
                found.append(pair)
    return found, dropped


@dataclass
class Citation:
    """A reference as an answer makes it. how: named, same, alias, short, carried (the act of the reference before it),
    tail (the last words of a name), range (between two ends), or none."""

    at: int
    act: str | None
    how: str
    article: str
    title: str | None
    paras: list[int]
    items: list[str]
    candidates: list[str]


def citations(answer: str, names: Names) -> list[Citation]:
    """The references of an answer, in order, each with the act it is anchored to.

    The nearest name before an article is its act; without one in the same line, what the reference before it had is
    carried on, across lines too. Words that end a registry's name stand for it if only one name ends so, else all such
    names are candidates. The middle of a range of articles is filled in.
    """
    out: list[Citation] = []
    seen = Context(names, _only_act(answer, names))
    how, last_end, candidates = "none", 0, []
    for start, end, kind, value in _events(answer, names):
        if kind == "quoted":
            name, ok = names.resolve(value)
            tails = [] if ok else names.ending_in(value)
            if name or tails:
                seen.named(tails[0] if len(tails) == 1 else name or value)
                how, candidates = "tail" if len(tails) == 1 else "named", tails if len(tails) > 1 else []
        elif kind == "later":
            seen.alias(value)
        elif kind == "same":
            seen.same(value)
            how, candidates = "same", []
        elif kind in ("known", "derived"):
            seen.named(value)
            how, candidates = "named", []
        elif kind == "short":
            was = seen.current
            if seen.short(value):
                how, candidates = "alias" if value in seen.aliases else "short", []
            else:
                seen.current = was if value in ("법", "법률") else None
                how, candidates = ("carried" if seen.current else "none"), []
        else:
            word = _words_before(answer, start)
            if how in ("none", "carried") and word and (tails := names.ending_in(word)):
                seen.named(tails[0] if len(tails) == 1 else word)
                how, candidates = "tail" if len(tails) == 1 else "named", tails if len(tails) > 1 else []
            title, paras, items, upto = _parts(answer, end)
            if out and RANGE.fullmatch(answer[last_end:start]) and re.fullmatch(r"\d+조", value) and re.fullmatch(r"\d+조", out[-1].article):
                low, high = int(out[-1].article[:-1]), int(value[:-1])
                if 0 < high - low < WIDEST:
                    out += [Citation(start, seen.current, "range", f"{n}조", None, [], [], candidates) for n in range(low + 1, high)]
            out.append(Citation(start, seen.current, how if seen.current else "none", value, title, paras, items, candidates))
            how = "carried" if seen.current else "none"
            last_end = upto
    return out


def _words_before(text: str, end: int) -> str:
    """The word that stands right before a place, brackets aside."""
    before = text[max(0, end - 90) : end].rstrip()
    if before.endswith(")"):
        before = re.sub(r"\s*\([^()]*\)\s*$", "", before)
    at = len(before)
    while at and ("가" <= (c := before[at - 1]) <= "힣" or (c.isascii() and c.isalnum())):
        at -= 1
    return before[at:]


def _parts(text: str, at: int) -> tuple[str | None, list[int], list[str], int]:
    """What stands right behind an article: title, paragraphs, items, and where it ends."""
    title = None
    if m := TITLE.match(text, at):
        title, at = m[1].strip(), m.end()
    paras: list[int] = []
    items: list[str] = []
    while m := PART.match(text, at):
        if m["item"]:
            items.append(m["item"] + (f"의{m['branch']}" if m["branch"] else ""))
        else:
            paras.append(int(m["para"]) if m["para"] else CIRCLED.index(m["ring"]) + 1)
        at = m.end()
    return title, list(dict.fromkeys(paras)), list(dict.fromkeys(items)), at
