"""Byte-level BPE by corpus-level merge replay.

The words of a whole slice of the corpus are laid out as one sequence of symbols. An inverted index maps each merge
rank to the positions where its pair stands; the ranks are replayed once, in order, over all words together, and each
merge looks only at the neighbours it has touched. A word is thus never scanned again from its start.

Two vocabularies are read: rank files (token bytes and rank; a pair merges if its concatenation is a token) and JSON
files with an explicit merge list.
"""

from __future__ import annotations

import base64
import heapq
import json
import re
from bisect import bisect_right
from itertools import chain

import numpy as np
import regex

#: How many distinct pieces each of a worker's two generations of memory holds, how many symbols one replay takes, and
#: how much text is cut into pieces at once. They bound memory only; results do not depend on them.
CACHE_PIECES = 100_000
REPLAY_SYMBOLS = 2_000_000
SLICE_CHARS = 5_000_000

_SHIFT = 20
_NONE = 1 << 30
_SPACE_AFTER_SPACE = re.compile(r"\s ")

#: Fixed value: the pattern (in two spellings) of which no match crosses a place before a space that follows a non-space,
#: nor looks back over it. Texts may be cut there for these only; by any other pattern they are matched whole.
CUTTABLE = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
    r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
)


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes in JSON vocabularies: printable bytes stand for themselves, the others
    are numbered from U+0100 in byte order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    out = {chr(b): b for b in plain}
    for n, b in enumerate(b for b in range(256) if b not in plain):
        out[chr(256 + n)] = b
    return out


class Vocabulary:
    """Token bytes by id, and for each pair of ids its merge rank and the id it becomes."""

    def __init__(self, tokens: dict[int, bytes], pairs: dict[tuple[int, int], int], becomes: list[int], specials: dict[str, int]):
        self.tokens, self.becomes, self.specials = tokens, becomes, specials
        self.pair_rank = {(a << _SHIFT) | b: r for (a, b), r in pairs.items()}
        self.ids = {t: i for i, t in tokens.items()}
        self.byte_id = np.array([self.ids[bytes([b])] for b in range(256)], dtype=np.int64)
        self.byte_pairs = np.full(1 << 16, _NONE, dtype=np.int64)
        self.keys = np.array(sorted(self.pair_rank) + [1 << 62], dtype=np.int64)
        self.key_rank = np.array([self.pair_rank.get(int(k), _NONE) for k in self.keys], dtype=np.int64)
        back = {int(i): b for b, i in enumerate(self.byte_id)}
        for (a, b), r in pairs.items():
            if a in back and b in back:
                self.byte_pairs[back[a] << 8 | back[b]] = r

    @classmethod
    def from_ranks(cls, data: bytes) -> Vocabulary:
        ids = {base64.b64decode(t): int(r) for t, r in (line.split() for line in data.splitlines() if line)}
        pairs = {}
        for token, rank in ids.items():
            for cut in range(1, len(token)):
                a, b = ids.get(token[:cut]), ids.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a, b] = rank
        return cls({i: t for t, i in ids.items()}, pairs, list(range(max(ids.values()) + 1)), {})

    @classmethod
    def from_json(cls, data: bytes) -> Vocabulary:
        spec = json.loads(data)
        stand_in, vocab = byte_alphabet(), spec["model"]["vocab"]
        specials = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        raw = {t: bytes(stand_in[c] for c in t) for t in vocab if t not in specials}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        pairs: dict[tuple[int, int], int] = {}
        for rank, (a, b) in enumerate(merges):
            pairs[vocab[a], vocab[b]] = rank
        return cls({vocab[t]: b for t, b in raw.items()}, pairs, [vocab[a + b] for a, b in merges], specials)

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The merge rank of each pair of ids, or _NONE."""
        wanted = left.astype(np.int64) << _SHIFT | right
        at = np.searchsorted(self.keys, wanted)
        return np.where(self.keys[at] == wanted, self.key_rank[at], _NONE)

    def replay(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, as little-endian int32 bytes; every merge is applied to all words in rank order."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        flat = np.frombuffer(b"\0".join(words) + b"\0", dtype=np.uint8).astype(np.int64)
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        sym = self.byte_id[flat].astype(np.int32)
        sym[ends] = -1  # no pair spans two words
        n = len(flat)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        first = self.byte_pairs[flat[:-1] << 8 | flat[1:]]
        first[(sym[:-1] < 0) | (sym[1:] < 0)] = _NONE
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def post(places: np.ndarray, ranks: np.ndarray) -> None:
            """Enters positions into the inverted index under the rank of the pair that starts there."""
            some = ranks < _NONE
            places, ranks = places[some], ranks[some]
            if not len(ranks):
                return
            order = np.argsort(ranks, kind="stable")
            places, ranks = places[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            bounds = [0, *cuts.tolist(), len(ranks)]
            for rank, lo, hi in zip(ranks[bounds[:-1]].tolist(), bounds, bounds[1:], strict=False):
                if rank in index:
                    index[rank].append(places[lo:hi])
                else:
                    index[rank] = [places[lo:hi]]
                    heapq.heappush(heap, rank)

        post(np.arange(n - 1, dtype=np.int32), first)
        again: set[int] = set()
        while heap:
            rank = heapq.heappop(heap)
            held = index.pop(rank)
            at = np.unique(np.concatenate(held)) if len(held) > 1 else held[0]
            at = at[sym[at] >= 0]
            nxt = after[at]
            here = (sym[nxt] >= 0) & (self.ranks_of(sym[at], sym[nxt]) == rank)
            at, nxt = at[here], nxt[here]
            if not len(at):
                continue
            chained = nxt[:-1] == at[1:]
            if chained.any():  # a run of overlapping pairs: from its left end, every other one merges
                head = np.flatnonzero(np.concatenate([[True], ~chained]))
                place = np.arange(len(at)) - np.repeat(head, np.diff(np.append(head, len(at))))
                at, nxt = at[place % 2 == 0], nxt[place % 2 == 0]
            sym[at] = self.becomes[rank]
            sym[nxt] = -2
            far = after[nxt]
            after[at] = far
            before[far] = at
            near = before[at]
            open_right, open_left = sym[far] >= 0, (near >= 0) & (sym[near] >= 0)
            places = np.concatenate([at[open_right], near[open_left]])
            ranks = np.concatenate([self.ranks_of(sym[at[open_right]], sym[far[open_right]]), self.ranks_of(sym[near[open_left]], sym[at[open_left]])])
            if (low := ranks < rank).any():  # a pair of a lower rank: in such a word the order of merges may differ
                again.update(places[low].tolist())
            post(places, ranks)
        alive = sym >= 0
        upto = np.concatenate([[0], np.cumsum(alive)])
        packed = sym[alive].astype("<i4").tobytes()
        lo, hi = (upto[starts] * 4).tolist(), (upto[ends] * 4).tolist()
        out = [packed[a:b] for a, b in zip(lo, hi, strict=True)]
        for w in {bisect_right(starts, i) - 1 for i in again}:  # replayed alone, from its start
            out[w] = np.array(self.one_word(words[w]), dtype="<i4").tobytes()
        return out

    def one_word(self, word: bytes) -> list[int]:
        """The plain definition: merge the leftmost pair of lowest rank until there is none."""
        parts = [int(self.byte_id[b]) for b in word]
        while True:
            ranks = [self.pair_rank.get(a << _SHIFT | b, _NONE) for a, b in zip(parts, parts[1:], strict=False)]
            if not ranks or (low := min(ranks)) == _NONE:
                return parts
            i = ranks.index(low)
            parts[i : i + 2] = [self.becomes[low]]

    def whole_tokens(self, pattern: regex.Pattern) -> set[str]:
        """The strings proven to encode alone as one token: valid text, one match of the pattern, replayed to one id."""
        texts = []
        for token in self.tokens.values():
            try:
                text = token.decode()
            except UnicodeDecodeError:
                continue
            if pattern.findall(text) == [text]:
                texts.append(text)
        return {t for t, ids in zip(texts, self.replay([t.encode() for t in texts]), strict=True) if len(ids) == 4}


def pieces(text: str) -> list[str]:
    """Cuts text before each space that follows a non-space: no match of a pattern of CUTTABLE crosses such a place, nor
    looks back over it, so the pieces can be matched one by one."""
    if "\0" in text:
        parts = [p if i == 0 else " " + p for i, p in enumerate(text.split(" "))]
    else:
        parts = text.replace(" ", "\0 ").split("\0")
    if not _SPACE_AFTER_SPACE.search(text) and text[:1] != " ":
        return parts
    out = [parts[0]]
    for part in parts[1:]:
        if not out[-1] or out[-1][-1].isspace():
            out[-1] += part
        else:
            out.append(part)
    return out


class Coder:
    """Encodes texts with a vocabulary and a pretokenizer pattern; remembers a bounded number of pieces."""

    def __init__(self, vocabulary: Vocabulary, pattern: str, whole: dict[bytes, int] | None = None):
        """whole: the words that have an id without merging (all tokens of a rank file; proven strings otherwise)."""
        self.vocabulary, self.pattern, self.cuttable = vocabulary, regex.compile(pattern), pattern in CUTTABLE
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.whole = {word: np.array([i], dtype="<i4").tobytes() for word, i in (whole or {}).items()}

    def _learn(self, new: list[str]) -> None:
        """The ids of pieces not seen before: their distinct words are replayed together, in blocks of bounded size."""
        findall = self.pattern.findall
        split = [[p] if not self.cuttable or p[1:].isalpha() and (p[0] == " " or p[0].isalpha()) else findall(p) for p in new]
        words = list(set(chain.from_iterable(split)))
        ids: dict[str, bytes] = {}
        whole = self.whole.get
        block: list[str] = []
        raw: list[bytes] = []
        symbols = 0
        for word, data in zip(words, map(str.encode, words), strict=True):
            if (known := whole(data)) is not None:
                ids[word] = known
                continue
            block.append(word)
            raw.append(data)
            symbols += len(data) + 1
            if symbols >= REPLAY_SYMBOLS:
                ids.update(zip(block, self.vocabulary.replay(raw), strict=True))
                block, raw, symbols = [], [], 0
        if block:
            ids.update(zip(block, self.vocabulary.replay(raw), strict=True))
        get, known_pieces = ids.__getitem__, self.known
        for p, w in zip(new, split, strict=True):
            known_pieces[p] = get(w[0]) if len(w) == 1 else b"".join(map(get, w))

    def _matches(self, text: str) -> list[str]:
        return [m.group() for m in self.pattern.finditer(text) if m.group()]

    def encode_slice(self, texts: list[str]) -> list[bytes]:
        if len(self.known) > CACHE_PIECES:  # pieces still in use move on to the new generation
            self.known, self.older = {}, self.known
        cut = list(map(pieces if self.cuttable else self._matches, texts))
        new = set(chain.from_iterable(cut)).difference(self.known)
        kept = new.intersection(self.older)
        self.known.update(zip(kept, map(self.older.__getitem__, kept), strict=True))
        self._learn(list(new - kept))
        get = self.known.__getitem__
        return [b"".join(map(get, c)) for c in cut]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text (null: empty) as int32 bytes; texts go through in slices of bounded length."""
        out: list[bytes] = []
        batch: list[str] = []
        chars = 0
        for text in texts:
            batch.append(text or "")
            chars += len(text or "")
            if chars >= SLICE_CHARS:
                out += self.encode_slice(batch)
                batch, chars = [], 0
        return out + self.encode_slice(batch) if batch else out

    def encode_with_specials(self, texts: list[str | None]) -> list[bytes]:
        """As encode(); the strings of special tokens inside a text become their ids, as the JSON library does."""
        specials = self.vocabulary.specials
        if not specials:
            return self.encode(texts)
        cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(specials, key=len, reverse=True)) + ")")
        parts = [cut.split(t) if t else [""] for t in texts]
        plain = iter(self.encode([p for ps in parts for p in ps[::2]]))
        return [b"".join(next(plain) if i % 2 == 0 else np.array([specials[p]], dtype="<i4").tobytes() for i, p in enumerate(ps)) for ps in parts]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, ids.tolist()))
