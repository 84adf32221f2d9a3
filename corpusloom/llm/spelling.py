"""Spelling variants: words one edit apart, by Levenshtein automata run over broadcast shards of a compact trie."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import discard, for_python, lookup, written

#: A word of which the checksum is a multiple of this loses a letter.
SLIP = 97
#: Words in a trie shard, and bytes of shards in one broadcast: the bound of what the driver and a worker hold.
SHARD_WORDS = 200_000
ROUND_BYTES = 24_000_000
#: Words that are searched together; distinct words that a counting task holds; characters of a text split at once.
BLOCK_WORDS = 2_048
HELD_WORDS = 300_000
SLICE_CHARS = 1_000_000
_LONG = 64


def _letters() -> bytes:
    """Latin-1 bytes to what they count as: letters (A-Z lower-cased, U+00C0 to U+00FF as they are), else a blank."""
    keep = lambda i: i + 32 if 65 <= i <= 90 else i if 97 <= i <= 122 or i >= 0xC0 else 32
    return bytes(keep(i) for i in range(256))


_FOLD = _letters()


def _advance() -> np.ndarray:
    """What n zero bytes do to a CRC-32 register, as tables by n, byte place and byte: crc(a + b) is that of a, advanced
    by len(b), xor crc(b)."""
    unit = np.array([zlib.crc32(bytes([i]), 0xFFFFFFFF) ^ 0xFF000000 for i in range(256)], dtype=np.uint32)
    unit ^= unit[0]
    out = np.empty((_LONG + 1, 4, 256), dtype=np.uint32)
    out[0] = np.arange(256, dtype=np.uint32)[None, :] << (np.arange(4, dtype=np.uint32) * 8)[:, None]
    for n in range(_LONG):
        out[n + 1] = out[n] >> 8 ^ unit[out[n] & 0xFF]
    return out.reshape(-1)


class _Ids(dict):
    """Numbers words in the order in which they come, with their checksums and lengths."""

    def __init__(self):
        super().__init__()
        self.words: list[bytes] = []
        self.crc: list[int] = []
        self.utf8: list[int] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.words)
        data = word if word.isascii() else word.decode("latin-1").encode()
        self.words.append(word)
        self.crc.append(zlib.crc32(data))
        self.utf8.append(len(data))
        return n


class _Counter:
    """Counts the words of documents, each after its slip; holds a bounded number of distinct words."""

    def __init__(self):
        self.advance = _advance()
        self.clear()

    def clear(self) -> None:
        self.ids, self.counts, self.slipped = _Ids(), np.zeros(0, dtype=np.int64), {}

    def add(self, doc_ids: list, texts: list) -> None:
        tokens: list[bytes] = []
        upto, crcs = [], []
        for doc_id, text in zip(doc_ids, texts, strict=True):
            if not text:
                continue
            data = text.encode("latin-1", "replace").translate(_FOLD)
            prefix = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
            at = 0
            while at < len(data):
                end = data.find(b" ", at + SLICE_CHARS) if len(data) - at > SLICE_CHARS else -1
                end = len(data) if end < 0 else end
                tokens += data[at:end].split()
                upto.append(len(tokens))
                crcs.append(prefix)
                at = end
                if len(tokens) > SLICE_CHARS:
                    self._take(tokens, upto, crcs)
                    tokens, upto, crcs = [], [], []
        if tokens:
            self._take(tokens, upto, crcs)

    def _take(self, tokens: list[bytes], upto: list[int], crcs: list[int]) -> None:
        ids = np.fromiter(map(self.ids.__getitem__, tokens), dtype=np.int64, count=len(tokens))
        register = np.repeat(np.array(crcs, dtype=np.uint32), np.diff(np.array([0, *upto])))
        crc, utf8 = np.array(self.ids.crc, dtype=np.uint32), np.array(self.ids.utf8, dtype=np.int64)
        size = utf8[ids]
        row = np.minimum(size, _LONG) << 10
        h = crc[ids]
        for k in range(4):
            h ^= self.advance[row + (k << 8) + (register >> np.uint32(8 * k) & np.uint32(0xFF))]
        for i in np.flatnonzero(size > _LONG).tolist():
            h[i] = zlib.crc32(tokens[i].decode("latin-1").encode(), int(register[i]))
        slips = np.flatnonzero(h % SLIP == 0)
        counts = np.bincount(np.delete(ids, slips), minlength=len(self.ids.words))
        counts[: len(self.counts)] += self.counts
        self.counts = counts
        for i, v in zip(slips.tolist(), h[slips].tolist(), strict=True):
            word = tokens[i]
            k = v % len(word)
            word = word[:k] + word[k + 1 :]
            self.slipped[word] = self.slipped.get(word, 0) + 1

    def rows(self, least: int) -> pa.RecordBatch:
        some = [(w, n) for w, n in zip(self.ids.words, self.counts.tolist(), strict=True) if n and len(w) >= least]
        some += [(w, n) for w, n in self.slipped.items() if len(w) >= least]
        words = pa.array([w.decode("latin-1") for w, _ in some], pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array([n for _, n in some], pa.int64())], ["word", "n"])


def count_words(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_length: int = 5) -> DataFrame:
    """word, n: how often each word of at least min_length letters occurs, over all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Counter()
        for batch in batches:
            held.add(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            if len(held.ids.words) + len(held.slipped) > HELD_WORDS:
                yield held.rows(min_length)
                held.clear()
        yield held.rows(min_length) if len(held.counts) else pa.RecordBatch.from_pydict({"word": pa.array([], pa.string()), "n": pa.array([], pa.int64())})

    for_python(docs.sparkSession)
    parts = docs.select(F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`").cast("string")).mapInArrow(count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n"))


class Trie:
    """A shard of a trie in flat arrays: nodes in breadth-first order, the children of a node side by side.

    labels has the byte that leads to each node, start its first child. A subtree of one key is a leaf, whose tail is read
    from the key itself. word is the key that ends at an inner node or stands at a leaf, or -1.
    """

    def __init__(self, labels: bytes, start: list[int], word: list[int], keys: list[bytes], counts: list[int]):
        self.labels, self.start, self.word, self.keys, self.counts = labels, start, word, keys, counts

    @classmethod
    def packed(cls, keys: list[bytes], counts: list[int]) -> tuple[bytes, bytes, bytes, bytes, bytes]:
        """The arrays of sorted distinct keys, as they travel."""
        labels, start, word, queue = bytearray(1), [], [], [(0, len(keys), 0)]
        for lo, hi, depth in queue:  # grows as it is read
            start.append(len(labels))
            if hi - lo == 1:
                word.append(lo)
                continue
            ends = len(keys[lo]) == depth if lo < hi else False
            word.append(lo if ends else -1)
            at = lo + ends
            while at < hi:
                c, first = keys[at][depth], at
                while at < hi and keys[at][depth] == c:
                    at += 1
                labels.append(c)
                queue.append((first, at, depth + 1))
        start.append(len(labels))
        ints = lambda xs, kind: np.array(xs, dtype=kind).tobytes()
        return bytes(labels), ints(start, "<u4"), ints(word, "<i4"), b"\n".join(keys), ints(counts, "<i8")

    @classmethod
    def unpacked(cls, labels: bytes, start: bytes, word: bytes, keys: bytes, counts: bytes) -> Trie:
        ints = lambda data, kind: np.frombuffer(data, dtype=kind).tolist()
        return cls(labels, ints(start, "<u4"), ints(word, "<i4"), keys.split(b"\n"), ints(counts, "<i8"))

    def below(self, prefix: bytes) -> tuple[int, int] | None:
        """The node that prefix leads to and its depth (a leaf may come before the end of prefix), if any."""
        node, start, find = 0, self.start, self.labels.find
        for depth, c in enumerate(prefix):
            if start[node] == start[node + 1]:
                return (node, depth) if self.keys[self.word[node]].startswith(prefix) else None
            if (node := find(c, start[node], start[node + 1])) < 0:
                return None
        return node, len(prefix)

    def accepted(self, key: bytes, exact: int) -> list[int]:
        """The keys at distance one of key that share its first exact bytes, by depth-first search of the automaton."""
        if (found := self.below(key[:exact])) is None:
            return []
        node, depth = found
        start, word, keys, labels, size = self.start, self.word, self.keys, self.labels, len(key)
        find, out = labels.find, []

        def rest(node: int, depth: int, i: int) -> None:
            """The edit is made: what is left of key has to stand below node as it is."""
            while start[node] != start[node + 1]:
                if i == size:
                    if word[node] >= 0:
                        out.append(word[node])
                    return
                if (node := find(key[i], start[node], start[node + 1])) < 0:
                    return
                depth, i = depth + 1, i + 1
            if keys[word[node]][depth:] == key[i:]:
                out.append(word[node])

        i = exact
        while True:
            lo, hi = start[node], start[node + 1]
            if lo == hi:  # one key is left: the edit is compared in full
                if one_edit(key, keys[word[node]]):
                    out.append(word[node])
                break
            if i < size:
                rest(node, depth, i + 1)
                c, after = key[i], -1
                for child in range(lo, hi):
                    rest(child, depth + 1, i)
                    if labels[child] == c:
                        after = child
                    else:
                        rest(child, depth + 1, i + 1)
                if after < 0:
                    break
                node, depth, i = after, depth + 1, i + 1
            else:
                for child in range(lo, hi):
                    rest(child, depth + 1, i)
                break
        return list(dict.fromkeys(out)) if len(out) > 1 else out


def one_edit(a: bytes, b: bytes) -> bool:
    """Whether exactly one byte is inserted, deleted or replaced."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) >= len(b)) :] == b[i + (len(b) >= len(a)) :]


_PACKED = "way int, shard long, first binary, last binary, labels binary, start binary, word binary, keys binary, counts binary"


def _shards(words: DataFrame, n_words: int) -> DataFrame:
    """The trie shards of all words (way 0) and of all words reversed (way 1): ranges of the sorted keys."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        rows = ((w, k, c) for b in batches for w, k, c in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True))
        for way, group in groupby(rows, key=lambda r: r[0]):
            keys: list[bytes] = []
            counts: list[int] = []
            more = True
            while more:
                more = (row := next(group, None)) is not None
                if more:
                    keys.append(row[1])
                    counts.append(row[2])
                if keys and (len(keys) == SHARD_WORDS or not more):
                    out = [way, part << 20 | n, keys[0], keys[-1], *Trie.packed(keys, counts)]
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(out, [pa.int32(), pa.int64(), *[pa.binary()] * 7], strict=True)], [c.split()[0] for c in _PACKED.split(", ")])
                    keys, counts, n = [], [], n + 1

    latin = lambda c: F.encode(c, "ISO-8859-1")
    ways = F.explode(F.array(F.struct(F.lit(0).alias("way"), latin(F.col("word")).alias("key")), F.struct(F.lit(1).alias("way"), latin(F.reverse("word")).alias("key"))))
    keyed = words.select(ways.alias("k"), "n").select("k.way", "k.key", "n")
    parts = max(1, 2 * n_words // SHARD_WORDS, min(2 * n_words // BLOCK_WORDS, words.sparkSession.sparkContext.defaultParallelism))
    return keyed.repartitionByRange(parts, "way", "key").sortWithinPartitions("way", "key").mapInArrow(pack, _PACKED)


def near_words(words: DataFrame) -> DataFrame:
    """Of distinct words (word, n): word, n_near, form_n, form for each word with a near one: how many words are one edit
    away, and the most frequent of them (ties: the smallest).

    An edit in the later half of a word leaves its first half as it is, an edit in the earlier half its last: so the
    automaton runs over the trie of words with an exact first half, and over that of reversed words with an exact last
    half. Words are searched in sorted blocks; a block skips the shards whose keys cannot share an exact half with it, in
    which every automaton would die at the root. Shards are broadcast in rounds of bounded size.
    """
    spark = words.sparkSession
    for_python(spark)
    packed = written(_shards(words, words.count()), "trie-shards")
    bytes_of = sum((F.length(c) for c in ("labels", "start", "word", "keys", "counts")), F.lit(0))
    known = sorted(tuple(r) for r in packed.select("way", "first", "last", "shard", bytes_of).collect())  # a row a shard
    bounds = [(way, bytes(first), bytes(last), shard) for way, first, last, shard, _ in known]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for way, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                keys, rows = data.split(b"\n"), []
                for at in range(0, len(keys), BLOCK_WORDS):
                    block = keys[at : at + BLOCK_WORDS]
                    halves = [k[: _exact(k, way)] for k in block]
                    low, high = min(halves), {len(h): h for h in sorted(halves)}
                    meets = lambda first, last: low <= last and any(first[:n] <= h for n, h in high.items())  # noqa: E731, B023
                    rows += [(shard, way, b"\n".join(block)) for w, first, last, shard in bounds if w == way and meets(first, last)]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), [pa.int64(), pa.int32(), pa.binary()], strict=True)], ["shard", "way", "block"])

    blocks = written(packed.select("way", "keys").mapInArrow(deal, "shard long, way int, block binary"), "word-blocks")
    found, held, size = [], [], 0
    for _, _, _, shard, n_bytes in known:
        held.append(shard)
        size += n_bytes
        if size >= ROUND_BYTES or shard == known[-1][3]:
            found.append(_round(packed, blocks, held))
            held, size = [], 0
    if not found:
        found = [spark.createDataFrame([], "word string, n_near long, form_n long, form string")]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    best = F.min(F.struct((-F.col("form_n")).alias("m"), F.col("form").alias("w")))
    out = written(out.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")).select("word", "n_near", (-F.col("best.m")).alias("form_n"), F.col("best.w").alias("form")), "near-words")
    discard(packed, blocks, *found)
    return out


def _exact(key: bytes, way: int) -> int:
    return len(key) // 2 if way == 0 else len(key) - len(key) // 2


def _round(packed: DataFrame, blocks: DataFrame, shards: list[int]) -> DataFrame:
    """The near words in some shards, which are broadcast."""
    spark = packed.sparkSession
    some = packed.filter(F.col("shard").isin(shards)).select("shard", "labels", "start", "word", "keys", "counts").collect()
    sent = spark.sparkContext.broadcast({r[0]: tuple(map(bytes, r[1:])) for r in some})

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_shard, trie = None, None
        for batch in batches:
            rows = []
            for shard, way, data in sorted(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)):
                if shard != open_shard:
                    open_shard, trie = shard, Trie.unpacked(*sent.value[shard])
                for key in data.split(b"\n"):
                    hits = trie.accepted(key, _exact(key, way))
                    if way == 1 and hits:  # those with the first half in common are found by the other way
                        tail = key[_exact(key, way) :]
                        hits = [x for x in hits if not trie.keys[x].endswith(tail)]
                    if hits:
                        turn = -1 if way else 1
                        n, form = min((-trie.counts[x], trie.keys[x][::turn]) for x in hits)
                        rows.append((key[::turn].decode("latin-1"), len(hits), -n, form.decode("latin-1")))
            columns = zip(*rows, strict=True) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, [pa.string(), pa.int64(), pa.int64(), pa.string()], strict=True)], ["word", "n_near", "form_n", "form"])

    here = blocks.filter(F.col("shard").isin(shards))
    n = max(1, min(here.count(), 4 * spark.sparkContext.defaultParallelism))
    out = written(here.repartition(n, F.xxhash64("shard", "block")).mapInArrow(search, "word string, n_near long, form_n long, form string"), "near-parts")
    sent.destroy()
    return out


def _roots(forms: DataFrame) -> DataFrame:
    """word, root: the end of each chain of forms (word, form), by doubling: counts at least double along a chain, so a
    chain of a trillion occurrences takes six rounds."""
    chain = written(forms.select("word", F.col("form").alias("root"), F.lit(True).alias("open")), "forms")
    while not chain.filter("open").isEmpty():
        weights = chain.groupBy("root").agg(F.count(F.lit(1)).alias("many"))
        nexts = written(chain.select(F.col("word").alias("at"), F.col("root").alias("next")).join(weights.withColumnRenamed("root", "at"), "at"), "forms-next")
        step = lookup(chain, nexts, {"root": "at"}, "many", "left") if not nexts.isEmpty() else chain.withColumn("next", F.lit(None).cast("string"))
        stepped = written(step.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("open")), "forms")
        discard(chain, nexts)
        chain = stepped
    return chain.select("word", "root")


def spelling_variants(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", min_length: int = 5, min_count: int = 3, ratio: int = 2) -> DataFrame:
    """Words and their forms: word, n, n_near, form, form_n, root.

    A word is a run of Latin letters (A-Z, a-z, U+00C0 to U+00FF; only A-Z are lower-cased) after its slip: if SLIP divides
    the CRC-32 of "<id>:<run>", the run loses one letter. Words of at least min_length letters that occur at least
    min_count times count. Two words are near if one letter is inserted, deleted or replaced. A word's form is its near
    word of largest n (ties: the smallest in code-point order), if that is at least ratio times its own n; its root is the
    end of the chain of forms, the word itself without one. ratio has to be over 1, so chains end.

    Null and empty texts have no words; a null id stands as an empty string in the checksum. Very long texts are split in
    slices between words. Repeated rows count as often as they stand there. Other columns are not read, whatever their
    names. An empty table gives none. Characters beyond U+00FF separate words.
    """
    counted = count_words(docs, text_col, id_col, min_length)
    words = written(counted.filter(F.col("n") >= min_count), "words")
    near = near_words(words).withColumnRenamed("word", "of")
    takes = F.col("form_n") >= ratio * F.col("n")
    full = words.join(near, F.col("word") == F.col("of"), "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(takes, F.col("form")).alias("form"), F.when(takes, F.col("form_n")).alias("form_n")
    )
    full = written(full, "words-near")
    roots = _roots(full.filter(F.col("form").isNotNull())).withColumnRenamed("word", "of")
    out = full.join(roots, F.col("word") == F.col("of"), "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
    discard(words, near)
    return out
