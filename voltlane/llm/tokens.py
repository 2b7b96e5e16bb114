"""Byte-level BPE over bounded pieces of text: vectorised splitting into words, and each distinct word encoded once.

A merge never crosses the words of the splitting pattern, so the ids of a text are those of its words one after the
other. A piece is therefore encoded by its distinct words; how a new word is encoded is up to the caller.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Callable
from pathlib import Path
from types import SimpleNamespace

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import SparkSession

from voltlane.llm.common import PIECE_BYTES, distinct_slices, prefix_hash, same_bytes, slice_hash, worker_store

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SPACE, LETTER, NUMBER, OTHER = 0, 1, 2, 3
CACHED_WORDS = 1_000_000
MOST_IDS = (1 << 16) - 1
Ragged = tuple[np.ndarray, np.ndarray]


def public_vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def vocabulary(path: str | None = None) -> SimpleNamespace:
    """What tasks need of a vocabulary file: its bytes, the special tokens, and the character classes.

    Plain values only: broadcasts are unpickled by executors that may lack this package.
    """
    raw = Path(path or public_vocabulary()).read_bytes()
    if max(json.loads(raw)["model"]["vocab"].values()) > MOST_IDS:
        raise ValueError(f"ids are kept in 16 bits: a vocabulary may have ids up to {MOST_IDS}")
    specials = [(t["content"].encode(), t["id"]) for t in json.loads(raw)["added_tokens"]]
    return SimpleNamespace(raw=raw, specials=specials, classes=character_classes())


def ship_vocabulary(spark: SparkSession, path: str | None):
    """The vocabulary, a few MB whatever the input, for every executor; ``path`` is the driver's."""
    return spark.sparkContext.broadcast(vocabulary(path))


def byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    free = iter(range(256, 512))
    return [chr(b if b in plain else next(free)) for b in range(256)]


def character_classes() -> np.ndarray:
    """Class of every code point, as the tokenizers library's own patterns see it."""
    store = worker_store("classes")
    if "table" not in store:
        from tokenizers import Regex, pre_tokenizers

        table = np.full(0x110000, OTHER, np.uint8)
        for kind, pattern in ((SPACE, r"\s+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
            split = pre_tokenizers.Split(Regex(pattern), "removed", invert=True)
            for low in range(0, 0x110000, 2048):  # the surrogates are whole blocks of this size
                if not 0xD800 <= low < 0xE000:
                    for _, (a, b) in split.pre_tokenize_str("".join(map(chr, range(low, low + 2048)))):
                        table[low + a : low + b] = kind
        store["table"] = table
    return store["table"]


def special_spans(data: np.ndarray, offsets: np.ndarray, specials: list[tuple[bytes, int]]) -> np.ndarray:
    """Start and end of each special token's text, leftmost first; none crosses documents."""
    whole = data.tobytes()
    if not any(s in whole for s, _ in specials):
        return np.zeros((0, 2), np.int64)
    pattern = re.compile(b"|".join(re.escape(s) for s, _ in specials))
    found = []
    for i in range(len(offsets) - 1):
        found += [m.span() for m in pattern.finditer(whole, offsets[i], offsets[i + 1])]
    return np.array(found, np.int64).reshape(-1, 2)


def split_words(data: np.ndarray, offsets: np.ndarray, vocabulary: SimpleNamespace) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of the words of the splitting pattern, and for each document where its words begin.

    Special tokens in the text are words, and what stands between them is split as a text of its own.

    The pattern is ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``: runs of one class,
    a single space goes with what follows, and short English endings are words of their own.
    """
    n_docs = len(offsets) - 1
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    at = np.flatnonzero((data & 0xC0) != 0x80)  # byte position of each character
    n = len(points)
    if n == 0:
        return np.zeros(1, np.int64), np.zeros(n_docs + 1, np.int64)
    doc_start = np.searchsorted(at, offsets)
    edge = np.zeros(n + 1, bool)
    edge[doc_start] = True
    special = np.searchsorted(at, special_spans(data, offsets, vocabulary.specials))
    edge[special.ravel()] = True
    kind = vocabulary.classes[points]
    change = edge[:-1].copy()
    change[1:] |= kind[1:] != kind[:-1]
    run = np.flatnonzero(change)
    run_end = np.append(run[1:], n)
    kinds, last_in_doc = kind[run], edge[run_end]
    space = kinds == SPACE
    start = np.zeros(n + 1, bool)
    # white space: all but its last character is one word, the last one stands alone or goes with what follows
    start[run[space & (last_in_doc | (run_end - run > 1))]] = True
    start[run_end[space & ~last_in_doc] - 1] = True
    words = run[~space]
    joined = np.zeros(len(words), bool)
    inner = ~edge[words]
    joined[inner] = points[words[inner] - 1] == 0x20
    start[words[~joined]] = True
    # endings: an apostrophe alone in its run, not joined to a space, before s t m d re ve ll
    alone = words[(~joined) & (points[words] == 0x27) & ((run_end - run)[~space] == 1)]
    one = alone[~edge[alone + 1]]
    if len(one):
        first = points[one + 1]
        two = np.zeros(len(one), np.uint32)
        more = ~edge[np.minimum(one + 2, n)]
        two[more] = points[one[more] + 2]
        short = np.isin(first, [ord(c) for c in "stmd"])
        long = ((first == ord("r")) | (first == ord("v"))) & (two == ord("e")) | (first == ord("l")) & (two == ord("l"))
        start[one[short | long] + 1] = False
        start[one[short] + 2] = True
        start[one[long] + 3] = True
    for a, b in special.tolist():
        start[a + 1 : b] = False
        start[a] = True
    begins = np.flatnonzero(start[:n])
    return np.append(at[begins], len(data)), np.searchsorted(begins, doc_start)


def gather(values: np.ndarray, offsets: np.ndarray, rows: np.ndarray) -> Ragged:
    """The ragged rows ``rows`` of a ragged array."""
    lengths = (offsets[1:] - offsets[:-1])[rows]
    ends = np.zeros(len(rows) + 1, np.int64)
    np.cumsum(lengths, out=ends[1:])
    index = np.arange(ends[-1]) + np.repeat(offsets[rows] - ends[:-1], lengths)
    return values[index], ends


class WordCache:
    """Ids and bytes of words met before, by hash in sorted arrays of bounded size; a hit is one only if the bytes are equal."""

    def __init__(self, vocabulary: SimpleNamespace, limit: int = CACHED_WORDS):
        self.limit, self.vocabulary = limit, vocabulary
        self._empty()

    def _empty(self) -> None:
        self.keys, self.rows = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.ids, self.offsets = np.zeros(0, np.uint16), np.zeros(1, np.int64)
        self.text, self.text_offsets = np.zeros(0, np.uint8), np.zeros(1, np.int64)
        for content, number in self.vocabulary.specials:
            word = np.frombuffer(content, np.uint8)
            ends = np.array([len(word)])
            key = slice_hash(prefix_hash(word), np.array([0]), ends)
            self.add(key, np.array([number]), np.array([0, 1]), word, np.array([0]), ends)

    def full(self, words: int, size: int) -> bool:
        return len(self.keys) + words > self.limit or len(self.text) + size > 64 * PIECE_BYTES

    def find(self, keys: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Rows of the words, -1 where there is none. A key with other bytes empties the cache."""
        if not len(self.keys):
            return np.full(len(keys), -1, np.int64)
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        rows = np.where(self.keys[at] == keys, self.rows[at], -1)
        hit = np.flatnonzero(rows >= 0)
        if not same_bytes(data, starts[hit], ends[hit], self.text, self.text_offsets[rows[hit]], self.text_offsets[rows[hit] + 1]).all():
            self._empty()
            rows[:] = -1
        return rows

    def add(self, keys: np.ndarray, ids: np.ndarray, offsets: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Add sorted new keys; the rows they got."""
        rows = np.arange(len(keys)) + len(self.offsets) - 1
        where = np.searchsorted(self.keys, keys)
        self.keys, self.rows = np.insert(self.keys, where, keys), np.insert(self.rows, where, rows)
        self.ids = np.concatenate([self.ids, ids.astype(np.uint16)])
        self.offsets = np.concatenate([self.offsets, offsets[1:] + self.offsets[-1]])
        lengths = ends - starts
        upto = np.cumsum(lengths)
        index = np.arange(int(upto[-1]) if len(upto) else 0) + np.repeat(starts - upto + lengths, lengths)
        self.text = np.concatenate([self.text, data[index]])
        self.text_offsets = np.concatenate([self.text_offsets, upto + self.text_offsets[-1]])
        return rows


def encode_piece(data: np.ndarray, offsets: np.ndarray, new_words: Callable[[np.ndarray, np.ndarray, np.ndarray], Ragged], cache: WordCache) -> Ragged:
    """Ids of each document of a piece. ``new_words(data, starts, ends)`` encodes words not met before."""
    bounds, doc_words = split_words(data, offsets, cache.vocabulary)
    if len(bounds) < 2:
        return np.zeros(0, np.uint16), np.zeros(len(offsets), np.int64)
    first, keys, inverse = distinct_slices(data, bounds[:-1], bounds[1:])
    starts, ends = bounds[first], bounds[first + 1]
    rows = cache.find(keys, data, starts, ends)
    if cache.full((rows < 0).sum(), (ends - starts)[rows < 0].sum()):  # it starts anew: encode what it forgets again
        cache._empty()
        rows = cache.find(keys, data, starts, ends)
    missing = np.flatnonzero(rows < 0)
    if len(missing):
        ids, upto = new_words(data, starts[missing], ends[missing])
        rows[missing] = cache.add(keys[missing], ids, upto, data, starts[missing], ends[missing])
    flat_ids, upto = gather(cache.ids, cache.offsets, rows[inverse])
    return flat_ids, upto[doc_words]


def library_words(raw: bytes) -> Callable[[np.ndarray, np.ndarray, np.ndarray], Ragged]:
    """New words encoded by the tokenizers library's model."""
    store = worker_store("library")
    if "model" not in store:
        from tokenizers import Tokenizer

        store["model"] = Tokenizer.from_str(raw.decode()).model
        store["alphabet"] = np.array([ord(c) for c in byte_alphabet()], np.uint32)
    tokenize, alphabet = store["model"].tokenize, store["alphabet"]

    def run(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Ragged:
        lengths = ends - starts
        where = np.concatenate([[0], np.cumsum(lengths)])
        index = np.arange(where[-1]) + np.repeat(starts - where[:-1], lengths)
        text = alphabet[data[index]].tobytes().decode("utf-32-le")
        out, counts = [], np.empty(len(starts), np.int64)
        cuts = where.tolist()
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            ids = [t.id for t in tokenize(text[a:b])]
            counts[i] = len(ids)
            out += ids
        return np.array(out, np.uint16), np.concatenate([[0], np.cumsum(counts)])

    return run


class Merges:
    """The vocabulary's merges as sorted arrays, and exact merging of many words at once."""

    def __init__(self, raw: bytes):
        model = json.loads(raw)["model"]
        vocab = model["vocab"]
        alphabet = byte_alphabet()
        self.byte_ids = np.array([vocab[c] for c in alphabet], np.int32)
        back = {c: b for b, c in enumerate(alphabet)}
        self.token_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(back[c] for c in token)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        key = left << 20 | right
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.made = key[order], order.astype(np.int32), made
        self.none = np.int32(len(pairs))

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair; ``none`` where there is no merge or no symbol (negative)."""
        key = a.astype(np.int64) << 20 | b.astype(np.int64)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.ranks[at], self.none)

    def _block(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge the padded rows of ``s`` until no pair is left; symbols and their number."""
        n, width = s.shape
        ranks = np.full((n, width), self.none, np.int32)
        ranks[:, :-1] = self.rank(s[:, :-1], s[:, 1:])
        final = s.copy()
        rows, columns = np.arange(n), np.arange(width)
        while len(rows):
            m = ranks.argmin(1)
            best = ranks[np.arange(len(rows)), m]
            more = best < self.none
            final[rows[~more]] = s[~more]
            rows, s, ranks, m, best = rows[more], s[more], ranks[more], m[more], best[more]
            if not len(rows):
                break
            here = np.arange(len(rows))
            s[here, m] = self.made[best]
            move = np.minimum(columns + (columns > m[:, None]), width - 1)
            s, ranks = np.take_along_axis(s, move, 1), np.take_along_axis(ranks, move, 1)
            s[:, -1], ranks[:, -1] = -1, self.none
            after = s[here, np.minimum(m + 1, width - 1)]
            ranks[here, m] = self.rank(s[here, m], np.where(m + 1 < width, after, -1))
            left = np.flatnonzero(m > 0)
            ranks[left, m[left] - 1] = self.rank(s[left, m[left] - 1], s[left, m[left]])
        return final, (final >= 0).sum(1)

    def _long(self, symbols: list[int]) -> list[int]:
        """One long word with a queue of pairs."""
        import heapq

        s = np.array(symbols)
        ranks = self.rank(s[:-1], s[1:]).tolist()
        symbols, before = list(symbols), [i - 1 for i in range(len(symbols))]
        after = [i + 1 for i in range(len(symbols))]
        after[-1] = -1
        queue = [(r, i) for i, r in enumerate(ranks) if r < self.none]
        heapq.heapify(queue)
        pair = {i: r for r, i in queue}
        while queue:
            r, i = heapq.heappop(queue)
            if pair.get(i) != r:
                continue
            j = after[i]
            symbols[i], symbols[j] = int(self.made[r]), -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
            pair.pop(j, None)
            pair.pop(i, None)
            for k in (before[i], i):
                if k >= 0 and after[k] >= 0:
                    new = int(self.rank(np.array([symbols[k]]), np.array([symbols[after[k]]]))[0])
                    pair.pop(k, None)
                    if new < self.none:
                        pair[k] = new
                        heapq.heappush(queue, (new, k))
        return [x for x in symbols if x >= 0]

    def encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, wide: int = 64) -> Ragged:
        """Ids of the words ``[start, end)``."""
        lengths = ends - starts
        counts, parts, owners = np.zeros(len(starts), np.int64), [], []
        low = 0
        for width in (2, 4, 6, 8, 10, 12, 16, 24, 32, wide):
            group = np.flatnonzero((lengths > low) & (lengths <= width))
            low = width
            for at in range(0, len(group), 10_000):
                g = group[at : at + 10_000]
                index = starts[g, None] + np.arange(width)
                inside = np.arange(width) < lengths[g, None]
                s = np.where(inside, self.byte_ids[data[np.where(inside, index, 0)]], -1).astype(np.int32)
                final, counts[g] = self._block(s)
                parts.append(final[final >= 0])
                owners.append(g)
        for g in np.flatnonzero(lengths > wide):
            ids = self._long(self.byte_ids[data[starts[g] : ends[g]]].tolist())
            counts[g] = len(ids)
            parts.append(np.array(ids, np.int32))
            owners.append(np.array([g]))
        offsets = np.concatenate([[0], np.cumsum(counts)])
        if not parts:
            return np.zeros(0, np.uint16), offsets
        order = np.concatenate(owners)
        packed = np.concatenate([[0], np.cumsum(counts[order])])
        where = np.empty(len(order), np.int64)
        where[order] = np.arange(len(order))
        ids, _ = gather(np.concatenate(parts), packed, where)
        return ids.astype(np.uint16), offsets


def merges(raw: bytes) -> Merges:
    store = worker_store("merges")
    if "value" not in store or store["of"] != hash(raw):
        store["value"], store["of"] = Merges(raw), hash(raw)
    return store["value"]
