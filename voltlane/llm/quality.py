"""Quality rules with repeated passages from a word-level suffix array.

The words of a bounded piece of documents are put in one suffix array by prefix doubling; words are told apart by
document, so no common prefix crosses documents. Neighbours in the array give the longest common prefixes, whose
intervals are the repeated substrings: their spans are united, and the covered share of words and the longest repeat
are limited. Everything is local to a document: no shuffle at all.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from voltlane.llm.common import distinct_slices, flat, mix, owner, pieces, slice_hash, sums, token_prefix, word_bounds

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SYMBOLS = b"#*$%&|<>"
MIN_REPEAT_WORDS, MAX_COVERED, MAX_LONGEST = 8, 0.3, 100
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def suffix_ranks(tokens: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Places of all suffixes in their order, by ranks of their first 1, 2, 4, … words.

    ``tokens`` are keys that differ between documents. A suffix that ends sorts first. Only the last ranks are kept.
    """
    n = len(tokens)
    order = np.argsort(tokens, kind="stable")
    s = tokens[order]
    head = np.concatenate([[True], s[1:] != s[:-1]])
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))  # a group's rank is where it begins
    step = 1
    single = head & np.concatenate([head[1:], [True]])
    active = order[~single]
    while len(active):
        ahead = active + step
        inside = ahead < n
        inside[inside] = doc[ahead[inside]] == doc[active[inside]]
        second = np.full(len(active), -1, np.int64)
        second[inside] = rank[ahead[inside]]
        first = rank[active]
        by = np.lexsort((second, first))
        active, first, second = active[by], first[by], second[by]
        new_group = np.concatenate([[True], first[1:] != first[:-1]])
        new = new_group | np.concatenate([[True], second[1:] != second[:-1]])
        index = np.arange(len(active))
        base = np.maximum.accumulate(np.where(new_group, index, 0))
        rank[active] = first + np.maximum.accumulate(np.where(new, index, 0)) - base
        active = active[~(new & np.concatenate([new[1:], [True]]))]
        step *= 2
    return rank


def common_prefixes(tokens: np.ndarray, a: np.ndarray, b: np.ndarray, least: int) -> np.ndarray:
    """Words that the suffixes at ``a`` and ``b`` share, 0 if fewer than ``least``: by hashes of 2**k words, longest first.

    Suffixes of one document never agree beyond its end, as tokens differ between documents.
    """
    n, prefix = len(tokens), token_prefix(tokens)
    common = np.zeros(len(a), np.int64)

    def agree(at: np.ndarray, more: int) -> np.ndarray:
        x, y = a[at] + common[at], b[at] + common[at]
        ok = np.maximum(x, y) + more <= n
        ok[ok] = slice_hash(prefix, x[ok], x[ok] + more) == slice_hash(prefix, y[ok], y[ok] + more)
        return ok

    live = np.arange(len(a))
    live = live[agree(live, least)]
    common[live] = least
    grow, k = live, 0  # pairs that agree on 2**k words more go on to the next power
    reach = np.zeros(len(a), np.int64)
    while len(grow):
        ok = agree(grow, 1 << k)
        common[grow[ok]] += 1 << k
        reach[grow[ok]] = k + 1
        grow, k = grow[ok], k + 1
    for k in range(int(reach.max(initial=0)), -1, -1):
        some = live[reach[live] >= k]
        ok = agree(some, 1 << k)
        common[some[ok]] += 1 << k
    return common


def longest_repeats(tokens: np.ndarray, doc: np.ndarray, least: int) -> np.ndarray:
    """For each word the length of the longest repeat of at least ``least`` words that starts there, else 0.

    Two neighbours of the suffix array share exactly the longest common prefix of the interval between them.
    """
    n, least = len(tokens), max(least, 1)
    found = np.zeros(n, np.int64)
    if n < 2:
        return found
    array = np.empty(n, np.int64)
    array[suffix_ranks(tokens, doc)] = np.arange(n)
    at = np.flatnonzero(tokens[array[1:]] == tokens[array[:-1]])
    left, right = array[at], array[at + 1]
    common = common_prefixes(tokens, left, right, least)
    np.maximum.at(found, left, common)
    np.maximum.at(found, right, common)
    return found


def measure(data: np.ndarray, offsets: np.ndarray, least: int = MIN_REPEAT_WORDS) -> dict[str, np.ndarray]:
    """All measures of the documents whose bytes lie between the offsets."""
    n_docs, n = len(offsets) - 1, len(data)
    starts, ends = word_bounds(data, offsets)
    doc = owner(starts, offsets)
    n_words = np.bincount(doc, minlength=n_docs)
    character = (data & 0xC0) != 0x80
    kinds = np.zeros(256, np.int8)
    kinds[[0x20, *range(9, 14)]] = 1
    out = {"n_words": n_words, "word_chars": sums(character & (kinds[data] == 0), offsets)}
    symbol = np.zeros(256, bool)
    symbol[list(SYMBOLS)] = True
    out["n_symbols"] = sums(symbol[data], offsets)

    salt = mix(np.arange(1, n_docs + 1, dtype=np.uint64))
    # lines: from a document's start or a \n to the next \n or the document's end
    breaks = np.flatnonzero(data == 10)
    line_starts = np.concatenate([offsets[:-1], breaks + 1])
    line_ends = np.concatenate([offsets[1:], breaks])
    line_starts, line_ends = np.sort(line_starts), np.sort(line_ends)
    line_doc = np.searchsorted(offsets[1:], line_starts, side="right")
    last = np.flatnonzero(line_ends >= line_starts)
    line_starts, line_ends, line_doc = line_starts[last], line_ends[last], np.minimum(line_doc[last], n_docs - 1)
    wordy = np.searchsorted(starts, line_ends) > np.searchsorted(starts, line_starts)
    line_starts, line_ends = line_starts[wordy], line_ends[wordy]
    line_doc = owner(line_starts, offsets)
    _, keys, which = distinct_slices(data, line_starts, line_ends)
    lines = keys[which] + salt[line_doc]
    by = np.lexsort((line_starts, lines))
    again = np.zeros(len(by), bool)
    again[1:] = lines[by][1:] == lines[by][:-1]
    out["n_dup_lines"] = np.bincount(line_doc[by][again], minlength=n_docs)

    _, keys, which = distinct_slices(data, starts, ends)
    tokens = mix(keys[which] + salt[doc])
    covered = np.zeros(len(tokens), bool)
    if len(tokens) > 2:
        whole = doc[2:] == doc[:-2]
        three = mix(mix(tokens[:-2]) * np.uint64(3) + mix(tokens[1:-1] ^ np.uint64(0x5851F42D4C957F2D)) * np.uint64(5) + tokens[2:])
        at = np.flatnonzero(whole)
        by = np.argsort(three[at], kind="stable")
        s = three[at][by]
        same = s[1:] == s[:-1]
        twice = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        hit = at[by[twice]]
        for k in range(3):
            covered[hit + k] = True
    out["n_repeat_words"] = np.bincount(doc[covered], minlength=n_docs)

    lengths = longest_repeats(tokens, doc, least)
    edge = np.zeros(len(tokens) + 1, np.int64)
    hit = np.flatnonzero(lengths)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + lengths[hit], -1)
    inside = np.cumsum(edge)[:-1] > 0
    out["n_covered_words"] = np.bincount(doc[inside], minlength=n_docs)
    longest = np.zeros(n_docs, np.int64)
    np.maximum.at(longest, doc[hit], lengths[hit])
    out["longest_repeat"] = longest
    return out


def verdict(found: dict[str, np.ndarray], max_covered: float, max_longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether the fixed rules fail, and whether a document is kept."""
    failed = (found["n_words"] < 50) | (100 * found["n_repeat_words"] > 50 * found["n_words"])
    fine = (found["n_covered_words"] <= max_covered * found["n_words"]) & (found["longest_repeat"] <= max_longest)
    return failed, ~failed & fine


def quality_measures(
    docs: DataFrame, *, min_repeat_words: int = MIN_REPEAT_WORDS, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST
) -> DataFrame:
    """One row per document with its measures and the verdict.

    A null or empty text has no words and fails. Repeated rows and null ids are measured like any other row; columns
    other than ``doc_id`` and ``text`` are ignored. An empty table gives no rows.
    """
    numbers = (*MEASURES, "n_covered_words", "longest_repeat")
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{c} long" for c in numbers) + ", base_failed boolean, kept boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            found = measure(*flat(piece.column(1)), min_repeat_words)
            failed, kept = verdict(found, max_covered, max_longest)
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), *[pa.array(found[c].astype(np.int64)) for c in numbers], pa.array(failed), pa.array(kept)],
                ["doc_id", *numbers, "base_failed", "kept"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def keep_quality(
    docs: DataFrame, *, min_repeat_words: int = MIN_REPEAT_WORDS, max_covered: float = MAX_COVERED, max_longest: int = MAX_LONGEST
) -> DataFrame:
    """The rows of ``docs``, with all columns, that pass the rules."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [f"c{i}" for i in range(batch.num_columns)]
            for piece in pieces([pa.RecordBatch.from_arrays(batch.columns, names)], f"c{at}"):
                found = measure(*flat(piece.column(at)), min_repeat_words)
                kept = pa.array(verdict(found, max_covered, max_longest)[1])
                yield pa.RecordBatch.from_arrays([c.filter(kept) for c in piece.columns], batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
