"""Byte-level BPE encoding with a word lexicon as a minimal acyclic transducer, and decoding.

The frequent words of the corpus, counted over all documents, are compiled with their ids into an automaton that shares
suffixes; numbers on the transitions add up to a word's index, and the index points at its ids. The automaton is one
file that Spark brings to every executor, where tasks map it into memory. Words it lacks are merged exactly.
"""

from __future__ import annotations

import sys
import uuid
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltlane.llm.common import binary_array, distinct_slices, flat, pieces, worker_store
from voltlane.llm.tokens import Merges, Ragged, WordCache, encode_piece, gather, merges, ship_vocabulary, split_words
from voltlane.session import materialise, shared_path

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEXICON_WORDS, LONGEST_WORD = 50_000, 48
PARTS = ("keys", "target", "before", "final", "ids", "offsets")


class Lexicon:
    """A minimal acyclic automaton over word bytes whose transitions count the words before them.

    ``keys`` holds ``state << 8 | byte`` in order, with the state reached in ``target`` and, in ``before``, how many words
    of the origin state come before the transition; ``final`` marks the accepting states. The index that a path adds
    up to points into the ragged ``ids``.
    """

    def __init__(self, parts: dict[str, np.ndarray]):
        self.__dict__.update(parts)

    @classmethod
    def compile(cls, words: list[bytes], ids: np.ndarray, offsets: np.ndarray) -> Lexicon:
        """From distinct words in byte order and their ragged ids; equal suffix states are made one as they close."""
        register: dict[tuple, int] = {}
        finals, edges, sizes = [], [], []

        def close(node: list) -> int:
            signature = (node[0], tuple(node[1]))
            if signature not in register:
                register[signature] = len(finals)
                finals.append(node[0])
                edges.append(node[1])
                sizes.append(node[0] + sum(sizes[t] for _, t in node[1]))
            return register[signature]

        path, last = [[False, []]], b""
        for word in words:
            same = 0
            while same < min(len(word), len(last)) and word[same] == last[same]:
                same += 1
            while len(path) > same + 1:
                state = close(path.pop())
                path[-1][1].append((last[len(path) - 1], state))
            path += [[False, []] for _ in word[same:]]
            path[-1][0] = True
            last = word
        while len(path) > 1:
            state = close(path.pop())
            path[-1][1].append((last[len(path) - 1], state))
        root = close(path.pop())
        keys, target, before = [], [], []
        for state, out in enumerate(edges):
            passed = int(finals[state])
            for byte, to in out:
                keys.append(state << 8 | byte)
                target.append(to)
                before.append(passed)
                passed += sizes[to]
        return cls({
            "keys": np.array(keys, np.int64), "target": np.array(target, np.int32), "before": np.array(before, np.int32),
            "final": np.array([*finals, root], np.int32), "ids": np.asarray(ids, np.int32), "offsets": np.asarray(offsets, np.int32),
        })

    def dump(self) -> bytes:
        arrays = [np.ascontiguousarray(getattr(self, p)) for p in PARTS]
        head = np.array([a.nbytes for a in arrays], np.int64)
        return head.tobytes() + b"".join(a.tobytes() for a in arrays)

    @classmethod
    def map(cls, path: str) -> Lexicon:
        """The automaton in a file, mapped into memory."""
        whole = np.memmap(path, np.uint8, "r")
        sizes, at, parts = whole[: 8 * len(PARTS)].view(np.int64), 8 * len(PARTS), {}
        for name, n in zip(PARTS, sizes.tolist()):
            parts[name] = whole[at : at + n].view(np.int64 if name == "keys" else np.int32)
            at += n
        return cls(parts)

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Index of each word, or -1; all words take one step at a time."""
        found = np.full(len(starts), -1, np.int64)
        if not len(self.keys):
            return found
        rows = np.flatnonzero(ends - starts <= LONGEST_WORD)
        state, index, step = np.full(len(rows), self.final[-1], np.int64), np.zeros(len(rows), np.int64), 0
        while len(rows):
            done = starts[rows] + step == ends[rows]
            hit = done & (self.final[state] == 1)
            found[rows[hit]] = index[hit]
            rows, state, index = rows[~done], state[~done], index[~done]
            key = state << 8 | data[starts[rows] + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[at] == key
            rows, state, index = rows[ok], self.target[at[ok]].astype(np.int64), index[ok] + self.before[at[ok]]
            step += 1
        return found


def lexicon_words(lexicon: Lexicon, merge: Merges):
    """New words from the lexicon, and those it lacks by exact merging."""

    def run(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Ragged:
        index = lexicon.find(data, starts, ends)
        rest = np.flatnonzero(index < 0)
        ids, offsets = merge.encode(data, starts[rest], ends[rest])
        n = len(lexicon.offsets) - 1
        all_ids = np.concatenate([lexicon.ids, ids.astype(np.int32)])
        all_offsets = np.concatenate([lexicon.offsets.astype(np.int64), offsets[1:] + int(lexicon.offsets[-1])])
        index[rest] = n + np.arange(len(rest))
        return gather(all_ids, all_offsets, index)

    return run


def word_counts(docs: DataFrame, shipped) -> DataFrame:
    """``word, n`` for every word of the splitting pattern over all documents; each piece sends its distinct words once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            data, offsets = flat(piece.column(0))
            bounds, _ = split_words(data, offsets, shipped.value)
            if len(bounds) < 2:
                continue
            first, _, inverse = distinct_slices(data, bounds[:-1], bounds[1:])
            n = np.bincount(inverse, minlength=len(first))
            # no room for longer ones in a lexicon of frequent words
            short = np.flatnonzero(bounds[first + 1] - bounds[first] <= LONGEST_WORD)
            words, ends = gather(data, bounds, first[short])
            yield pa.RecordBatch.from_arrays([binary_array(words, ends), pa.array(n[short])], ["word", "n"])

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def compile_lexicon(docs: DataFrame, shipped, size: int = LEXICON_WORDS) -> str:
    """Compile the most frequent words, ``size`` at most, into a file for all executors; its name.

    The least count comes from the number of words of each count, so that no more than the lexicon reaches the driver;
    words of one count are taken all or none. Words that occur once are never frequent.
    """
    spark = docs.sparkSession
    counts = materialise(word_counts(docs, shipped).where("n > 1"), "words")
    steps = counts.groupBy("n").agg(F.count(F.lit(1)).alias("words"))  # one row per different count
    upto = F.sum("words").over(Window.orderBy(F.col("n").desc()))
    least = steps.withColumn("upto", upto).where(F.col("upto") <= size).agg(F.min("n")).first()[0]
    top = counts.where(F.col("n") >= least).select("word").collect() if least is not None else []  # ``size`` words at most
    specials = {s for s, _ in shipped.value.specials}
    words = sorted({bytes(r.word) for r in top} - specials)
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([0, *map(len, words)])
    blob = Lexicon.compile(words, *merges(shipped.value.raw).encode(data, ends[:-1], ends[1:])).dump()
    path = f"{shared_path(spark, 'lexicon')}/words-{uuid.uuid4().hex}.bin"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
    stream.write(blob)
    stream.close()
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def _task_encoder(shipped, name: str):
    """Encoder of the Python worker; the automaton and the words met so far stay from task to task."""
    store = worker_store("lexicon")
    if store.get("name") != name:
        store["run"] = lexicon_words(Lexicon.map(SparkFiles.get(name)), merges(shipped.value.raw))
        store["cache"], store["name"] = WordCache(shipped.value), name
    return store["run"], store["cache"]


def token_bytes(shipped) -> list[bytes]:
    """Text of every id; special tokens stand for themselves."""
    out = list(merges(shipped.value.raw).token_bytes)
    for content, number in shipped.value.specials:
        out += [b""] * (number + 1 - len(out))
        out[number] = content
    return out


def decode(ids: list[int], table: list[bytes]) -> bytes:
    """Text of a document's ids in UTF-8; bytes that are no UTF-8 become the replacement character."""
    return b"".join(map(table.__getitem__, ids)).decode("utf-8", "replace").encode()


def encode_documents(docs: DataFrame, *, tokenizer_path: str | None = None, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """``doc_id, ids``: each text's token ids. A null or empty text has none; repeated rows are encoded each."""
    shipped = ship_vocabulary(docs.sparkSession, tokenizer_path)
    name = compile_lexicon(docs, shipped, lexicon_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new_words, cache = _task_encoder(shipped, name)
        for piece in pieces(batches):
            ids, ends = encode_piece(*flat(piece.column(1)), new_words, cache)
            rows = pa.LargeListArray.from_arrays(pa.array(ends), pa.array(ids.astype(np.int32))).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([piece.column(0), rows], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def round_trip(docs: DataFrame, *, tokenizer_path: str | None = None, lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """Encode and decode every text: ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    A null or empty text has no tokens and decodes to the empty text; very long words are merged with a queue. Repeated
    rows give repeated results, other columns are ignored, an empty table gives no rows.
    """
    shipped = ship_vocabulary(docs.sparkSession, tokenizer_path)
    name = compile_lexicon(docs, shipped, lexicon_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new_words, cache = _task_encoder(shipped, name)
        table = token_bytes(shipped)
        decimal = [str(i) for i in range(len(table))]
        for piece in pieces(batches):
            ids, ends = encode_piece(*flat(piece.column(1)), new_words, cache)
            listed, cuts = ids.tolist(), ends.tolist()
            own = [listed[a:b] for a, b in zip(cuts, cuts[1:])]
            coded = [sha256(",".join(map(decimal.__getitem__, x)).encode()).hexdigest() for x in own]
            back = [sha256(decode(x, table)).hexdigest() for x in own]
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(np.diff(ends)), pa.array(coded, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
