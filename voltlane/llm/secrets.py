"""Secret scans: fixed patterns, and strings that zstandard finds novel where secrets are kept.

Candidates are all strings from a sensitive word to the end of the next line. For each one zstandard, primed with the
surrounding text and with a dictionary of the corpus's own identifiers and long words, tells how many bytes the string adds:
names, paths and repeated placeholders cost next to nothing, random material cannot be compressed and is reported. Words
that no dictionary holds cost something too, so strings without digits must add more than nearly all such words of the
corpus do. Dictionary and bounds are counted over all documents and have a fixed size, which is the most that is sent to
executors.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from hashlib import sha256
from itertools import accumulate

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltlane.session import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

DICTIONARY_BYTES, CONTEXT, LEAST_LENGTH, LEAST_RATE = 64 << 10, 200, 12, 0.6
#: share of plain words that may cost as much as a string of letters that is reported, and lengths from which bounds are told apart
PLAIN_SHARE, STEPS = 0.01, (12, 16, 24, 32)
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"(?ia:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: ``[0-9a-f]+`` of 32 and more: a run is never entered after its first character, since it is taken whole or dropped whole
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: words beside which secrets are kept; matched anywhere, in either case
SENSITIVE_WORDS = (
    "password", "passwd", "passphrase", "secret", "token", "apikey", "api_key", "credential", "private_key", "privatekey",
    "access_key", "accesskey", "authorization", "bearer", "signature",
)
SENSITIVE = re.compile("(?ia)" + "|".join(SENSITIVE_WORDS))
RUN = re.compile(r"[A-Za-z0-9+/_=.~-]+")
PLAIN = re.compile(r"(?<![A-Za-z0-9+/_=.~-])[A-Za-z]{12,64}(?![A-Za-z0-9+/_=~-])")
IDENTIFIER = re.compile(r"(?a)[A-Za-z_][A-Za-z0-9_]{2,63}(?=[\"']?\x20*[:=(])")


def fixed_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans of the fixed patterns as start, kind (its number), end; those that fail their length are dropped."""
    found, lower = [], text.lower()
    if any(w in lower for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


class Novelty:
    """Marginal compressed size with a primed dictionary."""

    def __init__(self, dictionary: bytes, level: int = 3):
        import zstandard

        raw = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(dictionary) >= 8 else None
        params = zstandard.ZstdCompressionParameters.from_level(level, write_content_size=0, write_checksum=0, write_dict_id=0)
        if raw:
            raw.precompute_compress(compression_params=params)
        self.compressor = zstandard.ZstdCompressor(compression_params=params, dict_data=raw) if raw else zstandard.ZstdCompressor(compression_params=params)

    def size(self, payload: bytes) -> int:
        return len(self.compressor.compress(payload))

    def added(self, around: str, string: str) -> int:
        """Bytes that the string adds to the compressed text around it."""
        context = around.encode()
        return self.size(context + string.encode()) - self.size(context)


def candidates(text: str) -> list[tuple[int, int]]:
    """Runs of secret-like characters that begin after a sensitive word, to the end of the next line, each once."""
    lower = text.lower()
    if not any(w in lower for w in SENSITIVE_WORDS):
        return []
    found, line, upto = [], -1, 0
    for word in SENSITIVE.finditer(text):
        if word.end() > line:
            line = text.find("\n", word.end())
            line = len(text) if line < 0 else line
            stop = text.find("\n", line + 1)
            stop = len(text) if stop < 0 else stop
        for run in RUN.finditer(text, max(upto, word.end()), stop):
            a, b = run.span()
            a += b - a - len(run.group().lstrip("=.-"))
            if b - a >= LEAST_LENGTH:
                found.append((a, b))
        upto = max(upto, stop)
    return found


def step(length: int) -> int:
    """The number of the length's class."""
    return max(0, bisect_right(STEPS, length) - 1)


def novel_spans(text: str, novelty: Novelty, least_rate: float = LEAST_RATE, plain_rates: tuple[float, ...] = ()) -> list[tuple[int, int]]:
    """Candidates that add at least ``least_rate`` bytes per character, those without digits ``plain_rates`` (by length) as well."""
    out = []
    for a, b in candidates(text):
        string = text[a:b]
        rate = max(least_rate, plain_rates[step(b - a)]) if plain_rates and not any(c.isdigit() for c in string) else least_rate
        around = text[max(0, a - CONTEXT) : a] + text[b : b + CONTEXT]
        if novelty.added(around, string) >= rate * len(string):
            out.append((a, b))
    return out


def name_counts(docs: DataFrame) -> DataFrame:
    """``name, plain, n``: names before ``=``, ``:`` or ``(``, and plain words of 12 letters and more, over all documents.

    They are put together per batch before the shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for text in batch.column(0):
                value = text.as_py()
                if value and ("=" in value or ":" in value or "(" in value):
                    counts.update((name, False) for name in IDENTIFIER.findall(value))
                if value:
                    counts.update((word, True) for word in PLAIN.findall(value))
            names, plain = [k for k, _ in counts], [p for _, p in counts]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(plain, pa.bool_()), pa.array(list(counts.values()), pa.int64())], ["name", "plain", "n"])

    return docs.select("text").mapInArrow(run, "name string, plain boolean, n long").groupBy("name", "plain").agg(F.sum("n").alias("n"))


def _commonest(counts: DataFrame, rows: int) -> list:
    """The first rows by count. A histogram of the counts tells from where on they lie, so tasks send little more than these."""
    level = F.floor(8 * F.log2("n"))
    left, cut = rows, 0
    for found in sorted(counts.groupBy(level.alias("level")).count().collect(), reverse=True):  # some hundred rows
        left, cut = left - found["count"], found["level"]
        if left <= 0:
            break
    return counts.where(level >= cut).orderBy(F.col("n").desc(), "name").limit(rows).collect()


def identifier_dictionary(counts: DataFrame, size: int = DICTIONARY_BYTES, least: int = 2) -> bytes:
    """The most frequent identifiers and, in the room they leave, plain words, the commonest last (nearest to the text)."""
    names, used = [], 0
    for plain, room, shortest in ((False, size // 2, 3), (True, size, LEAST_LENGTH)):
        # so many rows always fill the room
        for row in _commonest(counts.where((F.col("n") >= least) & (F.col("plain") == plain)), room // (shortest + 1) + 1):
            if used + len(row.name) + 1 > room:
                break
            used += len(row.name) + 1
            names.append(row.name)
    return "\n".join(reversed(names)).encode()


def plain_word_rates(docs: DataFrame, dictionary: bytes, share: float = PLAIN_SHARE) -> tuple[float, ...]:
    """Per class of lengths, the bytes per character that at most ``share`` of the plain words outside the dictionary add.

    Every such word of every text is measured in its place, but for candidates; counts by class and hundredth are collected, some hundred rows at any size.
    """
    known = set(dictionary.decode().split("\n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(dictionary)
        for batch in batches:
            found: Counter = Counter()
            for value in batch.column(0):
                text = value.as_py() or ""
                own = set(candidates(text))
                for m in PLAIN.finditer(text):
                    if m.group() not in known and m.span() not in own:
                        a, b = m.span()
                        rate = novelty.added(text[max(0, a - CONTEXT) : a] + text[b : b + CONTEXT], m.group()) / (b - a)
                        found[step(b - a), int(100 * rate) + 1] += 1
            keys = list(zip(*found)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(keys[0], pa.int32()), pa.array(keys[1], pa.int32()), pa.array(list(found.values()), pa.int64())], ["step", "rate", "n"])

    rates = docs.select("text").mapInArrow(run, "step int, rate int, n long").groupBy("step", "rate").agg(F.sum("n").alias("n")).collect()
    out = []
    for number in range(len(STEPS)):
        rows = sorted(((r.rate, r.n) for r in rates if r.step == number), reverse=True)
        left, bound = share * sum(n for _, n in rows), 0.0
        for rate, n in rows:
            left -= n
            if left < 0:
                bound = rate / 100
                break
        out.append(bound)
    return tuple(out)


def secret_spans(
    docs: DataFrame, *, dictionary_bytes: int = DICTIONARY_BYTES, least_rate: float = LEAST_RATE, plain_share: float = PLAIN_SHARE,
) -> DataFrame:
    """One row per document: ``doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_novel``.

    Spans are ``kind:start:end`` in code points, by start and then kind; novel ones (kind ``novel``) come after fixed ones
    of the same start, and are given only where no fixed span covers them. A null or empty text has none; repeated
    rows give repeated results; other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    counts = materialise(name_counts(docs), "names")
    dictionary = identifier_dictionary(counts, dictionary_bytes)
    rates = plain_word_rates(docs, dictionary, plain_share)
    shipped = spark.sparkContext.broadcast(dictionary)  # ``dictionary_bytes`` at most
    columns = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(shipped.value)
        for batch in batches:
            out = []
            for value in batch.column(1):
                text = value.as_py() or ""
                fixed = fixed_spans(text)
                begins, reach = [s for s, _, _ in fixed], list(accumulate((e for _, _, e in fixed), max))
                more = []
                for a, b in novel_spans(text, novelty, least_rate, rates):
                    at = bisect_right(begins, a)
                    if not at or reach[at - 1] < b:
                        more.append((a, 3, b))
                said = [f"{KINDS[k]}:{a}:{b}" for a, k, b in fixed]
                both = [f"{(*KINDS, 'novel')[k]}:{a}:{b}" for a, k, b in sorted(fixed + more)]
                n = Counter(k for _, k, _ in fixed)
                out.append((n[0], n[1], n[2], sha256(",".join(said).encode()).hexdigest(), ",".join(both), len(more)))
            parts = list(zip(*out)) or [()] * 6
            types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(p, t) for p, t in zip(parts, types)]], columns)

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long"
    return docs.select("doc_id", "text").mapInArrow(run, schema)
