"""Personal data: fixed patterns, and identifiers that bootstrapped contexts find.

The entities of the fixed patterns are seeds. The words around them are lexical patterns; Spark scores the graph of
patterns and instances in turns: a pattern is as good as the share of its instances that are known, an instance as
good as its patterns together. Identifier-like strings that patterns of high confidence surround are reported too. The
graph holds only strings with four digits or an ``@``, numbers written with blanks as one, and its shuffles are counts put together before they are sent.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltlane.session import materialise

cloudpickle.register_pickle_by_value(sys.modules[__name__])

KINDS = ("email", "ip", "card", "phone")
ROUNDS, LEAST_SUPPORT, LEAST_CONFIDENCE = 3, 3, 0.8
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
#: possessive forms find the same as plain ones here, in linear time: a digit can't be what a group's end waits for
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
HINT = re.compile(r"[0-9@]")
GAP = re.compile(r"[\x20\x09-\x0D]")
STRIP = ".,;:!?()[]{}<>\"'"
#: a word of a number that is written with blanks, marks before its first and after its last word, and the length from which names are digests
PART, OPENS, ENDS, LONG = re.compile(r"[().+-]*[0-9](?:[0-9().+-]*[0-9)])?"), "\"'[{<", ",;:!?.\"']}>", 128
ITEM = "struct<start:int,end:int,instance:string,kind:int,digits:int,dots:int,at:boolean,patterns:array<string>>"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def email_spans(text: str) -> list[tuple[int, int]]:
    """Leftmost matches found from each ``@``: the name is the run of allowed characters before it, after the last match."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        name = text[done:at]
        start = done + len(name.rstrip(LOCAL))
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, domain.end()))
        done = domain.end() if domain else at + 1
        at = text.find("@", done)
    return found


def fixed_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans of the fixed patterns as kind (its number), start, end, by kind and start."""
    found = [(0, a, b) for a, b in email_spans(text)]
    if not HINT.search(text):
        return found
    if "." in text:
        found += [(1, *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p[-3:]) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append((2, *m.span()))
    if "+" in text:
        found += [(3, *m.span()) for m in PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m.group())) <= 15]
    return found


def _word(text: str, at: int, least: int) -> tuple[int, int]:
    """The word around a place, not before ``least``."""
    left = at
    while left > least and not GAP.match(text[left - 1]):
        left -= 1
    right = GAP.search(text, at)
    return left, right.start() if right else len(text)


def identifier_like(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Words with an ``@``, and runs of words with at least four digits in all, that overlap no taken span.

    Words of digits, brackets, dots and hyphens with one blank between them are one run, as in ``(555) 123 4567``; a mark such
    as a comma ends it. Marks around a span do not belong to it, but for a bracket that closes within.
    """
    taken, out, at, i = sorted(taken), [], 0, 0

    def free(left: int, right: int) -> bool:
        nonlocal i
        while i < len(taken) and taken[i][1] <= left:
            i += 1
        return i == len(taken) or taken[i][0] >= right

    while m := HINT.search(text, at):
        left, right = _word(text, m.start(), at)
        at = right
        if not free(left, right):
            continue
        n, mail, last = _digits(text[left:right]), "@" in text[left:right], left
        while text[right : right + 1] == "\x20" and PART.fullmatch(text[last:right].lstrip(OPENS)):
            end = GAP.search(text, right + 1)
            end = end.start() if end else len(text)
            if not PART.fullmatch(text[right + 1 : end].rstrip(ENDS)) or not free(right + 1, end):
                break
            n, last, right = n + _digits(text[right + 1 : end]), right + 1, end
        at = right
        word = text[left:right]
        if mail or n >= 4:
            start, end = left + len(word) - len(word.lstrip(STRIP)), left + len(word.rstrip(STRIP))
            bracket = start > left and text[start - 1] == "(" and ")" in text[start:end]
            out.append((start - bracket, end))
    return out


def _digits(word: str) -> int:
    return sum(c in "0123456789" for c in word)


def _shape(word: str) -> str:
    """Digits count as one; a very long word is named by its digest."""
    shape = re.sub("[0-9]", "0", word.lower())
    return shape if len(shape) <= LONG else sha256(shape.encode()).hexdigest()


def _words_before(text: str, at: int, n: int, reach: int = 100) -> list[str]:
    """The last ``n`` words before a place, whole however long."""
    while True:
        low = max(0, at - reach)
        words = [w for w in GAP.split(text[low:at])[low > 0 :] if w.strip("\"'([{")]
        if len(words) >= n or not low:
            return words[-n:]
        reach *= 4


def _words_after(text: str, at: int, n: int, reach: int = 100) -> list[str]:
    """The first ``n`` words after a place, whole however long."""
    while True:
        high = min(len(text), at + reach)
        parts = GAP.split(text[at:high])
        words = [w for w in (parts[:-1] if high < len(text) else parts) if w.strip(STRIP)]
        if len(words) >= n or high == len(text):
            return words[:n]
        reach *= 4


def contexts(text: str, start: int, end: int) -> list[str]:
    """The patterns of a span: its two words before, and its word before with the one after."""
    left = [_shape(w) for w in _words_before(text, start, 2)]
    left = ["^"] * (2 - len(left)) + left
    after = _words_after(text, end, 1)
    return [f"L {left[0]} {left[1]}", f"R {left[1]} _ {_shape(after[0]) if after else '$'}"]


def _item(text: str, kind: int, start: int, end: int) -> dict:
    """A node of the graph; a very long instance is named by its digest, and what kinds ask for is counted here."""
    word = text[start:end].lower()
    return {
        "start": start, "end": end, "instance": word if len(word) <= LONG else sha256(word.encode()).hexdigest(), "kind": kind,
        "digits": _digits(word), "dots": word.count("."), "at": "@" in word, "patterns": contexts(text, start, end),
    }


def scan(docs: DataFrame) -> DataFrame:
    """One row per document with its fixed spans, and the instances with their patterns; no text goes on."""
    schema = f"row long, doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base string, base_sha256 string, items array<{ITEM}>"
    names = ["row", "doc_id", *[f"n_{k}" for k in KINDS], "base", "base_sha256", "items"]
    whole = [(name, pa.int32()) for name in ("kind", "digits", "dots")]
    item = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("instance", pa.string()), *whole, ("at", pa.bool_()), ("patterns", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(2):
                text = value.as_py() or ""
                found = fixed_spans(text)
                spans = [(a, b) for _, a, b in found]
                said = ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in found)
                n = Counter(k for k, _, _ in found)
                each = [(k, a, b) for k, a, b in found] + [(-1, a, b) for a, b in identifier_like(text, spans)]
                items = [_item(text, k, a, b) for k, a, b in each]
                rows.append((n[0], n[1], n[2], n[3], said, sha256(said.encode()).hexdigest(), items))
            parts = list(zip(*rows)) or [()] * 7
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.list_(item)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(p, t) for p, t in zip(parts, types)]], names)

    return docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(run, schema)


def confident_patterns(items: DataFrame, *, rounds: int = ROUNDS, least_support: int = LEAST_SUPPORT, least_confidence: float = LEAST_CONFIDENCE) -> DataFrame:
    """``pattern, kind, confidence`` after scoring the graph of ``instance, kind, patterns`` rows (kind -1: not a seed).

    A pattern needs ``least_support`` different known instances of one kind; its confidence is the sum of their scores
    over all its instances. A new instance scores one minus the product of what its patterns leave open.
    """
    edges = items.select("instance", "kind", F.explode(F.array_distinct("patterns")).alias("pattern"))
    edges = edges.groupBy("pattern", "instance").agg(F.max("kind").alias("kind"))
    sizes = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("kind") >= 0, 1)).alias("seeds"))
    # patterns with fewer instances can't reach the support, without any seed they can't start
    edges = materialise(edges.join(sizes.where((F.col("n") >= least_support)), "pattern"), "edges")
    known = edges.where("kind >= 0").select("instance", "kind", F.lit(1.0).alias("score")).distinct()
    out = None
    for _ in range(rounds):
        score = edges.drop("kind").join(known, "instance").groupBy("pattern", "kind").agg(
            (F.sum("score") / F.first("n")).alias("confidence"), F.count(F.lit(1)).alias("support"),
        )
        out = materialise(score.where((F.col("support") >= least_support) & (F.col("confidence") >= least_confidence)).drop("support"), "patterns")
        new = edges.where("kind < 0").drop("kind").join(out, "pattern").groupBy("instance", "kind").agg(
            (1 - F.exp(F.sum(F.log(1.0001 - F.col("confidence"))))).alias("score")
        )
        seeds = edges.where("kind >= 0").select("instance", "kind", F.lit(1.0).alias("score")).distinct()
        known = materialise(seeds.unionByName(new), "known")
    return out


def personal_spans(docs: DataFrame, *, rounds: int = ROUNDS, least_support: int = LEAST_SUPPORT, least_confidence: float = LEAST_CONFIDENCE) -> DataFrame:
    """One row per document: ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found``.

    Fixed spans are ``kind:start:end`` in code points; those that contexts find follow them as ``found_kind:start:end``. Found cards
    have 12 to 19 digits, found phones 7 to 15, so lists of numbers with blanks only between them are neither. A null
    or empty text has none; repeated rows give repeated results, other columns are ignored, an empty table gives no rows.
    """
    scanned = materialise(scan(docs), "scanned")
    items = scanned.select("row", F.inline("items"))
    patterns = confident_patterns(items, rounds=rounds, least_support=least_support, least_confidence=least_confidence)
    open_items = items.where("kind < 0").select("row", "start", "end", "digits", "dots", "at", F.explode(F.array_distinct("patterns")).alias("pattern"))
    digits, dots, at = F.col("digits"), F.col("dots"), F.col("at")
    suited = F.element_at(F.array(at, (dots >= 3) & (digits >= 4), digits.between(12, 19), digits.between(7, 15) & ~at), F.col("kind") + 1)
    best = open_items.join(patterns, "pattern").where(suited).groupBy("row", "start", "end").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind"))
    names = F.array(*[F.lit(f"found_{k}") for k in KINDS])
    found = best.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias("found"))  # of one document
    said = F.transform("found", lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"]))
    joined = scanned.drop("items").join(found.select("row", F.array_join(said, ",").alias("more"), F.size("found").cast("long").alias("n_found")), "row", "left")
    spans = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), "more")
    return joined.select("doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", spans.alias("spans"), F.coalesce("n_found", F.lit(0)).cast("long").alias("n_found"))
