"""Every dealt operator against a brute-force version, on the smallest table and on awkward rows."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import ESROM, MORSE
from voltlane.llm import bpe, common, exact, mixing, near, packing, pii, quality, repeats, rollups, secrets, tokens
from voltlane.llm.tokens import public_vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(payload: bytes) -> str:
    return hashlib.sha256(payload).hexdigest()


def key(row):
    return tuple((x is not None, x if x is not None else 0) for x in row)


def equal(frame, columns, want):
    got = sorted((tuple(r) for r in frame.select(*columns).collect()), key=key)
    assert got == sorted(want, key=key)


@pytest.mark.parametrize("run", [
    quality.quality_measures, quality.keep_quality, near.near_groups, near.keep_one, repeats.removal_digests, repeats.repeated_spans, repeats.maximal_repeats,
    pii.personal_spans, exact.exact_groups, exact.keep_exact, mixing.mix_sources, mixing.mixed_rows, rollups.maintained_totals,
    bpe.round_trip, bpe.encode_documents, secrets.secret_spans, packing.write_and_read,
], ids=lambda f: f.__name__)
def test_empty_table_gives_no_rows(run, nothing):
    assert run(nothing).collect() == []


def repeats_of(words, least):
    """Longest repeat that starts at each word, by comparing all pairs of places with equal first words."""
    places, out = defaultdict(list), [0] * len(words)
    for i in range(len(words) - least + 1):
        places[tuple(words[i : i + least])].append(i)
    for group in places.values():
        for x, i in enumerate(group):
            for j in group[x + 1 :]:
                n = least
                while j + n < len(words) and words[i + n] == words[j + n]:
                    n += 1
                out[i], out[j] = max(out[i], n), max(out[j], n)
    return out


def test_quality_measures(both):
    for frame, rows in both:
        want = []
        for i, text, *_ in rows:
            words = WORD.findall(text or "")
            windows = Counter(zip(words, words[1:], words[2:]))
            marked = {j + k for j, g in enumerate(zip(words, words[1:], words[2:])) if windows[g] > 1 for k in range(3)}
            lines, seen = 0, set()
            for line in (text or "").split("\n"):
                lines += bool(WORD.search(line)) and line in seen
                seen.add(line)
            failed = len(words) < 50 or 100 * len(marked) > 50 * len(words)
            want.append((i, len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), lines, len(marked), failed))
        equal(quality.quality_measures(frame), ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"], want)


def test_quality_repeats_cover_and_limit(table, rows):
    got = {r.doc_id: r for r in quality.quality_measures(table, min_repeat_words=3, max_covered=0.1, max_longest=9).collect()}
    for i, text, *_ in rows:
        words = WORD.findall(text)
        if len(words) > 3000:
            continue
        found = repeats_of(words, 3)
        covered = {i + k for i, n in enumerate(found) for k in range(n)}
        assert (got[i].n_covered_words, got[i].longest_repeat) == (len(covered), max(found, default=0))
        assert got[i].kept == (not got[i].base_failed and len(covered) <= 0.1 * len(words) and max(found, default=0) <= 9)


def test_long_repeats_inside_a_document():
    words = [f"w{i % 700}" for i in range(5000)]
    found = quality.measure(np.frombuffer(" ".join(words).encode(), np.uint8), np.array([0, len(" ".join(words))]))
    assert (found["longest_repeat"][0], found["n_covered_words"][0]) == (4300, 5000)


def test_memory_for_one_long_repetitive_text():
    """Memory follows the text, not the length of its repeats."""
    import tracemalloc

    half = " ".join(f"w{i}" for i in range(120_000))
    text = np.frombuffer(f"{half} {half}".encode(), np.uint8)
    tracemalloc.start()
    found = quality.measure(text, np.array([0, len(text)]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found["longest_repeat"][0] == 120_000 and peak < 80 * len(text)


def test_common_prefixes_equal_a_scan():
    rng = np.random.default_rng(8)
    tokens = rng.integers(0, 2**63, 3, dtype=np.uint64)[rng.integers(0, 3, 4000)]
    tokens[2000:2900] = tokens[500:1400]
    a, b = rng.integers(0, 4000, 500), rng.integers(0, 4000, 500)
    a[:5], b[:5] = [500, 501, 0, 3999, 1399], [2000, 2001, 3999, 0, 2899]
    keep = a != b
    a, b = a[keep], b[keep]
    for least in (1, 3):
        want = []
        for x, y in zip(a, b):
            n = 0
            while max(x, y) + n < 4000 and tokens[x + n] == tokens[y + n]:
                n += 1
            want.append(n if n >= least else 0)
        assert quality.common_prefixes(tokens, a, b, least).tolist() == want


def test_slices_are_told_apart_by_their_bytes(monkeypatch):
    word, other = (np.frombuffer(w.encode(), np.uint8) for w in (MORSE, ESROM))
    data, cuts = np.concatenate([word, other, word]), np.array([0, 1024, 2048, 3072])
    for which in range(3):
        a, b, c = common.slice_hash(common.prefix_hash(data, which), cuts[:-1], cuts[1:], which)
        assert a == c != b
    real, seen = common.slice_hash, []

    def broken(prefix, starts, ends, which=0):  # every hash is the same with the first base
        seen.append(which)
        return real(prefix, starts, ends, which) * np.uint64(which > 0)

    monkeypatch.setattr(common, "slice_hash", broken)
    first, _, inverse = common.distinct_slices(data, cuts[:-1], cuts[1:])
    assert seen == [0, 1] and len(first) == 2 and inverse[0] == inverse[2] != inverse[1]


def test_cached_words_are_compared_by_their_bytes(monkeypatch):
    """Words whose hashes agree are encoded each for itself, in one piece and across pieces."""
    monkeypatch.setattr("voltlane.llm.tokens.slice_hash", lambda prefix, starts, ends, which=0: np.full(len(starts), 7, np.uint64))
    vocabulary = tokens.vocabulary()
    vocabulary.specials = []
    cache = tokens.WordCache(vocabulary)
    key, ends = np.array([7], np.uint64), np.array([3])
    cache.add(key, np.array([1, 2]), np.array([0, 2]), np.frombuffer(b"abc", np.uint8), np.array([0]), ends)
    assert cache.find(key, np.frombuffer(b"abc", np.uint8), np.array([0]), ends) == [0]
    assert cache.find(key, np.frombuffer(b"abd", np.uint8), np.array([0]), ends) == [-1] and not len(cache.keys)


def test_keep_quality_keeps_rows_whole(odd):
    kept = quality.keep_quality(odd)
    assert kept.schema == odd.schema
    ids = {r.doc_id for r in quality.quality_measures(odd).where("kept").collect()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in odd.collect() if r.doc_id in ids)


def shingled(text):
    words = WORD.findall(text or "")
    return Counter(tuple(words[j : j + 5]) for j in range(max(1, len(words) - 4))) if words else Counter()


def near_truth(rows):
    sets = {i: shingled(t) for i, t, *_ in rows if i is not None}
    where, parent = defaultdict(list), {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, c in sets.items():
        for g in c:
            where[g].append(i)
    for a, b in {(x, y) for ids in where.values() for x in ids for y in ids if x < y}:
        common, union = sum((sets[a] & sets[b]).values()), sum((sets[a] | sets[b]).values())
        if common >= 0.8 * union:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: find(i) for i in sets}


def test_near_groups(both):
    for frame, rows in both:
        truth = near_truth(rows)
        sizes = Counter(truth[i] for i, *_ in rows if i is not None)
        want = [(i, truth[i], sizes[truth[i]], truth[i] == i) if i is not None else (None, None, 1, True) for i, *_ in rows]
        equal(near.near_groups(frame), ["doc_id", "group_id", "group_size", "kept"], want)


def test_near_groups_in_large_buckets(spark):
    rng = np.random.default_rng(3)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(120):  # one large group, and texts that share a third with it only
        words = list(base)
        if i % 3:
            words[int(rng.integers(60))] = f"x{i}"
        else:
            words[20:] = [f"y{i}.{k}" for k in range(40)]
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(base[:20] + [f"z{i // 2}.{k}" for k in range(40)]) + (" end" if i % 2 else "")) for i in range(60)]
    truth = near_truth(rows)
    got = near.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), small=3)
    equal(got, ["doc_id", "group_id"], [(i, truth[i]) for i, _ in rows])


def variants(pairs):
    """Pairs of texts at 0.81 within a pair and 0.78 across, all with one long passage."""
    core = " ".join(f"c{i}" for i in range(104))
    return [(i, f"{core} " + " ".join([f"p{i // 2}.{k}" for k in range(2)] + [f"q{i}.{k}" for k in range(12)])) for i in range(2 * pairs)]


def test_near_groups_finds_partners_among_many_variants(spark):
    rows = variants(150)
    truth = near_truth(rows)
    assert len(set(truth.values())) == 150
    got = near.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), small=3)
    equal(got, ["doc_id", "group_id"], [(i, truth[i]) for i, _ in rows])


def test_near_groups_in_many_blocks(spark, monkeypatch):
    for name in ("SPLIT", "BLOCK_ROWS"):
        monkeypatch.setattr(near, name, 20, raising=False)
    rows = variants(60)
    got = near.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), small=3)
    equal(got, ["doc_id", "group_id"], [(i, i - i % 2) for i, _ in rows])


def test_near_groups_with_common_bands_far_apart(spark, monkeypatch):
    plain = near.signature_bands

    def spread(docs, **settings):  # all texts agree on the first and the eleventh band, on no other
        key = lambda j: F.when(F.lit(j % 10 == 0), F.lit(j)).otherwise(F.xxhash64("doc_id", F.lit(j)))
        return plain(docs, **settings).withColumn("bands", F.array(*[key(j) for j in range(20)]))

    monkeypatch.setattr(near, "signature_bands", spread)
    rows = [(i, " ".join(f"w{i}.{k}" for k in range(40))) for i in range(6)]
    rows += [(10 + i, " ".join(f"w{k}" for k in range(60)) + f" end{i}") for i in range(2)]
    got = near.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), small=3)
    equal(got, ["doc_id", "group_id"], [(i, min(i, 10)) for i, _ in rows])


def test_dart_signatures_estimate_the_weighted_similarity():
    rng = np.random.default_rng(1)
    element, k = np.arange(300, dtype=np.uint64), 4096
    a, b = rng.integers(1, 6, 300), rng.integers(1, 6, 300)
    doc = np.repeat([0, 1], 300)
    values = near.dart_signatures(doc, np.concatenate([element, element]), np.concatenate([a, b]), 2, k)
    assert (values != 0).all()
    truth = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((values[0] == values[1]).mean() - truth) < 4 * np.sqrt(truth * (1 - truth) / k)


def removal_truth(rows, length=50):
    first = {}
    order = lambda i: -1 if i is None else i
    for i, text, *_ in rows:
        data = (text or "").encode()
        for j in range(len(data) - length + 1):
            s = data[j : j + length]
            first[s] = min(first.get(s, 10**18), order(i))
    for i, text, *_ in rows:
        data = (text or "").encode()
        covered = np.zeros(len(data), bool)
        for j in range(len(data) - length + 1):
            if first[data[j : j + length]] < order(i):
                covered[j : j + length] = True
        yield i, data, covered


@pytest.mark.parametrize("settings", [{}, {"group_bytes": 50_000, "shard_bytes": 50_000, "hot": 2}, {"length": 100}], ids=["plain", "split", "longer"])
def test_removed_repeats(both, settings):
    for frame, rows in both:
        want = []
        for i, data, covered in removal_truth(rows, settings.get("length", 50)):
            n = int(covered[:1].sum() + (covered[1:] & ~covered[:-1]).sum()) if len(data) else 0
            want.append((i, len(data), int(covered.sum()), n, sha(bytes(np.frombuffer(data, np.uint8)[~covered]))))
        equal(repeats.removal_digests(frame, **settings), ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], want)


def test_repeated_spans_hold_the_removed_text(table, rows):
    want = []
    for i, data, covered in removal_truth(rows):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.astype(int), [0]])))
        want += [(i, int(a), int(b), bytearray(data[a:b])) for a, b in edges.reshape(-1, 2)]
    equal(repeats.repeated_spans(table), ["doc_id", "start", "end", "passage"], want)


@pytest.mark.parametrize("settings", [{}, {"group_bytes": 50_000, "shard_bytes": 50_000}], ids=["plain", "split"])
def test_maximal_repeats_have_all_occurrences(table, rows, settings):
    texts = {i: (t or "").encode() for i, t, *_ in rows}
    where = defaultdict(set)
    for i, data in texts.items():
        for j in range(len(data) - 49):
            where[data[j : j + 50]].add((i, j))
    want = {(i, j + k) for spots in where.values() if len({i for i, _ in spots}) > 1 for i, j in spots for k in range(50)}
    groups, got = defaultdict(set), set()
    for r in repeats.maximal_repeats(table, **settings).collect():
        groups[(r.repeat, r.n_docs)].add((texts[r.doc_id][r.start : r.start + r.length], r.doc_id, r.start))
        got |= {(r.doc_id, r.start + k) for k in range(r.length)}
    assert got == want
    for (_, n), spots in groups.items():
        assert len({text for text, *_ in spots}) == 1 and len({i for _, i, _ in spots}) == n
        # the group has each place where its first 50 bytes go on in the same way
        text = next(iter(spots))[0]
        if max(Counter(i for i, _ in where[text[:50]]).values()) > 1:
            continue  # periodic
        assert {(i, j) for i, j in where[text[:50]] if texts[i][j : j + len(text)] == text} == {(i, j) for _, i, j in spots}


def test_shards_leave_out_places_inside_a_shared_passage():
    """A passage that two stretches share says all at its first byte; the places after it need no interval tree."""
    rng = np.random.default_rng(1)
    shared, tails = rng.integers(0, 256, 70, np.uint8), rng.integers(0, 256, (2, 10), np.uint8)
    tails[1, 0] = tails[0, 0] ^ 1
    lead = np.array([[1], [2]], np.uint8)
    data = np.concatenate([lead[0], shared, tails[0], lead[1], shared, tails[1]])
    shard = repeats.Shard(data, np.array([81, 81], np.uint16), np.array([3, 7]), 50)
    which = shard.which.tolist()
    assert len(list(shard.repeats())) == 1
    assert shard.covered_heads() == [(which[1], 1, 71)]


def test_rolling_hash_equals_its_polynomial():
    data = np.random.default_rng(2).integers(0, 256, 100_000, np.uint8)
    for size in (1, 7, 24, 40):
        got, base, whole = common.rolling_hash(data, size), 0x9E3779B97F4A7C15, (1 << 64) - 1
        assert len(got) == len(data) - size + 1
        for at in (0, 1, 32_767, 32_768, len(got) - 1):
            value = sum((int(x) + 1) * pow(base, j, 1 << 64) for j, x in enumerate(data[at : at + size])) & whole
            assert got[at] == common.mix(np.array([value], np.uint64))[0]
    assert not len(common.rolling_hash(data[:23], 24))


def test_interval_tree():
    text = "mississippi"
    suffixes = sorted(range(len(text)), key=lambda i: text[i:])
    lcp = [next(k for k in range(99) if text[i + k : i + k + 1] != text[j + k : j + k + 1] or i + k >= len(text) or j + k >= len(text)) for i, j in zip(suffixes, suffixes[1:])]
    tree = repeats.interval_tree(lcp)
    named = {text[suffixes[a] : suffixes[a] + n]: (b - a + 1, None if p < 0 else tree[p][2]) for a, b, n, p in tree}
    assert named == {"i": (4, None), "issi": (2, 1), "p": (2, None), "s": (4, None), "si": (2, 1), "ssi": (2, 1)}


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def personal_truth(text):
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(d := re.sub("[^0-9]", "", s)) <= 19 and luhn(d)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15),
    )
    return [(k, *m.span()) for k, p, ok in kinds for m in re.finditer(p, text) if ok(m.group())]


def test_personal_data(both):
    for frame, rows in both:
        want = []
        for i, text, *_ in rows:
            spans = personal_truth((text or "").replace("a" * 30_000, "a" * 100))  # the plain pattern takes a minute on it
            n = Counter(k for k, *_ in spans)
            said = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
            want.append((i, n["email"], n["ip"], n["card"], n["phone"], sha(said.encode())))
        found = pii.personal_spans(frame)
        equal(found, ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256"], want)
        for r in found.collect():
            base = [s for s in r.spans.split(",") if s and not s.startswith("found_")]
            assert sha(",".join(base).encode()) == r.base_sha256 and r.spans.startswith(",".join(base))


def test_contexts_discover_identifiers(spark):
    known = [(i, f"note {i} please charge card 4{i:02d}1 to the order") for i in range(4)]
    cards = ["4111111111111111", "5500005555555559", "340000000000009", "6011000990139424"]
    rows = [(i, f"w{i} please charge card number {c} to it") for i, c in enumerate(cards)]
    rows += [(10, "w please charge card number 4111111111111112 to it"), (11, "other words stand before 4111111111111112 here"), (12, "year 20242025")] + known[:0]
    got = {r.doc_id: (r.n_found, r.spans) for r in pii.personal_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[10] == (1, "found_card:28:44")
    # found once, the number is an instance but its other context has no support
    assert got[11][0] == 0 and got[12][0] == 0


def test_numbers_with_blanks_are_one_instance(spark):
    cards = ["4111111111111111", "5500005555555559", "340000000000009", "6011000990139424"]
    phones = [f"+44 20 7946 09{i:02d}" for i in range(14)]  # four fifths of all numbers in this place are known
    rows = [(i, f"w{i} please charge card number {c} to it") for i, c in enumerate(cards)]
    rows += [(20 + i, f"w{i} call me at {p} at night") for i, p in enumerate(phones)]
    rows += [
        (10, "w please charge card number 4111 1111 1111 1112 to it"), (11, "call me at (555) 123 4567, or not"),
        (12, "call me at 555 123 4567 or 1 2 3"), (13, "call me at 5 6 7, in 2024"), (14, "call me at " + "12 34 " * 5_000),
    ]
    got = {r.doc_id: r.spans for r in pii.personal_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [got[i] for i in range(10, 15)] == ["found_card:28:47", "found_phone:11:25", "found_phone:11:23", "", ""]


def test_instances_and_contexts_are_whole():
    def plain(text, taken):
        words, out, at = [m.span() for m in WORD.finditer(text)], [], 0
        clear = lambda a, b: all(y <= a or x >= b for x, y in taken)
        number = lambda w: bool(re.fullmatch(r"[().+-]*[0-9]([0-9().+-]*[0-9)])?", w))
        while at < len(words):
            a, b = words[at]
            at += 1
            if not clear(a, b) or not re.search("[0-9@]", text[a:b]):
                continue
            last = a
            while at < len(words) and words[at][0] == b + 1 and text[b] == " " and number(text[last:b].lstrip("\"'[{<")):
                if not number(text[slice(*words[at])].rstrip(",;:!?.\"']}>")) or not clear(*words[at]):
                    break
                last, b = words[at]
                at += 1
            if "@" in text[a:b] or len(re.findall("[0-9]", text[a:b])) >= 4:
                left = a + len(text[a:b]) - len(text[a:b].lstrip(pii.STRIP))
                right = a + len(text[a:b].rstrip(pii.STRIP))
                out.append((left - (left > a and text[left - 1] == "(" and ")" in text[left:right]), right))
        return out

    def words(text, strip):
        return [w for w in WORD.findall(text) if w.strip(strip)]

    rng, long = np.random.default_rng(4), "b" * 700
    for _ in range(300):
        text = "".join(rng.choice(["12", "345", "(6)", "7-8", "9.", "1,", " ", " ", "  ", "\n", "a@b", "x", "((", '"', "[", long, "0" * 200]) for _ in range(60))
        taken = sorted((a, a + 2) for a in rng.choice(max(len(text) // 40, 1), 2, replace=False) * 40)
        found = pii.identifier_like(text, taken)
        assert found == plain(text, taken)
        for a, b in found:
            before, after = words(text[:a], "\"'([{"), words(text[b:], pii.STRIP)
            assert pii._words_before(text, a, 2) == before[-2:] and pii._words_after(text, b, 1) == after[:1]


def test_exact_groups(both):
    for frame, rows in both:
        groups = defaultdict(list)
        for i, text, *_ in rows:
            groups[text or ""].append(i)
        want, stays = [], set()
        for i, text, *_ in rows:
            ids = groups[text or ""]
            keep = max((x for x in ids if x is not None), default=None)
            kept = i == keep and (text or "", keep) not in stays
            stays |= {(text or "", keep)} if kept else set()
            want.append((i, keep, len(ids), kept, sha((text or "").encode())))
        equal(exact.exact_groups(frame), ["doc_id", "keep_id", "group_size", "kept", "text_sha256"], want)
        kept = exact.keep_exact(frame)
        assert kept.schema == frame.schema
        assert sorted(r.text or "" for r in kept.collect()) == sorted(groups)


def test_cuckoo_index_inserts_deletes_and_grows():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 2**63, (20_000, 4)).astype(np.uint64)
    index = exact.CuckooIndex(64)
    for part in np.array_split(np.arange(20_000), 7):
        index.insert(keys[part], part, np.ones(len(part), np.int64))
    assert (index.find(keys) >= 0).all() and (index.find(keys ^ np.uint64(1)) < 0).all()
    index.delete(keys[::2])
    assert (index.find(keys[::2]) < 0).all() and (index.ids[index.find(keys[1::2])] == np.arange(1, 20_000, 2)).all()
    index.insert(keys[:10], np.arange(100, 110), np.ones(10, np.int64))
    index.insert(keys[:10], np.arange(10), np.ones(10, np.int64))
    at = index.find(keys[:10])
    assert (index.ids[at] == np.arange(100, 110)).all()
    assert (index.counts[at] == np.where(np.arange(10) % 2, 3, 2)).all()


def test_index_updates_equal_a_new_index(table):
    digests = exact.content_digests(table)
    held, later = digests.where("doc_id % 3 != 0"), digests.where("doc_id % 3 = 0")
    gone = digests.where("doc_id % 5 = 1 AND doc_id % 3 != 0").select("doc_id")
    entries, stored = exact.update_index(exact.build_index(held, 3), held, later, gone, 3)
    left = digests.where("doc_id % 3 = 0 OR doc_id % 5 != 1")
    equal(entries, ["digest", "keep_id", "n_rows"], [tuple(r) for r in exact.build_index(left, 3).select("digest", "keep_id", "n_rows").collect()])
    assert stored.count() == left.count()


def mixture_targets(sizes, weights=(3, 1, 2), share=1.5, limit=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight, full, total = {s: weights[i % len(weights)] for i, s in enumerate(names)}, set(), share * sum(sizes.values())
    while True:
        free = [s for s in names if s not in full]
        rest = total - sum(limit * sizes[s] for s in full)
        out = {s: limit * sizes[s] if s in full else rest * weight[s] / sum(weight[x] for x in free) for s in names}
        over = {s for s in free if out[s] > limit * sizes[s]}
        if not over:
            return out
        full |= over


@pytest.mark.parametrize("settings", [{}, {"chunk_rows": 3, "fan_in": 2}], ids=["one chunk", "tree"])
def test_mixture(both, settings):
    for frame, rows in both:
        size = lambda t: len(WORD.findall(t or ""))
        sizes = Counter()
        for _, text, _, source in rows:
            sizes[source] += size(text)
        targets = mixture_targets(dict(sizes))
        got = mixing.mix_sources(frame, **settings).collect()
        assert sorted(r.doc_id or -1 for r in got) == sorted(i or -1 for i, *_ in rows)
        by_size = {(i, size(t)): s for i, t, _, s in rows}
        taken, largest = Counter(), Counter()
        for r in got:
            source = by_size[(r.doc_id, r.size)]
            assert r.source_size == sizes[source] and abs(r.target - targets[source]) < 1e-6 * max(1, targets[source])
            assert r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
            taken[source] += r.taken
            largest[source] = max(largest[source], r.size)
        assert all(abs(taken[s] - targets[s]) <= largest[s] + 1e-6 for s in sizes)
        assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(frame.repartition(2), **settings).collect()))


def test_pivot_keeps_expectations_and_the_total():
    rng = np.random.default_rng(5)
    p, size, n = rng.random(12), rng.integers(1, 9, 12), 4000
    outs = np.array([mixing.pivot(p, size, rng.random(12)) for _ in range(n)])
    assert (((outs > 0) & (outs < 1)).sum(1) <= 1).all()
    assert np.allclose(outs @ size, p @ size)
    assert (abs(outs.mean(0) - p) < 5 * np.sqrt(p * (1 - p) / n) + 1e-9).all()


def test_mixed_rows_repeat_rows_whole(odd):
    taken = Counter()
    for r in mixing.mix_sources(odd).collect():
        taken[r.doc_id] += r.taken
    mixed = mixing.mixed_rows(odd)
    assert mixed.schema.names == odd.schema.names
    words = Counter()
    for r in mixed.collect():
        words[r.doc_id] += len(WORD.findall(r.text or ""))
    assert +words == +taken


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_vocabulary())


def test_rollups(both, library):
    for frame, rows in both:
        want = Counter()
        for _, text, lang, source in rows:
            for version, n in (("words-1", len(WORD.findall(text or ""))), ("byte_bpe_50k-1", len(library.encode(text or "", add_special_tokens=False).ids))):
                for place, x in enumerate((1, n, len(text or ""))):
                    want[(source, lang, version, place)] += x
        keys = {k[:3] for k in want}
        equal(rollups.maintained_totals(frame), ["source", "lang", "tokenizer", "n_docs", "n_tokens", "n_chars"], [(*k, *[want[(*k, p)] for p in range(3)]) for k in keys])


def test_rollup_batches_are_idempotent_and_compact(spark, tmp_path):
    counts = spark.createDataFrame([(1, "a", "en", "t", 5, 9), (2, "a", None, "t", 7, 9), (3, None, "en", "t", 1, 2)], "doc_id long, source string, lang string, tokenizer string, n_tokens long, n_chars long")
    path = str(tmp_path / "rollups")
    rollups.commit_batch(path, "1", rollups.signed_changes(inserted=counts))
    for _ in range(3):
        rollups.commit_batch(path, "2", rollups.signed_changes(deleted=counts.where("doc_id = 3"), revised=(counts.where("doc_id = 2"), counts.where("doc_id = 2").selectExpr("doc_id", "source", "lang", "tokenizer", "n_tokens + 3 AS n_tokens", "n_chars"))))
    want = [("a", "en", "t", 1, 5, 9), ("a", None, "t", 1, 10, 9)]
    columns = ["source", "lang", "tokenizer", "n_docs", "n_tokens", "n_chars"]
    equal(rollups.totals(spark, path), columns, want)
    rollups.compact(spark, path)
    equal(rollups.totals(spark, path), columns, want)
    # a batch that comes again after compaction is known by its id
    assert not rollups.commit_batch(path, "1", rollups.signed_changes(inserted=counts))
    equal(rollups.totals(spark, path), columns, want)
    assert rollups.commit_batch(path, "3", rollups.signed_changes(inserted=counts.where("doc_id = 3")))
    rollups.compact(spark, path)
    equal(rollups.totals(spark, path), columns, [*want, (None, "en", "t", 1, 1, 2)])


def test_encoding_round_trip(both, library):
    for frame, rows in both:
        want = []
        for i, text, *_ in rows:
            ids = library.encode(text or "", add_special_tokens=False).ids
            want.append((i, len(ids), sha(",".join(map(str, ids)).encode()), sha(library.decode(ids, skip_special_tokens=False).encode())))
        for size in (50_000, 20):
            equal(bpe.round_trip(frame, lexicon_words=size), ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], want)


def test_lexicon_finds_its_words_only(tmp_path):
    words = sorted({f"{a}{b}{c}".encode() for a in ("", "be", "un", "é") for b in ("ding", "do", "see") for c in ("", "s", "ing", "ed")})
    ids = np.arange(len(words))
    lexicon = bpe.Lexicon.compile(words, ids, np.arange(len(words) + 1))
    (tmp_path / "lexicon").write_bytes(lexicon.dump())
    lexicon = bpe.Lexicon.map(str(tmp_path / "lexicon"))
    assert len(lexicon.final) < 40  # suffixes are shared: the words have some 250 prefixes
    asked = [*words, b"dings!", b"un", b"", b"x"]
    data, ends = np.frombuffer(b"".join(asked), np.uint8), np.cumsum([0, *map(len, asked)])
    found = lexicon.find(data, ends[:-1], ends[1:])
    assert found[: len(words)].tolist() == ids.tolist() and (found[len(words) :] == -1).all()


def secret_truth(text):
    kinds = (
        ("assign", r"(?ia:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 8),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 16),
        ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 32),
    )
    found = [(m.start(), k, name, m.end()) for k, (name, p, ok) in enumerate(kinds) for m in re.finditer(p, text) if ok(m)]
    return [(name, a, b) for a, _, name, b in sorted(found)]


def test_secrets(both):
    for frame, rows in both:
        want = []
        for i, text, *_ in rows:
            spans = secret_truth(text or "")
            n = Counter(k for k, *_ in spans)
            want.append((i, n["assign"], n["access"], n["hex"], sha(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode())))
        found = secrets.secret_spans(frame)
        equal(found, ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256"], want)
        for r in found.collect():
            assert sha(",".join(s for s in r.spans.split(",") if not s.startswith("novel")).encode()) == r.base_sha256


def plain_windows(text):
    """Strings of 12 and more characters from a sensitive word to the end of the next line, by marking every place."""
    inside = [False] * (len(text) + 1)
    for m in re.finditer("(?ia)" + "|".join(secrets.SENSITIVE_WORDS), text):
        breaks = 0
        for i in range(m.end(), len(text)):
            breaks += text[i] == "\n"
            if breaks == 2:
                break
            inside[i] = True
    shown = "".join(c if inside[i] else "\n" for i, c in enumerate(text))
    out = []
    for m in re.finditer(r"[A-Za-z0-9+/_=.~-]+", shown):
        a = m.start() + len(m[0]) - len(m[0].lstrip("=.-"))
        if m.end() - a >= 12:
            out.append((a, m.end()))
    return out


def test_candidates_reach_to_the_end_of_the_next_line(rows):
    texts = [t or "" for _, t, *_ in rows] + [
        "secret on one line\nAbcdefghijklmnop here\nQrstuvwxyzabcdef not here", "token" * 50 + "\n" + "abcdefghijkl " * 9,
        "password a secret abcdefghijklmnop\nsecret ponmlkjihgfedcba\nabcdabcdabcd\nefghefghefgh", "nothing\nabcdefghijklmnop",
    ]
    assert [secrets.candidates(t) for t in texts] == [plain_windows(t) for t in texts]


def test_every_candidate_is_measured(spark, rows):
    """The reported strings are those whose added bytes reach the rate, with the bounds of plain words counted over all rows."""
    more = [(1_000 + i, t) for i, t in enumerate((
        "bearer: QwErTzUiOpAsDfGhJkLyXcVbNmQwErTy", "my secret is in a place that is more than forty characters away from here:\nZk9qX2v7Lr4TnW8sYb3cPd1f",
        "token is 8204917356120483", "the password hereunderstanding is thereafterwards",
        "hereunderstanding and thereafterwards are words that others know: thereafterwards, hereunderstanding",
    ))]
    table = [(i, t) for i, t, *_ in rows] + more
    frame = spark.createDataFrame(table, "doc_id long, text string")
    dictionary = secrets.identifier_dictionary(secrets.name_counts(frame))
    novelty, known, seen = secrets.Novelty(dictionary), set(dictionary.decode().split("\n")), defaultdict(list)
    rate = lambda t, a, b: novelty.added(t[max(0, a - 200) : a] + t[b : b + 200], t[a:b]) / (b - a)
    for _, t in table:
        windows = plain_windows(t or "")
        for m in secrets.PLAIN.finditer(t or ""):
            if m[0] not in known and m.span() not in windows:
                seen[sum(m.end() - m.start() >= x for x in (16, 24, 32))].append(rate(t, *m.span()))
    bounds = secrets.plain_word_rates(frame, dictionary)
    for k, bound in enumerate(bounds):
        assert sum(r >= bound for r in seen[k]) <= 0.01 * len(seen[k])
        assert not seen[k] or sum(r >= bound - 0.011 for r in seen[k]) > 0.01 * len(seen[k])
    got = {r.doc_id: [tuple(map(int, s.split(":")[1:])) for s in r.spans.split(",") if s.startswith("novel")] for r in secrets.secret_spans(frame).collect()}
    for i, t in table:
        want = []
        for a, b in plain_windows(t or ""):
            least = 0.6 if any(c.isdigit() for c in t[a:b]) else max(0.6, bounds[sum(b - a >= x for x in (16, 24, 32))])
            if rate(t, a, b) >= least and not any(x <= a and b <= y for x, _, y in secrets.fixed_spans(t)):
                want.append((a, b))
        assert got[i] == want
    assert [len(got[1_000 + i]) for i in range(4)] == [1, 1, 1, 0]


def test_novel_strings_are_found_and_known_ones_left(spark):
    names = "\n".join(f"service_account_number_{i % 3} = value" for i in range(30))
    rows = [
        (1, "the secret is Zk9qX2v7Lr4TnW8sYb3c here"),
        (2, "the secret is service_account_number_1 here\n" + names),
        (3, "the secret is xxxxxxxxxxxx1111111111 here"),
        (4, "nothing to see: Zk9qX2v7Lr4TnW8sYb3c"),
        (5, "the bearer Qw3rT9yUi0pAs7dFg5hJ then Qw3rT9yUi0pAs7dFg5hJ"),
    ]
    got = {r.doc_id: r.spans for r in secrets.secret_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == "novel:14:34" and got[2] == got[3] == got[4] == ""


def test_token_files(both, library):
    for frame, rows in both:
        want, start = [], 0
        for i, text, *_ in sorted(rows, key=lambda r: ((r[0] is not None), r[0] or 0, (r[1] is not None), r[1] or "")):
            ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
            want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
        for settings in ({}, {"shard_bytes": 10_000, "block_tokens": 1000}):
            equal(packing.write_and_read(frame, **settings), ["doc_id", "start", "n_tokens", "ids_crc32"], want)


def test_variable_length_coding():
    values = np.array([0, 1, 255, 256, 65_535, 65_536, 2**24 - 1, 2**24, 2**32 - 1, 7], np.uint32)
    for n in range(len(values) + 1):
        control, data = packing.pack(values[:n])
        assert (packing.unpack(control, data, n) == values[:n]).all() and len(control) == -(-n // 4)
    assert len(packing.pack(np.arange(256))[1]) == 256
