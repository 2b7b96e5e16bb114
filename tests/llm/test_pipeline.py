"""The corpus pipeline, stage by stage, against brute-force versions composed in the same order."""

from collections import Counter, defaultdict

from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_documents import WORD, mixture_targets, near_truth
from voltlane.llm import quality
from voltlane.llm.tokens import public_vocabulary


def kept_by_quality(rows):
    """Fixed rules by plain counting; the limits on repeats are tested with their operator."""
    out = []
    for i, text, *_ in rows:
        words = WORD.findall(text or "")
        windows = Counter(zip(words, words[1:], words[2:]))
        marked = {j + k for j, g in enumerate(zip(words, words[1:], words[2:])) if windows[g] > 1 for k in range(3)}
        if len(words) >= 50 and 100 * len(marked) <= 50 * len(words):
            out.append(i)
    return out


def test_pipeline_stages(spark, table, rows, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_vocabulary())
    extra = spark.createDataFrame([(None, " ".join(f"n{i}" for i in range(80)), None, None), (9001, None, "en", "web"), (9002, "", "en", "web")], "doc_id long, text string, lang string, source string")
    docs = table.withColumn("_row", F.lit("x")).unionByName(extra, allowMissingColumns=True)
    rows = [*rows, (None, " ".join(f"n{i}" for i in range(80)), None, None), (9001, None, "en", "web"), (9002, "", "en", "web")]
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        steps[name] = docs.collect()
        if name != "BPE encoding":
            assert docs.columns == before.columns

    good = {(r.doc_id, r.text) for r in steps["quality rules"]}
    fixed = set(kept_by_quality(rows))
    judged = {r.doc_id for r in quality.quality_measures(table.unionByName(extra, allowMissingColumns=True)).where("kept").collect()}
    assert {i for i, _ in good} == judged <= fixed and None in judged

    groups = defaultdict(list)
    for i, text in good:
        groups[text].append(-1 if i is None else i)
    exact = {(max(ids), text) for text, ids in groups.items()}
    assert {(-1 if r.doc_id is None else r.doc_id, r.text) for r in steps["exact dedup"]} == exact and len(steps["exact dedup"]) == len(exact)

    truth = near_truth([(i, t) for i, t in exact if i >= 0])
    single = {i for i, root in truth.items() if i == root} | {-1}
    assert {-1 if r.doc_id is None else r.doc_id for r in steps["near dedup"]} == single

    size = lambda r: len(WORD.findall(r.text or ""))
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in steps["near dedup"]:
        sizes[r.source] += size(r)
        largest[r.source] = max(largest[r.source], size(r))
    for r in steps["mixing"]:
        taken[r.source] += size(r)
    targets = mixture_targets(dict(sizes))
    assert all(abs(taken[s] - targets[s]) <= largest[s] + 1e-6 for s in sizes)
    assert max(Counter(r.doc_id for r in steps["mixing"]).values()) <= 2

    want = Counter((r.doc_id, tuple(library.encode(r.text or "", add_special_tokens=False).ids)) for r in steps["mixing"])
    assert Counter((r.doc_id, tuple(r.ids)) for r in steps["BPE encoding"]) == want


def test_empty_pipeline(spark, nothing, tmp_path):
    docs = nothing
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.collect() == []
