"""The pipeline against the stages' plain versions, each on its own input."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
from lumenaudit.llm import bpe, pii, quality_rules
from lumenaudit.llm.common import written
from lumenaudit.sources.tables import table
from tests.llm.test_operators import brute_components, lower


def contaminated(text, windows):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    hit = {k + j for win in windows for k in range(len(w) - len(win) + 1) if tuple(w[k : k + len(win)]) == win for j in range(len(win))}
    return bool(hit) and 20 * len(hit) >= len(w)


def test_stages(spark, data):
    docs = table(spark, data, "documents")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.collect()]
        docs = written(stage(spark, docs, data))
        seen[name] = (before, [tuple(r) for r in docs.collect()], docs)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    before, after, _ = seen["quality rules"]
    kept = Counter(r.doc_id for r in quality_rules.query(spark, data).collect() if r.kept)
    assert Counter(r[0] for r in after) == kept and len(after) < len(before) and not Counter(map(str, after)) - Counter(map(str, before))
    before, after, _ = seen["n-gram Jaccard join"]
    groups = defaultdict(list)
    for n, (_, component) in brute_components([(n, r[1]) for n, r in enumerate(before)]).items():
        groups[component].append(before[n][0])
    assert Counter(r[0] for r in after) == Counter(min(ids, key=lambda d: (d is None, d or 0)) for ids in groups.values()) and len(after) < len(before)
    before, after, _ = seen["benchmark decontamination"]
    items = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(r.text)) for r in table(spark, data, "benchmark").collect()]
    windows = {tuple(x[k : k + min(13, len(x))]) for x in items for k in range(len(x) - min(13, len(x)) + 1 if x else 0)}
    assert sorted(map(str, after)) == sorted(str(r) for r in before if not contaminated(r[1], windows))
    before, after, _ = seen["personal data"]
    assert len(before) == len(after) and not any(pii.base_spans(r[1]) for r in after)
    assert Counter(str(r) for r in before if not pii.base_spans(r[1])) - Counter(map(str, after)) == Counter()
    before, _, coded = seen["BPE encoding"]
    assert Counter((r.doc_id, r.text) for r in bpe.decode(coded, ["doc_id"]).collect()) == Counter((r[0], r[1] or "") for r in before)


def test_run(spark, data):
    got = corpus_pipeline.run(spark, data)
    assert got.count() > 0 and "ids" in got.columns


def test_run_empty(spark, empty):
    assert corpus_pipeline.run(spark, empty).count() == 0
