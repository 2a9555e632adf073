"""The pipeline on a small table against plain Python, and the registration of its queries."""

import numpy as np

import __spark_entry__ as entry
import corpus_pipeline
from tests.llm import plain
from vitalgrid.llm import packing, quality_rules


def test_all_operators_are_registered():
    names = list(entry.queries())
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13 and "pipeline" in names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontamination", "pii", "packing"]


def test_pipeline_equals_plain(spark, tiny, tiny_docs, tiny_rows):
    verdict = {r["doc_id"]: r["kept"] for r in quality_rules.judged(tiny_docs).collect()}
    rows = [(i, t) for i, t, _ in tiny_rows if verdict[i]]
    group = plain.groups(rows)
    rows = [(i, t) for i, t in rows if group[i] == i]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{tiny}/benchmark.parquet").collect()]
    clean = []
    for i, t in rows:
        n, hit, _ = plain.contamination(t, items)
        if not (hit and 20 * hit >= n):
            clean.append((i, t))
    want = {}
    for i, t in clean:
        at, out = 0, []
        for start, _, end, kind in plain.personal(t):
            if start >= at:
                out += [t[at:start], f"<{kind}>"]
            at = max(at, end)
        want[i] = len(packing.document_ids(("".join(out) + t[at:]).encode())) // 4
    got = corpus_pipeline.run(spark, tiny).toPandas()
    assert got.groupby("doc_id")["length"].sum().to_dict() == want
    assert got.groupby("sequence_id")["length"].sum().max() <= 2048


def test_stages_keep_the_columns_of_documents(spark, tiny, tiny_docs, odd, empty):
    small = tiny_docs.filter("doc_id < 30")
    for docs in (small, odd, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, tiny)
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
            assert out.count() <= docs.count()
    assert np.isfinite(corpus_pipeline.STAGES[-1][1](spark, small, tiny).count())
