"""Stages of the pipeline judge rows, not ids: repeated ids, null ids and equal rows."""

from collections import Counter

import numpy as np

import corpus_pipeline
from tests.llm.conftest import COPY
from vitalgrid.llm import decontaminate, near_dedup, quality_rules

NOISE = " ".join(["same words again and again"] * 30)


def texts(df):
    return Counter((r["doc_id"], r["text"]) for r in df.collect())


def prose(n, seed):
    rng = np.random.default_rng(seed)
    return " ".join(f"{w}{chr(97 + i % 26)}" for i, w in enumerate(rng.choice(["lamp", "river", "stone", "wind", "green", "late"], n)))


def test_quality_goes_by_row(spark):
    rows = [(1, prose(60, 1), "en"), (1, NOISE, "en"), (None, NOISE, "en"), (None, prose(60, 2), "en"), (2, NOISE, None), (3, None, "en")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").selectExpr("*", "1 AS row_key", "2 AS rows", "3 AS keys")
    verdict = {(r["doc_id"], r["n_words"]): r["kept"] for r in quality_rules.judged(docs).collect()}
    kept = quality_rules.passed(docs)
    assert kept.columns == docs.columns
    assert texts(kept) == Counter((i, t) for i, t, _ in rows if verdict[i, len((t or "").split())])
    assert (1, NOISE) not in texts(kept) and (None, NOISE) not in texts(kept) and (1, rows[0][1]) in texts(kept)


def test_decontamination_goes_by_row(spark):
    passage = " ".join(f"benchmark{i} word" for i in range(20))
    rows = [(1, prose(50, 3)), (1, passage), (None, passage + " end"), (None, None), (None, prose(50, 4))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    items = spark.createDataFrame([(7, passage)], "item_id bigint, text string")
    assert texts(decontaminate.clean_documents(docs, items)) == Counter([rows[0], rows[3], rows[4]])


def test_equal_rows_leave_one(spark):
    other = COPY.replace("more", "less")
    rows = [
        (5, COPY), (5, COPY), (9, COPY), (None, COPY), (6, prose(40, 5)), (6, prose(40, 6)), (7, None), (7, ""), (8, ""),
        (None, other), (None, other), (None, None), (None, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS _key", "2 AS _owner", "'x' AS row_key")
    left = near_dedup.deduplicated(docs)
    assert left.columns == docs.columns
    got = texts(left)
    assert sum(got.values()) == len(got) == 6
    assert got[5, COPY] == got[None, other] == got[None, None] == got[8, ""] == 1
    assert sum(n for (i, _), n in got.items() if i == 6) == sum(n for (i, _), n in got.items() if i == 7) == 1


def test_keys_met_by_a_shuffle_give_the_same(spark, odd, monkeypatch):
    want = [texts(near_dedup.deduplicated(odd)), texts(quality_rules.passed(odd))]
    monkeypatch.setattr("vitalgrid.llm.common.BROADCAST_KEYS", 0)
    assert [texts(near_dedup.deduplicated(odd)), texts(quality_rules.passed(odd))] == want


def test_pipeline_over_rows_without_id_and_equal_rows(spark, tiny, tiny_docs):
    """What a row becomes does not depend on the id of others: copies without id add nothing but themselves."""
    some = tiny_docs.filter("doc_id < 60")
    again = some.filter("doc_id % 2 = 0")
    docs = some.unionByName(again).unionByName(again.withColumn("doc_id", again["doc_id"] * 0 + None))
    once, more = some, docs
    for name, stage in corpus_pipeline.STAGES[1:3]:
        once, more = stage(spark, once, tiny), stage(spark, more, tiny)
    assert texts(more) == texts(once)


def test_stars_then_blocks_equal_all_pairs(spark, monkeypatch):
    """A large group, chains, and texts that share a passage without being linked; blocks of few members and shingles."""
    from tests.llm import plain

    for chunk, shingles, share in ((4, 2_000_000, 0.05), (512, 200, 2.0)):
        monkeypatch.setattr(near_dedup, "CHUNK", chunk)
        monkeypatch.setattr(near_dedup, "CHUNK_SHINGLES", shingles)
        monkeypatch.setattr(near_dedup, "WORTHWHILE", share)
        base = [f"w{k}" for k in range(80)]
        rows = [(i, " ".join(base[:40] + [f"x{i}"] + base[40:])) for i in range(40)]
        rows += [(100 + i, " ".join(f"c{k}" for k in range(3 * i, 3 * i + 60))) for i in range(30)]
        rows += [(200 + i, " ".join(base[:50]) + f" own{i}" * 20) for i in range(25)]
        docs = spark.createDataFrame(rows, "doc_id bigint, text string")
        got = {r["doc_id"]: r["component_id"] for r in near_dedup.near_groups(docs).collect()}
        assert got == plain.groups(rows)
