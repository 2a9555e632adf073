"""Exact copies, ranked search and the manifest against plain Python."""

from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import plain
from vitalgrid.llm import common, exact_dedup, lexical_search, merkle
from vitalgrid.llm.exact_dedup import QuotientFilter


def filter_of(values, bits):
    held, counts = np.unique(np.array(values, np.uint64), return_counts=True)
    return QuotientFilter.of(held, counts, bits)


@settings(max_examples=60, deadline=None)
@given(st.sampled_from([5, 13, 40, 64]), st.data())
def test_filters_merge_without_loss(bits, data):
    several = st.lists(st.integers(0, 2**bits - 1) | st.integers(0, 30), max_size=60)
    parts = [data.draw(several) for _ in range(3)]
    merged = QuotientFilter.of(np.zeros(0, np.uint64), np.zeros(0, np.uint64), bits)
    for part in parts:
        merged = merged.merged(QuotientFilter.from_bytes(filter_of(part, bits).to_bytes()))
    want = Counter(x for part in parts for x in part)
    held, counts = QuotientFilter.from_bytes(merged.to_bytes()).entries()
    assert dict(zip(held.tolist(), counts.tolist())) == want
    asked = [*want, 2**bits - 1, 0]
    assert merged.count(np.array(asked, np.uint64)).tolist() == [want[x] for x in asked]


def test_a_filter_is_smaller_than_its_fingerprints():
    values = np.random.default_rng(0).integers(0, 2**56, 1 << 16).astype(np.uint64)
    assert len(filter_of(values, 56).to_bytes()) < 7 * len(values)


def groups_of(df):
    return sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in df.collect()), key=repr)


def test_exact_groups_equal_plain(tiny_docs, tiny_rows):
    got = exact_dedup.exact_groups(tiny_docs)
    assert groups_of(got) == sorted(plain.copies([(i, t) for i, t, _ in tiny_rows]), key=repr)
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got.collect())


@pytest.mark.parametrize("keys", [exact_dedup.BROADCAST_KEYS, 0])
def test_exact_groups_of_odd_rows(odd, monkeypatch, keys):
    """With keys broadcast, and met by a shuffle; a null text is an empty one."""
    monkeypatch.setattr(exact_dedup, "BROADCAST_KEYS", keys)
    monkeypatch.setattr(exact_dedup, "PIECE", 3)
    got = exact_dedup.exact_groups(odd)
    assert groups_of(got) == sorted(plain.copies([(r["doc_id"], r["text"]) for r in odd.collect()]), key=repr)
    kept = Counter(r["doc_id"] for r in got.collect() if r["kept"])
    assert kept == {2: 1, 3: 1, None: 1, 4: 1, 6: 1, 7: 1, 8: 1, 9: 1, 10: 1}
    left = exact_dedup.deduplicated(odd)
    assert left.columns == odd.columns
    assert Counter(r["doc_id"] for r in left.collect()) == kept


def test_a_group_without_ids(spark):
    docs = spark.createDataFrame([(None, "x"), (None, "x"), (None, None)], "doc_id bigint, text string")
    rows = exact_dedup.exact_groups(docs).collect()
    assert sorted((r["keep_id"], r["group_size"], r["kept"]) for r in rows) == [(None, 1, True), (None, 2, False), (None, 2, True)]
    assert exact_dedup.deduplicated(docs).count() == 2


def test_nothing_in_nothing_out(spark, empty):
    items = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert exact_dedup.exact_groups(empty).count() == 0 and exact_dedup.deduplicated(empty).count() == 0
    assert merkle.manifest(empty).count() == 0 and merkle.dataset_root(empty) is None
    assert lexical_search.ranked(empty, items).count() == 0
    assert lexical_search.ranked(items.selectExpr("item_id AS doc_id", "text"), items.limit(0)).count() == 0


def test_search_equals_plain(spark, tiny, tiny_docs, tiny_rows, monkeypatch):
    monkeypatch.setattr(lexical_search, "BLOCK_DOCS", 7)
    benchmark = spark.read.parquet(f"{tiny}/benchmark.parquet")
    want = plain.search([(i, t) for i, t, _ in tiny_rows], [tuple(r) for r in benchmark.select("item_id", "text").collect()])
    got = [tuple(r) for r in lexical_search.ranked(tiny_docs, benchmark).collect()]
    assert sorted(got) == sorted(want)


def test_search_of_odd_rows(spark, odd, monkeypatch):
    """Long items, items that share an id or have none, ties, several blocks of items."""
    monkeypatch.setattr(lexical_search, "BLOCK_MB", 0.001)
    rows = [(1, "alpha GAMMA word3 and"), (1, "Écrivez à"), (2, None), (None, "some more of it"), (3, " ".join(f"word{i}" for i in range(90)))]
    items = spark.createDataFrame(rows, "item_id bigint, text string").selectExpr("*", "1 AS score", "2 AS rank", "'x' AS item")
    want = plain.search([(r["doc_id"], r["text"]) for r in odd.collect()], rows)
    assert sorted(map(repr, (tuple(r) for r in lexical_search.ranked(odd, items).collect()))) == sorted(map(repr, want))


def test_masks_are_judged_best_first_and_some_never():
    rng = np.random.default_rng(3)
    sizes = np.full(4000, 3)
    term = np.concatenate([np.sort(rng.choice(80, 3, replace=False)) for _ in range(4000)])
    part = rng.integers(900, 1000, len(term))
    block = lexical_search.Block(np.arange(4000), np.zeros(4000, bool), sizes, term, part)
    weights, terms = np.arange(1, 81) ** 2, np.arange(0, 80)
    best = lexical_search.Best(10)
    groups, bounds = block.masks(terms, weights)
    assert sum(map(len, groups)) == 4000 and (np.diff(bounds) <= 0).all()
    judged = best.search(block, terms, weights, weights)
    exact = (weights[term] * part).reshape(-1, 3).sum(axis=1)
    assert judged < len(groups) / 2
    assert best.held[0].tolist() == sorted(exact.tolist(), reverse=True)[:10]


def manifests(df):
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(repr, (tuple(r) for r in df.select(*columns).collect())))


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def test_manifest_equals_plain(tiny_docs):
    want = plain.manifest([tuple(r) for r in tiny_docs.select(*FIELDS).collect()])
    assert manifests(merkle.manifest(tiny_docs)) == sorted(map(repr, want))
    assert merkle.dataset_root(tiny_docs) == want[0][3]


def test_manifest_of_odd_rows(odd):
    rows = [tuple(r) for r in odd.select(*FIELDS).collect()]
    assert manifests(merkle.manifest(odd)) == sorted(map(repr, plain.manifest(rows)))


@pytest.mark.parametrize("rows", [0, merkle.BROADCAST_ROWS])
def test_manifest_of_groups_of_every_shape(spark, monkeypatch, rows):
    """Groups of one, of whole and odd runs, over several blocks; many groups; ranges met by a shuffle."""
    monkeypatch.setattr(merkle, "BROADCAST_ROWS", rows)
    sizes = {"a": 1, "b": 8, "c": 9, "d": 64, "e": 65, "f": 513, "": 2, None: 7, "é": 600} | {f"x{i}": 1 + i % 3 for i in range(60)}
    made = [(i * 7 % 5003, f"s{i % 2}", g, i, f"Text {i} of {g}") for g, n in sizes.items() for i in range(n)]
    docs = spark.createDataFrame(made, "doc_id bigint, source string, lang string, n_chars bigint, text string")
    assert manifests(merkle.manifest(docs)) == sorted(map(repr, plain.manifest(made)))


def test_a_change_is_found_out(tiny_docs):
    rows = merkle.manifest(tiny_docs).collect()
    tampered = {r["doc_id"] for r in tiny_docs.filter(common.in_fold(tiny_docs["doc_id"], 3, 0)).filter("text RLIKE '[A-Z]'").collect()}
    assert tampered and {r["doc_id"] for r in rows if not r["verified"]} == tampered
