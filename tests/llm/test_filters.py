"""Quality rules, near duplicates, decontamination and personal data against plain Python."""

import numpy as np
import pyarrow as pa
import pytest

from tests.llm import plain
from tests.llm.conftest import COPY
from vitalgrid.llm import common, decontaminate, encoding, near_dedup, packing, pii, quality_rules


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_groups_equal_all_pairs(tiny_docs, tiny_rows):
    want = plain.groups([(i, t) for i, t, _ in tiny_rows])
    got = by_id(near_dedup.near_groups(tiny_docs))
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["n_shingles"] == len(plain.shingles(t)) for (i, t, _) in tiny_rows for r in [got[i]])
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(0, 2**63, 1100).astype(np.uint64))
    a, b = base[:880], base[120:1000]
    ranks = near_dedup.superminhash([a, b, a[:0], a[:1]])
    assert abs((ranks[0] == ranks[1]).mean() - 760 / 1000) < 0.1
    assert (ranks[2] == near_dedup._MOST).all() and len(set(ranks[3].tolist())) == ranks.shape[1]
    parts = near_dedup.BLOCK_ELEMENTS
    near_dedup.BLOCK_ELEMENTS = 100
    assert (near_dedup.superminhash([a, b]) == ranks[:2]).all()
    near_dedup.BLOCK_ELEMENTS = parts


def test_a_large_family_of_near_copies_in_small_blocks(spark, monkeypatch):
    """Links that no star around one member shows: every text differs from its neighbour only."""
    monkeypatch.setattr(near_dedup, "CHUNK", 8)
    rows = [(i, " ".join(f"w{k}" for k in range(3 * i, 3 * i + 60))) for i in range(60)]
    rows += [(100 + i, " ".join(f"w{k}" for k in range(3 * i, 3 * i + 20)) + f" own{i} " * 30) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = by_id(near_dedup.near_groups(docs))
    assert {i: r["component_id"] for i, r in got.items()} == plain.groups(rows)


def test_near_groups_of_odd_rows(odd):
    rows = near_dedup.near_groups(odd).collect()
    assert len(rows) == 12
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append(r)
    assert [r["component_id"] for r in got[6]] == [5, 5] and got[7][0]["component_id"] == 5
    assert got[1][0]["n_shingles"] == 0 and got[1][0]["kept"] and got[3][0]["component_id"] == 3
    assert got[None][0]["component_id"] is None and got[None][0]["kept"]
    kept = near_dedup.deduplicated(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 8, 9, 10]


def test_base_rules_equal_plain(tiny_docs, tiny_rows):
    got = by_id(quality_rules.judged(tiny_docs))
    for i, text, _ in tiny_rows:
        want = plain.base_rules(text)
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r["kept"] and r["base_failed"])


def test_kneser_ney_adds_up_to_one():
    rng = np.random.default_rng(2)
    code, n = np.unique(rng.zipf(1.3, 20_000) * 7919 % quality_rules.SYMBOLS**3, return_counts=True)
    model = quality_rules.KneserNey(code, n)
    s = quality_rules.SYMBOLS
    for context in [int(code[0] // s), int(code[-1] // s), 17 * s + 3, 5]:
        assert (2.0 ** -model.of(context * s + np.arange(s)).astype(float)).sum() == pytest.approx(1, abs=1e-4)
    assert len(quality_rules.KneserNey(code[:0], n[:0]).of(np.array([5]))) == 1


def test_trigrams_do_not_cross_texts():
    joined, sizes = quality_rules.codes([b"ab", b"", b"c"])
    alone = [quality_rules.codes([t])[0] for t in (b"ab", b"", b"c")]
    assert joined.tolist() == np.concatenate(alone).tolist() and sizes.tolist() == [2, 0, 1]


def test_perplexity_rejects_noise_and_keeps_prose(spark, tiny_rows):
    prose = [(i, t, lang) for i, t, lang in tiny_rows if t and len(t) > 600 and t.count("|") + t.count("*") + t.count("!!") == 0][:80]
    noise = [(1000, " ".join("zq%dxk" % (k * 7919 % 1000) + "#%$" for k in range(300)), "en")]
    got = by_id(quality_rules.judged(spark.createDataFrame(prose + noise, "doc_id bigint, text string, lang string")))
    assert not got[1000]["kept"] and not got[1000]["base_failed"]
    sound = [got[i] for i, _, _ in prose if not got[i]["base_failed"]]
    assert len(sound) > 20 and all(r["kept"] for r in sound)


def _prose(rng, words, n=150):
    return " ".join(words[k] for k in rng.zipf(1.4, n) % len(words))


def test_copies_do_not_narrow_a_language(spark):
    """Half of a language's rows are one text or its near copies; another language has two texts."""
    rng = np.random.default_rng(7)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(3000)]
    one = _prose(rng, words)
    for change in (lambda k: "", lambda k: f" end{k}"):
        rows = [(k, one + change(k), "en") for k in range(100)] + [(100 + k, _prose(rng, words), "en") for k in range(100)]
        rows += [(300, _prose(rng, words), "xx"), (301, _prose(rng, words), "xx")]
        noise = "".join(chr(33 + c) if c % 7 else " " for c in rng.integers(0, 90, 900))
        got = by_id(quality_rules.judged(spark.createDataFrame([*rows, (900, noise, "en")], "doc_id bigint, text string, lang string")))
        sound = [r for i, r in got.items() if i < 900 and not r["base_failed"]]
        assert len(sound) > 180 and got[300]["kept"] and got[301]["kept"]
        assert all(r["kept"] for r in sound)
        assert not got[900]["kept"] and not got[900]["base_failed"]


def test_quality_of_odd_rows(odd):
    rows = quality_rules.judged(odd).collect()
    assert len(rows) == 12
    assert all(r["base_failed"] and not r["kept"] for r in rows if r["doc_id"] in (1, 2, 3, 9))
    assert quality_rules.passed(odd).columns == odd.columns


def test_contamination_equals_plain(spark, tiny, tiny_docs, tiny_rows, monkeypatch):
    bench = spark.read.parquet(f"{tiny}/benchmark.parquet")
    items = [(r["item_id"], r["text"]) for r in bench.collect()]
    short = spark.createDataFrame([(900, "The. of"), (901, None), (None, "was was"), (902, "")], bench.schema)
    for table, more in ((bench, []), (bench.union(short), [(900, "The. of")])):
        got = by_id(decontaminate.report(tiny_docs, table))
        for i, text, _ in tiny_rows:
            n, hit, found = plain.contamination(text, items + more + ([(None, "was was")] if more else []))
            found = [f for f in found if f != "None"]
            r = got[i]
            assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) == (n, hit, len(found), plain.sha(",".join(found)))
            assert r["contaminated"] == (hit > 0 and 20 * hit >= n)
    monkeypatch.setattr(decontaminate, "BLOCK_MB", 0.004)
    assert by_id(decontaminate.report(tiny_docs, bench.union(short))) == got


def test_contamination_of_odd_rows(spark, odd, empty):
    bench = spark.createDataFrame([("q", COPY[:300])], "item_id string, text string")
    rows = decontaminate.report(odd, bench).collect()
    assert len(rows) == 12 and sorted(r["doc_id"] for r in rows if r["contaminated"]) == [5, 6, 6, 7]
    kept = decontaminate.clean_documents(odd, bench)
    assert kept.columns == odd.columns and kept.count() == 8
    assert decontaminate.report(odd, bench.limit(0)).filter("n_hit > 0").isEmpty()
    cut = {r["doc_id"]: r["text"] for r in decontaminate.without_spans(odd, bench).collect()}
    assert len(cut[5]) < len(COPY) and cut[9] == "a"


def test_spans_are_removed_block_by_block(spark, odd, monkeypatch):
    """With several blocks the driver never gathers them; the texts are those of one block."""
    items = [(f"q{k}", COPY[60 * k : 60 * k + 300]) for k in range(12)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    texts = lambda: sorted((r["doc_id"] or 0, r["text"]) for r in decontaminate.without_spans(odd, bench).collect())
    want, log, blocks, scan = texts(), [], decontaminate.item_blocks, decontaminate._scan

    def logged(*args):
        for block in blocks(*args):
            log.append(1)
            yield block

    monkeypatch.setattr(decontaminate, "BLOCK_MB", 0.001)
    monkeypatch.setattr(decontaminate, "item_blocks", logged)
    monkeypatch.setattr(decontaminate, "_scan", lambda *args: log.append(-1) or scan(*args))
    assert texts() == want and log.count(1) > 3
    assert max(sum(log[: k + 1]) for k in range(len(log))) <= 2


def test_spans_equal_plain(spark, tiny_docs, tiny_rows):
    odd_texts = [
        "a@b.c_d@e.f 1.2.3.4.5.6.7.8 x@y.z.", "1 " * 3000, "a@b." + "c." * 2000, "é😀 x@y.zz 999.1.1.1 001.2.3.255 " * 300,
        "a" * 50_000, "+1 (2) 3-4 5.6 7 8 9 0 1 +12", "4111-1111-1111-1111 4111111111111112", None, "",
    ]
    rows = [(i, t) for i, t, _ in tiny_rows] + [(5000 + k, t) for k, t in enumerate(odd_texts)]
    got = by_id(pii.report(spark.createDataFrame(rows, "doc_id bigint, text string")))
    for i, text in rows:
        want = plain.personal(text)
        r = got[i]
        assert r["base_sha256"] == plain.sha(plain.written(want))
        assert [r[f"n_{k}"] for k in plain.KINDS] == [sum(s[3] == k for s in want) for k in plain.KINDS]
        assert set(plain.written(want).split(",")) <= set(r["spans"].split(",")) or not want


def test_contexts_find_what_patterns_miss(spark):
    rows = [(i, f"please ring account holder on +1 (555) 010-{1000 + i} today") for i in range(30)]
    rows += [(100, "please ring account holder on (555) 020-4444 today"), (101, "there were 12345678 trees")]
    got = by_id(pii.report(spark.createDataFrame(rows, "doc_id bigint, text string")))
    text = rows[30][1]
    assert got[100]["spans"] == f"phone:{text.index('(')}:{text.index(' today')}" and got[100]["n_added"] == 1
    assert got[101]["spans"] == ""


def test_contexts_find_identifiers_beside_others(spark):
    """Next to an e-mail, a date, a time and another identifier, glued to a base span, and in rows without id."""
    rows = [(i, f"please ring account holder on +1 (555) 010-{1000 + i} today") for i in range(60)]
    asked = [
        ("mail bob@x.com 555-123-4567 today", ["555-123-4567"]), ("born 2024-01-05 555-123-4568 today", ["555-123-4568"]),
        ("at 10:30 555-123-4569 today", ["555-123-4569"]), ("born 2024-01-05 (555) 020-4444 today", ["(555) 020-4444"]),
        ("account holder on 555-123-4570 555-987-6543 today", ["555-123-4570", "555-987-6543"]),
        ("mail bob@x.com,555-123-4571 today", ["555-123-4571"]),
    ]
    rows += [(100 + k, t) for k, (t, _) in enumerate(asked)]
    rows += [(None, "account holder on 555-123-4572 today"), (None, "no number")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = pii.spans(docs).collect()
    texts = {r["doc_id"]: r for r in got}
    for k, (text, want) in enumerate(asked):
        r = texts[100 + k]
        base = {(s["start"], s["end"]) for s in r["base"]}
        assert [text[s["start"] : s["end"]] for s in r["all"] if (s["start"], s["end"]) not in base] == want
    assert sorted(r["text"] for r in pii.masked(docs).filter("doc_id IS NULL").collect()) == ["account holder on <phone> today", "no number"]
    assert len(got) == len(rows)


def test_pii_of_odd_rows(odd):
    rows = pii.report(odd).collect()
    assert len(rows) == 12
    masked = pii.masked(odd)
    assert masked.columns == odd.columns and masked.count() == 12
    texts = {r["doc_id"]: r["text"] for r in masked.collect()}
    assert texts[8] == "écrivez à <email> ou <phone> 😀" and texts[1] is None and texts[5] == COPY
    assert "<ip>" in texts[10] and "<card>" in texts[10]


def test_empty_tables(spark, empty):
    bench = spark.createDataFrame([], "item_id bigint, text string")
    for df in (
        near_dedup.near_groups(empty), quality_rules.judged(empty), decontaminate.report(empty, bench), pii.report(empty),
        near_dedup.deduplicated(empty), quality_rules.passed(empty), pii.masked(empty),
    ):
        assert df.count() == 0


def test_counting_takes_little_memory(spark, monkeypatch):
    """Counts of 4 MB of text in one task cost the totals and little else; handed on early, they add up the same."""
    import tracemalloc

    from vitalgrid.llm import common

    text = (" ".join(f"w{k * k % 9973}" for k in range(700_000)))[:4_000_000].encode()
    batch = pa.RecordBatch.from_arrays([pa.array([text[k : k + 1000] for k in range(0, len(text), 1000)], pa.binary())], ["_text"])
    held = []

    class Table:
        def select(self, *columns):
            return self

        def mapInArrow(self, run, schema):
            held.append(run)
            return spark.createDataFrame([], schema)

    class Docs:
        sparkSession = spark

    monkeypatch.setattr(common, "texts", lambda docs: Table())
    quality_rules.counted(Docs())
    tracemalloc.start()
    whole = list(held[0](iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * quality_rules.SYMBOLS**3 + 60_000_000
    monkeypatch.setattr(quality_rules, "MOST_COUNTED", 1_500_000)
    parts = list(held[0](iter([batch])))
    total = lambda made: sum((np.bincount(b["code"].to_numpy(), b["n"].to_numpy(), quality_rules.SYMBOLS**3) for b in made), 0.0)
    assert len(whole) == 1 and len(parts) > 1 and (total(whole) == total(parts)).all() and total(whole).sum() == len(text)


def test_tasks_hand_memory_back(spark, tiny_docs, monkeypatch):
    tasks, released = [], []
    rows = tiny_docs.limit(20)

    def spy(self, run, schema):
        tasks.append((self.toArrow(), run))
        return spark.createDataFrame([], schema)

    monkeypatch.setattr(type(rows), "mapInArrow", spy)
    packing.pieces(rows)
    quality_rules.counted(rows)
    common.over_texts(common.texts(rows), lambda texts, batch: {"n": [len(t) for t in texts]}, "n bigint")
    encoding.encoder(encoding.tokenizer_path(packing.FILE), lead=False)
    monkeypatch.setattr(common, "let_go", lambda: released.append(1))
    for table, run in tasks[-3:]:
        assert sum(b.num_rows for b in run(iter(table.to_batches()))) > 0
    # after the last batch of every task; the trigram counts begin a new operator, which needs no encoder
    assert len(released) == 3 and not encoding._ENCODERS
