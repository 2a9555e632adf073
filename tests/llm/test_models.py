"""Language model, quality trees and language network: exact parts, gradients, held-out accuracy."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from vitalgrid.llm import boosting, language_id, language_model
from vitalgrid.llm.recurrent import Layer


def fold(doc_id, parts):
    return zlib.crc32(str(doc_id).encode()) % parts


def test_layer_gradients_match_differences():
    rng = np.random.default_rng(0)
    x, u = rng.standard_normal((5, 3, 8)).astype(np.float32), rng.standard_normal((4, 8)).astype(np.float32)
    keep = (rng.random((5, 3)) < 0.7).astype(np.float32)
    weight = rng.standard_normal((5, 3, 4)).astype(np.float32)

    def loss():
        return float((Layer.forward(x, u, np.zeros((3, 4), np.float32), keep)[0] * weight).sum())

    before, gates, _ = Layer.forward(x, u, np.zeros((3, 4), np.float32), keep)
    dx, du = Layer.backward(before, gates, u, weight, None, keep)
    for array, gradient in ((x, dx), (u, du)):
        at = np.unravel_index(np.abs(gradient).argmax(), gradient.shape)
        old = array[at]
        array[at] = old + 1e-2
        up = loss()
        array[at] = old - 1e-2
        down = loss()
        array[at] = old
        assert (up - down) / 2e-2 == pytest.approx(float(gradient[at]), rel=0.02)


def test_language_model_scores(tiny_docs, tiny_rows):
    got = {r["doc_id"]: r for r in language_model.model_scores(tiny_docs).collect()}
    held = {i: language_model.words_of((t or "").encode()) for i, t, _ in tiny_rows}
    counts = Counter(w for i, ws in held.items() if fold(i, 7) != 2 for w in ws)
    total, room = sum(counts.values()), math.log10(sum(counts.values()) + len(counts) + 1)
    for i, ws in held.items():
        r = got[i]
        assert r["base_score"] == pytest.approx(sum(math.log10(counts[w] + 1) for w in ws) - len(ws) * room, rel=1e-9)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(counts[w] > 0 for w in ws), total)
        assert r["held_out"] == (fold(i, 7) == 2) and r["score"] < 0
    out = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)


def test_words_beyond_the_near_table_are_joined(tiny_docs, monkeypatch):
    whole = {r["doc_id"]: r for r in language_model.model_scores(tiny_docs).collect()}
    monkeypatch.setattr(language_model, "NEAR", 4 * language_model.HEAD)
    for r in language_model.model_scores(tiny_docs).collect():
        assert r["base_score"] == pytest.approx(whole[r["doc_id"]]["base_score"], rel=1e-9)
        assert r["n_known"] == whole[r["doc_id"]]["n_known"]
        assert r["score"] == pytest.approx(whole[r["doc_id"]]["score"], rel=1e-5)


def test_words_up_to_rank_3072_have_their_own_output():
    words = [b"w%d" % k for k in range(5000)]
    near = [(language_model._signed(language_model.xxhash.xxh3_64_intdigest(w)), 9000 - k) for k, w in enumerate(words)]
    symbols, counts = language_model.Vocabulary(near, 1, 1, {}).look_up(words)
    assert symbols[:3072].tolist() == list(range(3072)) and counts.tolist() == list(range(9000, 4000, -1))
    assert symbols[3072:].min() >= 3072 and len(set(symbols[3072:].tolist())) == 64
    assert language_model.Network().ww.shape[:2] == (48, 64)


def test_next_word_shares_add_up_to_one():
    net = language_model.Network()
    state = np.random.default_rng(3).standard_normal((1, language_model.UNITS)).astype(np.float32)
    n = language_model.HEAD + language_model.TAIL
    lp = net.outputs(np.repeat(state, n, axis=0), np.arange(n))
    assert np.exp(lp.astype(float)).sum() == pytest.approx(1, abs=1e-3)
    symbols = np.arange(0, n, 37)
    states = np.random.default_rng(4).standard_normal((len(symbols), language_model.UNITS)).astype(np.float32)
    _, dstates, dcw, _, dww, _ = net.outputs(states, symbols, True)
    for array, gradient in ((net.cw, dcw), (net.ww, dww), (states, dstates)):
        at = np.unravel_index(np.abs(gradient).argmax(), gradient.shape)
        old = array[at]
        array[at] = old + 1e-2
        up = -net.outputs(states, symbols).astype(float).sum()
        array[at] = old - 1e-2
        down = -net.outputs(states, symbols).astype(float).sum()
        array[at] = old
        assert (up - down) / 2e-2 == pytest.approx(float(gradient[at]), rel=0.05)


def test_state_is_carried_through_windows_and_lanes(monkeypatch):
    rng = np.random.default_rng(6)
    net = language_model.Network()
    lengths = np.array([70, 3, 1, 130, 25])
    symbols = rng.integers(0, language_model.HEAD + language_model.TAIL, lengths.sum())
    got = language_model.log_likelihoods(net, lengths, symbols)
    ends = np.cumsum(lengths)
    for k, (a, b) in enumerate(zip(ends - lengths, ends)):
        before = Layer.forward(net.x[symbols[a:b]][:, None], net.u, np.zeros((1, language_model.UNITS), np.float32))[0]
        assert got[k] == pytest.approx(float(net.outputs(before[:, 0], symbols[a:b]).sum()), rel=1e-4)
    monkeypatch.setattr(language_model, "LANES", 1)
    assert language_model.log_likelihoods(net, lengths, symbols) == pytest.approx(got, rel=1e-4)


def test_quality_learns_from_other_folds(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = boosting.scored(docs, boosting.train(docs, labels)).join(labels, "doc_id", "left").toPandas()
    assert len(rows) == docs.count() and rows["score"].between(0, 1).all()
    assert (rows["predicted"] == (rows["score"] >= 0.7)).all()
    assert (rows["held_out"] == [fold(i, 4) == 2 for i in rows["doc_id"]]).all()
    out = rows[rows["held_out"] & rows["quality"].notna()]
    assert (out["predicted"] == out["quality"]).mean() > 0.95


def test_flat_trees_follow_their_splits():
    rng = np.random.default_rng(8)
    x = rng.standard_normal((3000, 5))
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] > 0)).astype(float)
    trees = boosting.fit(x, y)
    assert ((trees.probability(x) > 0.5) == y).mean() > 0.95
    tree, row = 0, x[7]
    node = 0
    while node < 2**boosting.DEPTH - 1:
        node = 2 * node + 1 + int(row[trees.feature[tree][node]] > trees.cut[tree][node])
    first = boosting.Trees(0.0, trees.feature[:1], trees.cut[:1], trees.value[:1])
    assert first.margin(row[None])[0] == pytest.approx(trees.value[0][node - (2**boosting.DEPTH - 1)])
    assert boosting.fit(x, np.ones(3000)).probability(x).min() > 0.9
    assert boosting.fit(x[:0], y[:0]).probability(x)[0] == pytest.approx(0.5)


def test_languages_of_other_folds(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.predicted(docs, language_id.train(docs)).join(docs.select("doc_id", "lang", "text"), "doc_id").toPandas()
    assert (rows["held_out"] == [fold(i, 3) == 1 for i in rows["doc_id"]]).all()
    out = rows[rows["held_out"]]
    assert (out["lang_pred"] == out["lang"]).mean() > 0.97 and rows["score"].between(0, 1).all()


def test_windows_cover_every_byte_once():
    span, core, margin = language_id.CORE + 2 * language_id.MARGIN, language_id.CORE, language_id.MARGIN
    texts = [bytes(np.random.default_rng(k).integers(1, 255, n).astype(np.uint8)) for k, n in enumerate((0, 1, core, core + 1, 5 * core))]
    windows, owner, sizes = language_id.cut(texts)
    assert windows.shape[0] == span
    for k, text in enumerate(texts):
        parts = [windows[margin : margin + n, i].tobytes() for i, (o, n) in enumerate(zip(owner, sizes)) if o == k]
        assert b"".join(parts) == text


def test_models_on_odd_and_empty_tables(spark, odd, empty):
    labels = spark.createDataFrame([(5, 1, 0), (8, 0, 0), (None, 1, 1), (9, None, None)], "doc_id bigint, quality int, toxic int")
    assert boosting.scored(odd, boosting.train(odd, labels)).count() == 12
    assert boosting.scored(empty, boosting.train(empty, labels.limit(0))).count() == 0
    rows = {r["doc_id"]: r for r in language_id.predicted(odd, language_id.train(odd)).collect()}
    assert len(rows) == 11 and rows[1]["lang_pred"] == rows[2]["lang_pred"] == rows[3]["lang_pred"] == "und" and rows[1]["score"] == 0
    assert language_id.predicted(empty, language_id.train(empty)).count() == 0
    scored = language_model.model_scores(odd).collect()
    assert len(scored) == 12 and all(r["n_tokens"] >= 1 and np.isfinite(r["score"]) for r in scored)
    assert language_model.model_scores(empty).count() == 0


def test_words_not_at_hand_are_hashed_once_a_call(monkeypatch):
    words = [f"w{k}".encode() for k in range(300)]
    hashes = [language_model._signed(language_model.xxhash.xxh3_64_intdigest(w)) for w in words]
    known = language_model.Vocabulary([(h, 900 - k) for k, h in enumerate(hashes[:200])], 1000, 300, {})
    whole = known.look_up(words * 3)
    hashed, digest = [], language_model.xxhash.xxh3_64_intdigest

    def spy(word):
        hashed.append(word)
        return digest(word)

    cache = language_model.common.Cache
    monkeypatch.setattr(language_model.common, "Cache", lambda value, limit: cache(value, 100))
    monkeypatch.setattr(language_model, "KNOWN_CODES", 100, raising=False)
    monkeypatch.setattr(language_model.xxhash, "xxh3_64_intdigest", spy)
    del known.codes
    for got, want in zip(known.look_up(words * 3), whole):
        assert got.tolist() == want.tolist()
    assert sorted(hashed) == sorted(words)
    assert whole[1][:200].tolist() == [900 - k for k in range(200)] and set(whole[1][200:300].tolist()) == {-1}


def test_outputs_are_log_shares_of_class_and_word():
    net, rng = language_model.Network(), np.random.default_rng(3)
    for scores in (1.0, 30.0):  # with large weights scores are shifted before the exponential
        net.ww[...], net.cw[...] = net.ww * scores, net.cw * scores
        states = rng.uniform(-1, 1, (5000, language_model.UNITS)).astype(np.float32)
        symbols = rng.integers(0, language_model.HEAD + language_model.TAIL, 5000)
        got = net.outputs(states, symbols)
        for i in range(0, 5000, 500):
            of = states[i].astype(np.float64)
            rows, k = net.cw @ of + net.cb, symbols[i] // language_model.CLASS_WORDS
            want = -np.logaddexp.reduce(rows)
            if symbols[i] < language_model.HEAD:
                inner = net.ww[k] @ of + net.wb[k]
                want += rows[k] + inner[symbols[i] % language_model.CLASS_WORDS] - np.logaddexp.reduce(inner)
            else:
                want += rows[symbols[i] - language_model.HEAD + language_model.HEAD_CLASSES]
            assert abs(got[i] - want) < 1e-4


def test_texts_are_looked_up_once(tiny_docs, monkeypatch):
    stored, found = language_model.common.stored, []

    def spy(rows):
        found.append(rows.columns)
        return stored(rows)

    monkeypatch.setattr(language_model.common, "stored", spy)
    monkeypatch.setattr(language_model, "LOOK_BYTES", 3000, raising=False)
    rows = language_model.model_scores(tiny_docs).collect()
    assert len(rows) == tiny_docs.count()
    # counts, encoded texts, scores: scoring and training read codes
    assert len(found) == 3 and "codes" in found[1] and "model" in found[2]
