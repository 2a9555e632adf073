"""Token counts, training order and packing: exact round trips with the library."""

import zlib

import numpy as np
import pytest

from tests.llm.conftest import LONG
from vitalgrid.llm import packing, token_count, training_order
from vitalgrid.llm.encoding import encoder, tokenizer_path

HARD = [
    "", " ", "  ", "a", " a ", "a  b", "x <|endoftext|> y<|startoftext|>", "it is \n x\n\nz\n", "a\x1cb\x00c", "é ́ x", "don't  'RE we'll I'M",
    "3 4 55.66", "ß İ Ǆ ﬁ Ω μ", "日本語 テキスト", "tab\tsep nbsp　wide", "a\n b", "word.\nNext line, again!", "x" * 3000,
]


@pytest.mark.parametrize("file, lead", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_stretches_give_the_librarys_ids(tiny_rows, file, lead):
    enc = encoder(tokenizer_path(file), lead)
    for text in [*HARD, *[t or "" for _, t, _ in tiny_rows]]:
        assert np.frombuffer(enc.ids(text), np.uint32).tolist() == enc.library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("chunk, overlap", [(50, 4), (300, 10), (2000, 64)])
def test_spliced_chunks_are_the_whole(tiny_rows, chunk, overlap):
    enc = encoder(tokenizer_path(token_count.FILE), True)
    body = " ".join(t or "" for _, t, _ in tiny_rows[:12])
    for text in (body, body[:900] + "y" * 700 + "  \n " * 90 + body[:900], *HARD):
        assert token_count.spliced_ids(enc, text, chunk, overlap).tolist() == enc.library.encode(text, add_special_tokens=False).ids


def test_counts_of_odd_rows(odd, empty):
    rows = token_count.counts(odd).collect()
    assert len(rows) == 12
    got = {r["doc_id"]: r for r in rows}
    assert got[1]["n_tokens"] == 0 and got[4]["n_bytes"] == len(LONG) and got[4]["over_limit"]
    assert token_count.counts(empty).count() == 0


def test_permutation_is_a_bijection_that_the_key_changes():
    for n in (1, 2, 3, 5, 64, 1000, 4097):
        assert sorted(training_order.permuted(np.arange(n), n).tolist()) == list(range(n))
    a, b = (training_order.permuted(np.arange(1000), 1000, key) for key in (1, 2))
    assert (a != b).mean() > 0.9 and (a != np.arange(1000)).mean() > 0.9


def test_shards_hold_the_stream_in_keyed_order(spark, odd, tmp_path):
    path, out = str(tmp_path / "docs"), str(tmp_path / "shards")
    odd.select("doc_id", "text").repartition(3).write.parquet(path)
    manifest = training_order.materialise(spark, path, out, length=64, per_shard=50).toPandas().sort_values("slot")
    rows = spark.read.parquet(path).selectExpr("_metadata.file_path f", "_metadata.row_index r", "doc_id", "text").toPandas().sort_values(["f", "r"])
    ids = [np.frombuffer(packing.document_ids(("" if t is None else t).encode()), np.uint32) for t in rows["text"]]
    stream = np.concatenate(ids)
    whole = np.concatenate([stream, np.zeros(-len(stream) % 64, np.uint32)]).reshape(-1, 64)
    slots = training_order.permuted(np.arange(len(whole)), len(whole))
    got = list(training_order.read(out, 0, len(whole) + 9, 64, 50))
    assert len(got) == len(whole) == len(manifest)
    assert all((got[s] == w).all() for s, w in zip(slots, whole))
    assert (manifest["ids_crc32"].to_numpy() == [zlib.crc32(g.tobytes()) for g in got]).all()
    later = list(training_order.read(out, 70, 5, 64, 50))
    assert all((a == b).all() for a, b in zip(later, got[70:75]))
    again = training_order.materialise(spark, path, out, length=64, per_shard=50).toPandas().sort_values("slot")
    assert (again["ids_crc32"].to_numpy() == manifest["ids_crc32"].to_numpy()).all()


def test_texts_are_encoded_once(spark, odd, tmp_path):
    """Second pass: the stored ids, cut at the same places whatever the blocks; the texts are not read again."""
    path = str(tmp_path / "docs")
    odd.select("doc_id", "text").write.parquet(path)
    blocks = training_order.encoded(spark, path)
    starts, total = training_order.run_starts(blocks)
    assert total == blocks.agg({"n": "sum"}).first()[0] and set(starts.values()) >= {0}
    plan = training_order.materialise(spark, path, str(tmp_path / "out"), length=64)._jdf.queryExecution().optimizedPlan().toString()
    assert "_text" not in plan


def test_training_order_without_rows(spark, empty, tmp_path):
    empty.write.parquet(str(tmp_path / "none"))
    assert training_order.materialise(spark, str(tmp_path / "none"), str(tmp_path / "out")).count() == 0


def test_pieces_and_places(spark, tiny_docs, tiny_rows, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 64)
    rows = packing.packed(packing.pieces(tiny_docs)).toPandas()
    lib = encoder(tokenizer_path(packing.FILE), False).library
    held = rows.set_index(["doc_id", "piece"])
    total = 0
    for i, text, _ in tiny_rows:
        ids = np.array([*lib.encode(text or "", add_special_tokens=False).ids, 0], np.uint32)
        total += -(-len(ids) // 2048)
        for k in range(0, len(ids), 2048):
            r = held.loc[(i, k // 2048)]
            assert (r["start"], r["length"], r["ids_crc32"]) == (k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes()))
    assert len(rows) == total
    ordered = rows.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id")["length"].cumsum() - ordered["length"] == ordered["offset"]).all()
    fills = rows.groupby("sequence_id")["length"].sum()
    assert fills.max() <= 2048 and len(fills) <= rows["length"].sum() / 2048 + 4 + 0.02 * len(fills)


def test_evolution_keeps_every_item_once_and_improves():
    rng = np.random.default_rng(4)
    sizes = rng.integers(200, 900, 400)
    of = packing.evolve(sizes, 2048, [1, 2, 3])
    fills = np.bincount(of, weights=sizes)
    first = len(packing._best_fit(np.argsort(-sizes, kind="stable"), sizes.tolist(), 2048))
    assert fills.max() <= 2048 and (fills > 0).all() and len(fills) <= first
    again = packing.evolve(sizes, 2048, [1, 2, 4], [of, of])
    assert again.max() <= of.max()
    a, b = packing._groups(of), packing._best_fit(rng.permutation(400), sizes.tolist(), 2048)
    child = packing._crossed(a, b, sizes, sizes.tolist(), 2048, rng)
    assert sorted(i for g in child for i in g) == list(range(400))


def test_packing_of_odd_rows(odd, empty):
    rows = packing.packed(packing.pieces(odd)).toPandas()
    assert (rows["doc_id"] == 6).sum() == 2 * (rows["doc_id"] == 5).sum() and rows["doc_id"].isna().sum() == 1
    assert rows.groupby(["sequence_id", "offset"]).size().max() == 1
    assert rows[rows["doc_id"] == 1]["length"].tolist() == [1]
    assert packing.packed(packing.pieces(empty)).count() == 0
    whole = packing.sequences(odd.select("doc_id", "text")).toPandas()
    assert whole["n_tokens"].sum() >= rows["length"].sum() and (whole["ids"].map(len) == 4 * whole["n_tokens"]).all()
