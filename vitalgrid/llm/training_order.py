"""Training-order materialisation: fixed-stride shards of token sequences in a keyed random order.

The corpus is one stream of token ids: files by path, rows by position in the
file, each text followed by one end id. Every ``LENGTH`` ids are a sequence (the
last is filled up with end ids). A keyed Feistel network over the sequence
numbers, walked until it falls below their count, is a permutation: it gives
every sequence its global slot without a table or a sort of the whole. Shards
are ranges of slots; slot s lies at byte (s mod per shard) * stride of its shard,
so a reader goes on from any slot by one seek and reads forward from there.

Texts are encoded once: their ids are written in blocks, with the run of rows
that a task read them in. The sizes of all runs then say where each block lies in
the stream. What moves is the ids, once, each sequence to its shard. Shards are written under a name of their
own and moved into place whole, so a task that runs again replaces nothing by
half.

Defined cases: null and empty texts give their end id; repeated rows are
streamed as often as they occur; no rows give no sequences. A document's id may
be null; it is listed as null.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalgrid.llm import common
from vitalgrid.llm.encoding import decoded, encoder, tokenizer_path
from vitalgrid.llm.packing import END_ID
from vitalgrid.session import run_folder

FILE = "word_bpe_49k.json"
LENGTH = 2048
#: Sequences of a shard: 32 MB at two bytes an id.
PER_SHARD = 8192
KEY = 20_240_607
ROUNDS = 6
#: Ids fit two bytes: both word vocabularies have fewer than 65,536.
ID = np.dtype("<u2")
#: Bytes of text whose ids are written as one row, unless a single text is longer: a batch holds up to a thousand of them.
ENCODED_BYTES = 64_000


def permuted(index: np.ndarray, count: int, key: int = KEY, rounds: int = ROUNDS) -> np.ndarray:
    """Slot of every sequence number below ``count``: a bijection on 0..count-1 for each key."""
    half = max(1, (max(count - 1, 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    out = index.astype(np.uint64)
    walking = np.arange(len(out))
    while len(walking):
        left, right = out[walking] >> np.uint64(half), out[walking] & low
        for r in range(rounds):
            salt = np.uint64((key * 0x9E3779B97F4A7C15 + r * 0xD6E8FEB86659FD93) % 2**64)
            left, right = right, left ^ (common.mixed(right ^ common.mixed(np.array([salt]))) & low)
        out[walking] = (left << np.uint64(half)) | right
        walking = walking[out[walking] >= np.uint64(count)]
    return out.astype(np.int64)


def _store(uri: str) -> tuple[pa.fs.FileSystem, str]:
    if "://" in uri or uri.startswith("file:"):
        return pa.fs.FileSystem.from_uri(uri)
    return pa.fs.LocalFileSystem(), uri


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bool, list, list]]:
    """(file, first row, whether it goes on from the block before, ids, texts) of consecutive rows of one file."""
    file, expected = None, -1
    for batch in batches:
        get = lambda c, b=batch: b.column(b.schema.get_field_index(c))
        rows, files, texts = get("_row").to_numpy(), get("_file").to_pylist(), get("_text").to_pylist()
        ids = get("doc_id").to_pylist()
        begin = 0
        sizes = np.array([len(t) for t in texts], np.int64)
        new = [k for k in range(1, len(rows)) if rows[k] != rows[k - 1] + 1 or files[k] != files[k - 1]]
        for end in [*new, len(rows)]:
            for cut in common.blocks(sizes[begin:end], common.BLOCK_BYTES):
                a, b = begin + cut.start, begin + cut.stop
                goes_on = files[a] == file and rows[a] == expected
                yield files[a], int(rows[a]), goes_on, ids[a:b], texts[a:b]
                file, expected = files[a], int(rows[b - 1]) + 1
            begin = end


def _rows(spark: SparkSession, path: str) -> DataFrame:
    common.small_batches(spark)
    return spark.read.parquet(path).select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"),
        F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("_text"),
    )


def encoded(spark: SparkSession, path: str, file: str = FILE) -> DataFrame:
    """The ids of all rows, written once in blocks of whole texts.

    ``file, row`` name the run of rows a block belongs to, ``at`` its place in the
    run; ``n`` ids, compressed, of ``docs`` with ``sizes`` ids each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = encoder(tokenizer_path(file), lead=False), np.uint32(END_ID).tobytes()
        begun, at = 0, 0
        for name, row, goes_on, docs, texts in _runs(batches):
            if not goes_on:
                begun, at = row, 0
            out: list[tuple] = []
            for cut in common.blocks(np.array([len(t) for t in texts], np.int64), ENCODED_BYTES):
                parts = [coder.ids(decoded(t)) + end for t in texts[cut]]
                ids = np.frombuffer(b"".join(parts), np.uint32).astype(ID)
                sizes = [len(p) // 4 for p in parts]
                out.append((name, begun, at, len(ids), pa.compress(ids.tobytes(), "zstd", asbytes=True), docs[cut], sizes))
                at += len(ids)
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["file", "row", "at", "n", "ids", "docs", "sizes"]
            )

    schema = "file string, row bigint, at bigint, n bigint, ids binary, docs array<bigint>, sizes array<bigint>"
    return common.stored(_rows(spark, path).mapInArrow(run, schema))


def run_starts(blocks: DataFrame) -> tuple[dict[tuple[str, int], int], int]:
    """Stream position of every run of rows that a task read, and the length of the stream.

    One entry per file split: the driver holds as many for the scan itself.
    """
    found = blocks.groupBy("file", "row").agg(F.sum("n").alias("n")).collect()
    starts, total = {}, 0
    for r in sorted(found, key=lambda r: (r["file"], r["row"])):
        starts[r["file"], r["row"]] = total
        total += r["n"]
    return starts, total


def materialise(spark: SparkSession, path: str, out: str, file: str = FILE, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY) -> DataFrame:
    """Write the shards of the Parquet table at ``path`` to the folder ``out``.

    Returns the manifest: ``slot, sequence, shard, byte_offset, n_tokens,
    ids_crc32, doc_ids`` per sequence; crc32 of the stored bytes.
    """
    blocks = encoded(spark, path, file)
    starts, total = run_starts(blocks)
    count = -(-total // length)
    shared = spark.sparkContext.broadcast(starts)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every block where sequences begin."""
        kinds = (pa.int64(),) * 4 + (pa.binary(), pa.int64(), pa.list_(pa.int64()))
        for batch in batches:
            for r in zip(*(batch.column(i) for i in range(batch.num_columns))):
                name, row, at, n, body, docs, sizes = (v.as_py() for v in r)
                begin = shared.value[name, row] + at
                ids = pa.decompress(body, n * ID.itemsize, "zstd", asbytes=True)
                first = begin // length
                numbers = np.arange(first, (begin + n - 1) // length + 1)
                edges = np.maximum(np.append(numbers, numbers[-1] + 1) * length, begin)
                edges[-1] = min(edges[-1], begin + n)
                edges -= begin
                slots = permuted(numbers, count, key)
                # a document belongs to every sequence that holds one of its ids
                ends = np.cumsum(sizes)
                low = np.searchsorted(ends, edges[:-1], side="right").tolist()
                high = (np.searchsorted(ends, edges[1:] - 1, side="right") + 1).tolist()
                places = edges.tolist()
                columns = (
                    slots // per_shard, slots, (edges[:-1] + begin) % length, numbers,
                    [pa.compress(ids[2 * a : 2 * b], "zstd", asbytes=True) for a, b in zip(places, places[1:])],
                    2 * np.diff(edges), [docs[i:j] for i, j in zip(low, high)],
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)], ["shard", "slot", "first", "sequence", "ids", "size", "docs"]
                )

    pieces = blocks.mapInArrow(
        cut, "shard bigint, slot bigint, first bigint, sequence bigint, ids binary, size bigint, docs array<bigint>"
    )
    shards = max(1, -(-count // per_shard))
    # a shard is one file of bounded size, so one task may write it
    dealt = pieces.repartition(shards, "shard").sortWithinPartitions("shard", "slot", "first")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = _store(out)
        fs.create_dir(folder, recursive=True)
        open_, target, shard = None, "", None
        rows: list[tuple] = []
        now: list | None = None

        def close() -> None:
            nonlocal open_
            if open_ is not None:
                open_.close()
                fs.move(target, f"{folder}/shard-{shard:08d}.bin")
                open_ = None

        def finish() -> None:
            """Write the sequence whose parts are all there."""
            nonlocal now, open_, target, shard
            if now is None:
                return
            number, slot, sequence, parts, docs = now
            if number != shard:
                close()
                shard, target = number, f"{folder}/.shard-{number:08d}-{uuid4().hex}"
                open_ = fs.open_output_stream(target)
            body = b"".join(parts)
            n = len(body) // ID.itemsize
            body += np.full(length - n, END_ID, ID).tobytes()
            open_.write(body)
            rows.append((slot, sequence, number, slot % per_shard * length * ID.itemsize, n, zlib.crc32(body), docs))
            now = None

        def made() -> pa.RecordBatch:
            kinds = (pa.int64(),) * 6 + (pa.list_(pa.int64()),)
            batch = pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                ["slot", "sequence", "shard", "byte_offset", "n_tokens", "ids_crc32", "doc_ids"],
            )
            rows.clear()
            return batch

        for batch in batches:
            for r in batch.to_pylist():
                body = pa.decompress(r["ids"], r["size"], "zstd", asbytes=True)
                if now is not None and now[1] == r["slot"]:
                    now[3].append(body)
                    now[4].extend(r["docs"])
                else:
                    finish()
                    now = [r["shard"], r["slot"], r["sequence"], [body], list(r["docs"])]
            if rows:
                yield made()
        finish()
        close()
        if rows:
            yield made()

    return dealt.mapInArrow(
        write, "slot bigint, sequence bigint, shard bigint, byte_offset bigint, n_tokens bigint, ids_crc32 bigint, doc_ids array<bigint>"
    )


def read(folder: str, slot: int, n: int, length: int = LENGTH, per_shard: int = PER_SHARD) -> Iterator[np.ndarray]:
    """Sequences ``slot`` .. ``slot + n - 1`` in training order: one seek per shard, then sequential reads."""
    fs, path = _store(folder)
    stride = length * ID.itemsize
    while n > 0:
        with fs.open_input_file(f"{path}/shard-{slot // per_shard:08d}.bin") as shard:
            shard.seek(slot % per_shard * stride)
            for _ in range(min(n, per_shard - slot % per_shard)):
                body = shard.read(stride)
                if len(body) < stride:
                    return
                yield np.frombuffer(body, ID)
                slot, n = slot + 1, n - 1


def shard_table(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """The stored manifest of freshly written shards, and their folder in the shared one."""
    out = run_folder(spark)
    return common.stored(materialise(spark, path, out)), out
