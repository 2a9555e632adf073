"""What the text operators share: reading, stored steps, hash splits and byte-level words.

Text reaches Python as UTF-8 bytes. ``bytes.split`` and ``bytes.lower`` treat
exactly the ASCII blanks and letters the contracts name, so no text has to be
decoded to be cut into words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalgrid.operators.ordering import by_shuffle
from vitalgrid.session import run_folder

#: Rows per Arrow batch. Texts differ in length by five orders of magnitude, so
#: operators also cut batches by bytes (``blocks``).
BATCH_ROWS = 1000
#: Bytes of text that one block of a batch holds, unless a single text is longer.
BLOCK_BYTES = 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small in this session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def let_go() -> None:
    """Hand back what Arrow keeps for batches to come: a worker may stay idle while others of its executor need memory."""
    pa.default_memory_pool().release_unused()


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` to the cluster's shared folder and go on from the written copy."""
    path = run_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null ids fall into no fold."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts


def in_fold(doc_id: Column, parts: int, which: int) -> Column:
    """True where the id falls into the fold; false for a null id."""
    return F.coalesce(fold(doc_id, parts) == which, F.lit(False))


def texts(docs: DataFrame, *columns: str, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``doc_id`` and the text as bytes ``_text`` (null: empty), with ``columns`` and nothing else."""
    return docs.select(
        F.col(doc_id).cast("bigint").alias("doc_id"),
        *columns,
        F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("_text"),
    )


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Row keys (some 30 bytes each) that may be broadcast; more of them meet the rows by a shuffle.
BROADCAST_KEYS = 1_000_000


def row_key(*columns: str) -> Column:
    """64-bit hash of some columns of ``documents``: with the id it tells rows apart that repeat an id or have none."""
    return F.xxhash64(*columns)


def keyed_rows(docs: DataFrame, keys: DataFrame, columns: tuple[str, ...], how: str) -> DataFrame:
    """``docs`` joined (left_semi or left_anti) to the written ``keys``: ``doc_id`` and ``row_key`` of ``columns``; null ids count.

    Texts are moved only if the keys are too many to be broadcast.
    """
    found = keys.select(F.col("doc_id").alias("_a"), F.col("row_key").alias("_b")).distinct()
    found = F.broadcast(found) if keys.count() <= BROADCAST_KEYS else by_shuffle(found)
    key = row_key(*[F.col(f"rows.`{c}`") for c in columns])
    same = F.col("rows.doc_id").cast("bigint").eqNullSafe(F.col("keys._a")) & (key == F.col("keys._b"))
    return docs.alias("rows").join(found.alias("keys"), same, how)


def blocks(sizes: np.ndarray, limit: int) -> Iterator[slice]:
    """Consecutive slices whose sizes add up to ``limit`` at most, or that hold one item."""
    start = total = 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and total + size > limit:
            yield slice(start, i)
            start, total = i, 0
        total += size
    if len(sizes) > start:
        yield slice(start, len(sizes))


def over_texts(
    df: DataFrame, work: Callable[[list[bytes], pa.RecordBatch], dict[str, pa.Array | np.ndarray | list]], schema: str,
    keep: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """Apply ``work`` to blocks of texts; its columns follow the kept ones, one row per row.

    ``df`` comes from ``texts``. ``work`` gets the block's texts and the block.
    """
    from pyspark.sql.types import _parse_datatype_string

    small_batches(df.sparkSession)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    kept = ", ".join(f"`{c}` {kinds[c].simpleString()}" for c in keep)
    out = f"{kept}, {schema}" if keep else schema
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(_parse_datatype_string(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("_text"))
            sizes = np.diff(np.asarray(column.cast(pa.large_binary()).buffers()[1]).view(np.int64)[column.offset : column.offset + len(column) + 1]) if len(column) else np.zeros(0, int)
            for cut in blocks(sizes, BLOCK_BYTES):
                part = batch.slice(cut.start, cut.stop - cut.start)
                made = work(column.slice(cut.start, cut.stop - cut.start).to_pylist(), part)
                made = {c: part.column(part.schema.get_field_index(c)) for c in keep} | made
                yield pa.RecordBatch.from_arrays(
                    [_as(made[f.name], f.type) for f in target], schema=target
                )
        batch = column = part = made = None
        let_go()

    return df.mapInArrow(run, out)


def _as(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.Array):
        return values.cast(kind)
    return pa.array(values, type=kind)


class Cache(dict):
    """word -> value, worked out once; forgets everything when it holds ``limit`` words."""

    def __init__(self, value: Callable[[bytes], int], limit: int = 200_000):
        super().__init__()
        self.value, self.limit = value, limit

    def __missing__(self, word: bytes):
        if len(self) >= self.limit:
            self.clear()
        self[word] = found = self.value(word)
        return found


#: Per Python worker: hashes of words, kept from batch to batch; few, because a hash costs little and memory counts.
_HASHES = Cache(xxhash.xxh3_64_intdigest, 50_000)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hash of every word."""
    return np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all bits (a bijection)."""
    x = x.astype(np.uint64, copy=True)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(factor)
    x ^= x >> np.uint64(31)
    return x


_STEP = 0x9E3779B97F4A7C15


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive words; empty where there are fewer."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total, factor = np.zeros(n, np.uint64), 1
    for i in range(width):
        total += hashes[i : i + n] * np.uint64(factor)
        factor = factor * _STEP % 2**64
    return mixed(total)


def joined_bytes(items: list[str]) -> bytes:
    return ",".join(items).encode()
