"""Exact duplicates: counting quotient filters per partition, merged by sorted remainders, then byte verification.

1. Every text gets a 64-bit fingerprint and its SHA-256 (``hashed``, one scan, no text is moved).
2. Every task builds counting quotient filters of its fingerprints, one per
   range of fingerprints (shard). A filter holds the whole fingerprint: the high
   bits as quotient in two bitmaps, the rest as a remainder, and a count. So
   filters of one shard merge without loss, by sorted remainders, and a text with
   a billion copies is one entry with a large count in every filter.
3. Fingerprints that the merged filters count more than once are repeated. Only
   texts with such a fingerprint are read again, and grouped by all their bytes
   (copies add up before the shuffle). Two texts under one pair of fingerprint
   and SHA-256 would stop the run.
4. Rows learn the verified group of their fingerprint and SHA-256 by a join of
   narrow rows.

Defined cases: a null text counts as empty, and empty texts are equal to each
other. A null id is smaller than every other; a group of null ids has a null
``keep_id``. Of rows with equal id and text exactly one is kept. Every row gives
one row; an empty table gives none; other columns of the input do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgrid.llm import common

BITS = 64
#: Fingerprints that a task gathers before it writes filters, and that a shard holds on average at most.
PIECE, SHARD = 1 << 20, 1 << 21
#: Shards per shuffle partition, so that partitions are about even.
SHARDS_PER_PARTITION = 4
#: Repeated fingerprints (8 bytes each) that may be broadcast; more of them meet the texts by a shuffle.
BROADCAST_KEYS = 2_000_000


def _combined(fingerprints: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different fingerprints in order, counts of equal ones added up."""
    order = np.argsort(fingerprints, kind="stable")  # sorted runs are merged, not sorted again
    fingerprints, counts = fingerprints[order], counts[order]
    if not len(fingerprints):
        return fingerprints, counts
    first = np.flatnonzero(np.concatenate([[True], fingerprints[1:] != fingerprints[:-1]]))
    return fingerprints[first], np.add.reduceat(counts, first)


@dataclass(frozen=True)
class QuotientFilter:
    """Counting quotient filter of fingerprints of ``bits`` bits.

    Entries lie in fingerprint order. ``occupied`` has a bit per quotient,
    ``ends`` a bit per entry that closes its quotient's run, ``remainders`` the
    low bits of every entry in whole bytes, ``repeated`` a bit per entry counted
    more than once, whose counts follow in ``counts``.
    """

    bits: int
    quotient_bits: int
    occupied: np.ndarray
    ends: np.ndarray
    remainders: np.ndarray
    repeated: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, fingerprints: np.ndarray, counts: np.ndarray, bits: int = BITS) -> QuotientFilter:
        """From different fingerprints in ascending order and their counts."""
        n = len(fingerprints)
        quotient_bits = min(bits, max(0, int(n - 1).bit_length() if n else 0))
        low = bits - quotient_bits
        # a shift by all 64 bits is undefined
        quotients = (fingerprints >> np.uint64(low) if low < 64 else np.zeros(n, np.uint64)).astype(np.int64)
        occupied = np.zeros(1 << quotient_bits, bool)
        occupied[quotients] = True
        ends = np.ones(n, bool)
        ends[:-1] = quotients[1:] != quotients[:-1]
        kept = fingerprints & np.uint64((1 << low) - 1)
        width = (low + 7) // 8
        remainders = kept.astype("<u8").view(np.uint8).reshape(n, 8)[:, :width]
        more = counts > 1
        return cls(bits, quotient_bits, occupied, ends, remainders, more, counts[more].astype(np.uint64))

    def entries(self) -> tuple[np.ndarray, np.ndarray]:
        """The fingerprints in order, and their counts."""
        n, low = len(self.ends), self.bits - self.quotient_bits
        run = np.concatenate([[0], np.cumsum(self.ends)[:-1]]) if n else np.zeros(0, np.int64)
        quotients = np.flatnonzero(self.occupied)[run].astype(np.uint64)
        padded = np.zeros((n, 8), np.uint8)
        padded[:, : self.remainders.shape[1]] = self.remainders
        fingerprints = padded.view("<u8").reshape(n).astype(np.uint64)
        if low < 64:
            fingerprints |= quotients << np.uint64(low)
        counts = np.ones(n, np.uint64)
        counts[self.repeated] = self.counts
        return fingerprints, counts

    def merged(self, other: QuotientFilter) -> QuotientFilter:
        """All entries of both; the quotient grows with the entries."""
        (a, n), (b, m) = self.entries(), other.entries()
        return QuotientFilter.of(*_combined(np.concatenate([a, b]), np.concatenate([n, m])), self.bits)

    def count(self, fingerprints: np.ndarray) -> np.ndarray:
        """How often each of some fingerprints was entered."""
        held, counts = self.entries()
        out = np.zeros(len(fingerprints), np.uint64)
        if len(held):
            at = np.minimum(np.searchsorted(held, fingerprints), len(held) - 1)
            hit = held[at] == fingerprints
            out[hit] = counts[at[hit]]
        return out

    def to_bytes(self) -> bytes:
        head = np.array([self.bits, self.quotient_bits, len(self.ends), len(self.counts)], "<u8")
        parts = [head, np.packbits(self.occupied), np.packbits(self.ends), self.remainders, np.packbits(self.repeated), self.counts.astype("<u8")]
        return b"".join(p.tobytes() for p in parts)

    @classmethod
    def from_bytes(cls, raw: bytes) -> QuotientFilter:
        bits, quotient_bits, n, repeats = np.frombuffer(raw, "<u8", 4).tolist()
        at = 32

        def part(size: int) -> np.ndarray:
            nonlocal at
            at += size
            return np.frombuffer(raw, np.uint8, size, at - size)

        def flags(size: int) -> np.ndarray:
            return np.unpackbits(part((size + 7) // 8), count=size).astype(bool)

        width = (bits - quotient_bits + 7) // 8
        occupied, ends = flags(1 << quotient_bits), flags(n)
        remainders = part(n * width).reshape(n, width)
        repeated = flags(n)
        return cls(bits, quotient_bits, occupied, ends, remainders, repeated, part(8 * repeats).view("<u8").astype(np.uint64))


def hashed(docs: DataFrame) -> DataFrame:
    """``doc_id, row, fingerprint, text_sha256`` of every row; ``row`` tells equal rows apart."""
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.monotonically_increasing_id().alias("row"),
        F.xxhash64(text).alias("fingerprint"),
        F.sha2(text, 256).alias("text_sha256"),
    )


def shard_bits(spark, rows: int) -> int:
    """Bits of a fingerprint that name its shard: shards follow the rows and the shuffle partitions."""
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, max(SHARDS_PER_PARTITION * partitions, rows // SHARD) - 1).bit_length()


def partition_filters(rows: DataFrame, top_bits: int) -> DataFrame:
    """``shard, filter``: the quotient filters of every task's own ``fingerprint`` column."""
    low = np.uint64(BITS - top_bits)

    def pieces(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        found, counts = np.unique(np.concatenate(held), return_counts=True)
        shards = (found >> low).astype(np.int32)
        inner = found & np.uint64((1 << int(low)) - 1)
        cuts = np.flatnonzero(np.diff(shards)) + 1
        names, filters = [], []
        for a, b in zip([0, *cuts], [*cuts, len(found)]):
            names.append(int(shards[a]))
            filters.append(QuotientFilter.of(inner[a:b], counts[a:b], int(low)).to_bytes())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(filters, pa.binary())], ["shard", "filter"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            n += batch.num_rows
            if n >= PIECE:
                yield from pieces(held)
                held, n = [], 0
        if n:
            yield from pieces(held)

    return rows.select("fingerprint").mapInArrow(run, "shard int, filter binary")


def merged_filters(filters: DataFrame) -> DataFrame:
    """``shard, filter``: one filter per shard. Filters of like size meet first, so each entry moves few times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, open_ = None, []

        def whole() -> pa.RecordBatch:
            while len(open_) > 1:
                open_.append(open_.pop().merged(open_.pop()))
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([open_.pop().to_bytes()], pa.binary())], ["shard", "filter"]
            )

        for batch in batches:
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                if name != shard:
                    if open_:
                        yield whole()
                    shard = name
                open_.append(QuotientFilter.from_bytes(raw.as_py()))
                while len(open_) > 1 and len(open_[-2].ends) <= len(open_[-1].ends):
                    open_.append(open_.pop().merged(open_.pop()))
        if open_:
            yield whole()

    common.small_batches(filters.sparkSession)
    count = int(filters.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = filters.repartition(count, "shard").sortWithinPartitions("shard")
    return dealt.mapInArrow(run, "shard int, filter binary")


def repeated_fingerprints(merged: DataFrame, top_bits: int) -> DataFrame:
    """``fingerprint, n`` counted more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                inner, counts = QuotientFilter.from_bytes(raw.as_py()).entries()
                found = (inner | np.uint64(shard << (BITS - top_bits)))[counts > 1].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(counts[counts > 1].astype(np.int64))], ["fingerprint", "n"])

    return merged.mapInArrow(run, "fingerprint bigint, n bigint")


def _among(rows: DataFrame, repeated: DataFrame, keys: int) -> DataFrame:
    """``rows`` with a repeated fingerprint; the keys are broadcast only while they are few."""
    few = repeated.select("fingerprint")
    return rows.join(F.broadcast(few) if keys <= BROADCAST_KEYS else few, "fingerprint", "left_semi")


def verified_texts(docs: DataFrame, repeated: DataFrame, keys: int) -> DataFrame:
    """``fingerprint, text_sha256, n`` of every text that occurs under a repeated fingerprint, compared byte by byte."""
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = _among(docs.select(F.xxhash64(text).alias("fingerprint"), text.alias("_text")), repeated, keys)
    same = rows.groupBy("fingerprint", "_text").agg(F.count("*").alias("n"))
    per_digest = same.select("fingerprint", F.sha2("_text", 256).alias("text_sha256"), "n").groupBy("fingerprint", "text_sha256").agg(
        F.count("*").alias("texts"), F.sum("n").alias("n")
    )
    differ = F.raise_error(F.lit("different texts under one fingerprint and digest")).cast("bigint")
    return per_digest.select("fingerprint", "text_sha256", F.when(F.col("texts") == 1, F.col("n")).otherwise(differ).alias("n"))


def _marked(docs: DataFrame) -> DataFrame:
    rows = common.stored(hashed(docs))
    bits = shard_bits(docs.sparkSession, rows.count())
    filters = common.stored(merged_filters(partition_filters(rows, bits)))
    repeated = common.stored(repeated_fingerprints(filters, bits))
    keys = repeated.count()
    verified = verified_texts(docs, repeated, keys)
    # the largest id, null below all; of equal rows the first
    last = F.max(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", (-F.col("row")).alias("turned")))
    members = _among(rows, repeated, keys).groupBy("fingerprint", "text_sha256").agg(last.alias("last"))
    groups = common.stored(
        members.join(verified, ["fingerprint", "text_sha256"]).select(
            "fingerprint", "text_sha256", "n", F.col("last.doc_id").alias("last_id"), (-F.col("last.turned")).alias("last_row")
        )
    )
    marked = rows.join(groups, ["fingerprint", "text_sha256"], "left")
    in_group = F.col("n").isNotNull()
    return marked.select(
        "doc_id",
        "row",
        F.when(in_group, F.col("last_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("bigint")).alias("group_size"),
        F.coalesce(F.col("row") == F.col("last_row"), F.lit(True)).alias("kept"),
        "text_sha256",
    )


def exact_groups(docs: DataFrame) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row of ``docs``."""
    return _marked(docs).drop("row")


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows that stay, with the columns of ``docs``; of rows with equal id and text, any one.

    Texts are moved only for ids that repeat one text; others meet the kept ids by key.
    """
    owner, digest = common.fresh(docs, "_owner"), common.fresh(docs, "_digest")
    stays = common.stored(
        exact_groups(docs).groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("stays"), F.count("*").alias("rows")).filter("stays")
    )
    rows = docs.withColumns(
        {owner: F.col("doc_id").cast("bigint"), digest: F.sha2(F.coalesce(F.col("text").cast("binary"), F.lit(b"")), 256)}
    )

    def among(some: DataFrame) -> DataFrame:
        keys = some.select(F.col("doc_id").alias("_a"), F.col("text_sha256").alias("_b")).alias("keys")
        same = F.col(f"rows.{owner}").eqNullSafe(F.col("keys._a")) & (F.col(f"rows.{digest}") == F.col("keys._b"))
        return rows.alias("rows").join(keys, same, "left_semi")

    single, several = among(stays.filter("rows = 1")), among(stays.filter("rows > 1")).dropDuplicates([owner, digest])
    return single.unionByName(several).select(*docs.columns)
