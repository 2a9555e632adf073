"""Best-fit packing by a grouping genetic algorithm on islands.

Documents become token ids and one end id; only longer ones are cut, into pieces
of the sequence length. Pieces are dealt to blocks of about ``BLOCK`` by a hash,
so a block's work and memory do not grow with the table, and each block loses
less than one sequence. A block is solved by ``ISLANDS`` populations of whole
packings. An epoch breeds on every island by itself; then each island sends its
best packing to the next one (a join on block and island), and the next epoch
begins. The block's best packing is the result.

A packing is a list of groups (sequences). Crossover takes the best-filled
groups of one parent whole, keeps the other parent's groups that have no piece
in common with them, and puts the displaced pieces back by best fit, longest
first. Mutation opens the worst-filled groups. The first packings come from best
fit over the pieces from long to short, with some noise in the order.

Defined cases: null and empty texts are one piece of the end id alone. Repeated
rows are packed as often as they occur; a null id is packed like any other.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgrid.llm import common
from vitalgrid.llm.encoding import decoded, encoder, tokenizer_path
from vitalgrid.operators.ordering import by_shuffle

FILE = "word_bpe_49k.json"
LENGTH = 2048
END_ID = 0
#: Pieces of a block, on average.
BLOCK = 8192
ISLANDS, EPOCHS = 2, 2
POPULATION, CHILDREN = 4, 6


def document_ids(text: bytes, file: str = FILE) -> bytes:
    """Little-endian 32-bit ids of a text, with the end id."""
    return encoder(tokenizer_path(file), lead=False).ids(decoded(text)) + np.uint32(END_ID).tobytes()


def pieces(docs: DataFrame, file: str = FILE, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` of every piece; ``with_ids`` adds the ids."""
    common.small_batches(docs.sparkSession)
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            sizes = np.array([len(t) for t in texts.to_pylist()], np.int64)
            for cut in common.blocks(sizes, common.BLOCK_BYTES):
                rows: list[tuple] = []
                for doc, text in zip(
                    batch.column(0).slice(cut.start, cut.stop - cut.start).to_pylist(),
                    texts.slice(cut.start, cut.stop - cut.start).to_pylist(),
                ):
                    ids = document_ids(text, file)
                    for k in range(0, len(ids), 4 * length):
                        part = ids[k : k + 4 * length]
                        row = (doc, k // (4 * length), k // 4, len(part) // 4, zlib.crc32(part))
                        rows.append((*row, part) if with_ids else row)
                columns = list(zip(*rows))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * with_ids
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds)],
                    ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids,
                )
        batch = texts = rows = columns = None
        common.let_go()

    return common.texts(docs).mapInArrow(run, schema)


class Bins:
    """Open groups by free room; the tightest one that fits is found through a bit mask."""

    def __init__(self, capacity: int):
        self.capacity, self.rooms, self.mask = capacity, [[] for _ in range(capacity + 1)], 0
        self.groups: list[list[int]] = []

    def add(self, items: list[int], filled: int) -> None:
        self._file(len(self.groups), self.capacity - filled)
        self.groups.append(items)

    def _file(self, group: int, room: int) -> None:
        self.rooms[room].append(group)
        self.mask |= 1 << room

    def fit(self, item: int, size: int) -> None:
        fitting = self.mask >> size
        if not fitting:
            self.add([item], size)
            return
        room = size + (fitting & -fitting).bit_length() - 1
        held = self.rooms[room]
        group = held.pop()
        if not held:
            self.mask &= ~(1 << room)
        self.groups[group].append(item)
        self._file(group, room - size)


def _best_fit(order: np.ndarray, sizes: list[int], capacity: int, kept: list[list[int]] = ()) -> list[list[int]]:
    bins = Bins(capacity)
    for group in kept:
        bins.add(list(group), sum(sizes[i] for i in group))
    for item in order.tolist():
        bins.fit(item, sizes[item])
    return bins.groups


def _fills(groups: list[list[int]], sizes: np.ndarray) -> np.ndarray:
    flat = np.fromiter((i for g in groups for i in g), np.int64)
    return np.add.reduceat(sizes[flat], np.concatenate([[0], np.cumsum([len(g) for g in groups])[:-1]])) if groups else np.zeros(0)


def _worth(groups: list[list[int]], sizes: np.ndarray, capacity: int) -> float:
    """Fewer groups first; then uneven filling, which leaves room together."""
    fills = _fills(groups, sizes) / capacity
    return -len(groups) + float((fills**2).mean()) if groups else 0.0


def _refit(kept: list[list[int]], n: int, sizes: np.ndarray, listed: list[int], capacity: int) -> list[list[int]]:
    missing = np.ones(n, bool)
    for group in kept:
        missing[group] = False
    left = np.flatnonzero(missing)
    return _best_fit(left[np.argsort(-sizes[left], kind="stable")], listed, capacity, kept)


def _crossed(a: list, b: list, sizes: np.ndarray, listed: list[int], capacity: int, rng) -> list[list[int]]:
    fills = _fills(a, sizes)
    best = np.argsort(-fills, kind="stable")[: max(1, int(len(a) * rng.uniform(0.3, 0.8)))]
    injected = [a[k] for k in best.tolist()]
    taken = np.zeros(len(sizes), bool)
    for group in injected:
        taken[group] = True
    kept = injected + [g for g in b if not taken[g].any()]
    return _refit(kept, len(sizes), sizes, listed, capacity)


def _mutated(a: list, sizes: np.ndarray, listed: list[int], capacity: int, rng) -> list[list[int]]:
    fills = _fills(a, sizes)
    opened = set(np.argsort(fills, kind="stable")[: max(2, len(a) // 50)].tolist())
    opened |= set(rng.choice(len(a), max(1, len(a) // 100)).tolist())
    return _refit([g for k, g in enumerate(a) if k not in opened], len(sizes), sizes, listed, capacity)


def evolve(sizes: np.ndarray, capacity: int, seed: list[int], known: list[np.ndarray] = ()) -> np.ndarray:
    """Group of every item in the best packing found; ``known`` packings join the first population."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    rng = np.random.default_rng(seed)
    listed = sizes.tolist()
    people = [_groups(k) for k in known]
    while len(people) < POPULATION:
        noise = rng.uniform(0, 0.05 * len(people), len(sizes)) * capacity
        people.append(_best_fit(np.argsort(-(sizes + noise), kind="stable"), listed, capacity))
    bound = -(-int(sizes.sum()) // capacity)
    scored = sorted(((_worth(p, sizes, capacity), k, p) for k, p in enumerate(people)), reverse=True)
    for born in range(CHILDREN):
        if len(scored[0][2]) <= bound:
            break  # no packing has fewer
        i, j = rng.choice(len(scored), 2, replace=False)
        child = _crossed(scored[i][2], scored[j][2], sizes, listed, capacity, rng)
        if born % 2:
            child = _mutated(child, sizes, listed, capacity, rng)
        scored.append((_worth(child, sizes, capacity), POPULATION + born, child))
        scored = sorted(scored, reverse=True)[:POPULATION]
    out = np.zeros(len(sizes), np.int64)
    for k, group in enumerate(scored[0][2]):
        out[group] = k
    return out


def _groups(of: np.ndarray) -> list[list[int]]:
    order = np.argsort(of, kind="stable")
    return [part.tolist() for part in np.split(order, np.flatnonzero(np.diff(of[order])) + 1)]


def _epoch(rows: DataFrame, capacity: int, epoch: int) -> DataFrame:
    """Breed on every island: ``block, island, lengths, packings`` -> ``block, island, packing``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                known = [np.array(p, np.int64) for p in row["packings"] or []]
                best = evolve(np.array(row["lengths"], np.int64), capacity, [row["block"], row["island"], epoch], known)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["block"]]), pa.array([row["island"]], pa.int32()), pa.array([best.tolist()], pa.list_(pa.int32()))],
                    ["block", "island", "packing"],
                )

    return rows.mapInArrow(run, "block bigint, island int, packing array<int>")


def packed(made: DataFrame, capacity: int = LENGTH) -> DataFrame:
    """``made`` (from ``pieces``) with ``sequence_id`` and ``offset`` for every piece."""
    made = common.stored(made)
    total = made.count()
    blocks = max(1, -(-total // BLOCK))
    # filled pieces are sequences by themselves, but go with their block to get a number
    one = F.struct("length", "doc_id", "piece", "ids_crc32", "start")
    dealt = made.select(
        F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(blocks)).alias("block"), one.alias("item")
    )
    # a block holds BLOCK pieces on average, whatever the size of the table; equal rows are dealt on by position
    block_rows = common.stored(
        _levelled(dealt, blocks).groupBy("block").agg(F.sort_array(F.collect_list("item"), asc=False).alias("items"))
    )
    lengths = block_rows.select("block", F.transform("items", lambda i: i["length"].cast("int")).alias("lengths"))
    islands = lengths.select("*", F.explode(F.array(*map(F.lit, range(ISLANDS)))).alias("island"))
    # rows are few and their work is large, so the number of tasks is given: left to Spark, small rows end up in one
    tasks = min(blocks * ISLANDS, 4 * int(made.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def bred(rows: DataFrame, epoch: int) -> DataFrame:
        return common.stored(_epoch(rows.select("block", "island", "lengths", "packings").repartition(tasks, "block", "island"), capacity, epoch))

    now = bred(islands.withColumn("packings", F.lit(None).cast("array<array<int>>")), 0)
    for epoch in range(1, EPOCHS):
        sent = now.select("block", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).cast("int").alias("island"), F.col("packing").alias("guest"))
        met = islands.join(by_shuffle(now), ["block", "island"]).join(by_shuffle(sent), ["block", "island"])
        now = bred(met.withColumn("packings", F.array("packing", "guest")), epoch)
    best = now.groupBy("block").agg(F.min(F.struct(F.array_max("packing").alias("groups"), "island", "packing"))["packing"].alias("packing"))
    return _placed(block_rows.join(by_shuffle(best), "block"))


def _levelled(dealt: DataFrame, blocks: int) -> DataFrame:
    """Deal equal pieces (copies of one text under one id) over all blocks."""
    copies = dealt.groupBy("block", "item").agg(F.count("*").alias("n"))
    each = copies.select("block", "item", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("k"))
    return each.select(F.pmod(F.col("block") + F.col("k"), F.lit(blocks)).alias("block"), "item")


def _placed(rows: DataFrame) -> DataFrame:
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                items = batch.column(batch.schema.get_field_index("items")).slice(k, 1).flatten()
                group = batch.column(batch.schema.get_field_index("packing")).slice(k, 1).flatten().to_numpy().astype(np.int64)
                block = batch.column(batch.schema.get_field_index("block"))[k].as_py()
                size = items.field("length").to_numpy()
                order = np.argsort(group, kind="stable")
                before = np.cumsum(size[order]) - size[order]
                first = np.concatenate([[True], np.diff(group[order]) > 0])
                offset = np.empty(len(size), np.int64)
                offset[order] = before - np.maximum.accumulate(np.where(first, before, 0))
                yield pa.RecordBatch.from_arrays(
                    [items.field(n) for n in names] + [pa.array(group + (block << 32)), pa.array(offset)],
                    [*names, "sequence_id", "offset"],
                )

    return rows.select("block", "items", "packing").mapInArrow(
        run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    )


def sequences(docs: DataFrame, file: str = FILE, length: int = LENGTH) -> DataFrame:
    """``sequence_id, n_tokens, ids``: the packed sequences themselves, ids as little-endian 32-bit bytes."""
    placed = common.stored(packed(pieces(docs, file, length), length))
    made = pieces(docs, file, length, with_ids=True).select("doc_id", "piece", "ids_crc32", "ids").distinct()
    key = [placed[c].eqNullSafe(made[c]) for c in ("doc_id", "piece", "ids_crc32")]
    joined = placed.join(by_shuffle(made), key).select("sequence_id", "offset", placed["length"], "ids")
    return joined.groupBy("sequence_id").agg(
        F.sum("length").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("_p")
    ).select("sequence_id", "n_tokens", F.aggregate("_p", F.lit(b""), lambda a, p: F.concat(a, p["ids"])).alias("ids"))
