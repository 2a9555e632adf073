"""Ranked lexical search: documents grouped by the mask of an item's terms they hold, masks judged best first.

1. One scan cuts every text into terms and keeps, per document, its number of
   terms and its counts of the items' terms; the result is written once. Numbers
   of documents and terms come from it, and so does the frequency of each item
   term, summed inside the tasks before anything is moved.
2. Every task goes through its documents in blocks. For an item, each term sets
   its bit in the masks of the documents that hold it. Documents with equal
   masks form a group; a mask's score is at most the sum, over its bits, of the
   term's weight times its best part in the block. Masks are taken in descending
   order of that bound; their documents are scored exactly, until no mask left
   can reach the item's last place. An equal bound is still looked at, because
   the smaller id wins a tie.
3. A task returns ``TOP`` rows per item at most, which meet in two steps, so that
   no task gathers the lists of all others.

Items travel in blocks of ``BLOCK_MB`` of text, one scan each, so what is
broadcast has a bound whatever the number of items; the usual table is one block.

Defined cases: null and empty texts have no terms; they count in no statistic
and are never found. An item without terms finds nothing. Rows of items that
share an id are one item with the terms of all; a null id is an id like others.
Every row of documents is ranked on its own, repeated ids too; null ids come
last among equal scores. Empty tables give no rows. Other columns do not matter.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitalgrid.llm import common

TOP = 10
#: Megabytes of item text whose terms are broadcast at once.
BLOCK_MB = 4
#: Documents whose masks a task holds at once.
BLOCK_DOCS = 8192
#: Of a term's part: SCALE * tf / (STEP * tf + RATE * m).
SCALE, STEP, RATE = 1_000_000_000, 1000, 8
#: Of a document's m: percentage that follows its length.
LENGTH = 90

#: Bytes that separate terms become blanks, A-Z become a-z, all beyond ASCII stays.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


class Items:
    """Distinct terms of some items, numbered, and the numbers of each item's terms."""

    def __init__(self, rows: list[tuple[str | None, bytes]]):
        held: dict[str | None, set[bytes]] = {}
        for item, text in rows:
            held.setdefault(item, set()).update(terms_of(text))
        self.number = {t: i for i, t in enumerate(sorted(set().union(*held.values())))}
        self.names = list(held)
        self.terms = [np.array(sorted(self.number[t] for t in held[n]), np.int64) for n in self.names]


def item_blocks(items: DataFrame, item_id: str = "item_id", text: str = "text") -> Iterator[Items]:
    """The items in blocks of about ``BLOCK_MB``; one block is on the driver at a time."""
    rows = items.select(F.col(item_id).cast("string").alias("item"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0)).alias("n")).first()["n"]
    count = max(1, math.ceil(total * 1.25 / (BLOCK_MB * 2**20)))
    for k in range(count):
        part = rows if count == 1 else rows.filter(F.pmod(F.xxhash64("item"), F.lit(count)) == k)
        yield Items([(r["item"], bytes(r["text"])) for r in part.collect()])


def counted(docs: DataFrame, items: Items) -> DataFrame:
    """``doc_id, n, terms, tfs`` per row: all terms, and the items' terms with their counts (32-bit arrays)."""
    shared = docs.sparkSession.sparkContext.broadcast(items.number)

    def work(batch: list[bytes], _) -> dict:
        number, lengths, terms, tfs = shared.value, [], [], []
        for text in batch:
            words = terms_of(text)
            count = Counter(words)
            here = sorted((number[w], count[w]) for w in count.keys() & number.keys())
            lengths.append(len(words))
            terms.append(np.array([t for t, _ in here], np.uint32).tobytes())
            tfs.append(np.array([c for _, c in here], np.uint32).tobytes())
        return {"n": lengths, "terms": terms, "tfs": tfs}

    return common.over_texts(common.texts(docs), work, "n bigint, terms binary, tfs binary")


def document_frequencies(rows: DataFrame) -> DataFrame:
    """``term, df``; every task adds up its own documents first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            seen = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint32))
            if len(seen) > len(total):
                total, seen = seen, total
            total[: len(seen)] += seen
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held].astype(np.int64))], ["term", "df"])

    return rows.select("terms").mapInArrow(run, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))


class Ranking:
    """An item block's weights, and the rule that scores documents."""

    def __init__(self, items: Items, n_docs: int, n_terms: int, frequency: dict[int, int]):
        self.names, self.terms, self.n_docs, self.n_terms = items.names, items.terms, n_docs, n_terms
        df = np.array([frequency.get(t, 0) for t in range(len(items.number))], np.int64)
        self.weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)

    def parts(self, tf: np.ndarray, n: np.ndarray) -> np.ndarray:
        m = 100 - LENGTH + (LENGTH * n * self.n_docs) // max(1, self.n_terms)
        return (SCALE * tf) // (STEP * tf + RATE * m)


class Block:
    """Some documents by term: which of them hold it, and with which part of a score."""

    def __init__(self, ids: np.ndarray, unknown: np.ndarray, sizes: np.ndarray, term: np.ndarray, part: np.ndarray):
        self.ids, self.unknown, self.term, self.part = ids, unknown, term, part
        self.start = np.concatenate([[0], np.cumsum(sizes)])
        owner = np.repeat(np.arange(len(sizes)), sizes)
        order = np.argsort(term, kind="stable")
        self.known, at = np.unique(term[order], return_index=True)
        self.rows, self.ends = owner[order], np.append(at, len(order))
        self.best = np.maximum.reduceat(part[order], at) if len(order) else np.zeros(0, np.int64)

    def masks(self, terms: np.ndarray, weights: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """The distinct masks of the item's terms, best bound first: documents of each, and the bounds."""
        at = np.searchsorted(self.known, terms)
        at[at == len(self.known)] = 0
        at = at[self.known[at] == terms] if len(self.known) else at[:0]
        gain = weights[self.known[at]] * self.best[at] if len(at) else np.zeros(0, np.int64)
        words = np.zeros((max(1, -(-len(at) // 64)), len(self.ids)), np.uint64)
        for bit, k in enumerate(at.tolist()):
            # a document holds a term once here, so no row is named twice
            words[bit // 64, self.rows[self.ends[k] : self.ends[k + 1]]] |= np.uint64(1 << bit % 64)
        held = np.flatnonzero(words.any(axis=0))
        order = held[np.lexsort(words[:, held])]
        sorted_ = words[:, order]
        first = np.flatnonzero(np.concatenate([[True], (sorted_[:, 1:] != sorted_[:, :-1]).any(axis=0)])) if len(order) else held
        distinct, bounds = sorted_[:, first], np.zeros(len(first), np.int64)
        for bit, value in enumerate(gain.tolist()):
            bounds += ((distinct[bit // 64] >> np.uint64(bit % 64)) & np.uint64(1)).astype(np.int64) * value
        best_first = np.argsort(-bounds, kind="stable")
        groups = np.split(order, first[1:])
        return [groups[i] for i in best_first.tolist()], bounds[best_first]

    def scores(self, docs: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Exact scores of some documents; ``value`` has the weight of the item's terms and 0 elsewhere."""
        sizes = self.start[docs + 1] - self.start[docs]
        begin = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        at = np.arange(int(sizes.sum())) + np.repeat(self.start[docs] - begin, sizes)
        return np.add.reduceat(value[self.term[at]] * self.part[at], begin)


class Best:
    """The best documents of one item so far: scores, null flags and ids, best first."""

    def __init__(self, top: int):
        self.top, self.held = top, (np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64))

    def least(self) -> int:
        """A score below this cannot get in."""
        return int(self.held[0][-1]) if len(self.held[0]) == self.top else 1

    def add(self, score: np.ndarray, unknown: np.ndarray, ids: np.ndarray) -> None:
        found = score >= self.least()
        merged = [np.concatenate([a, b[found]]) for a, b in zip(self.held, (score, unknown, ids))]
        order = np.lexsort((merged[2], merged[1], -merged[0]))[: self.top]
        self.held = tuple(x[order] for x in merged)

    def search(self, block: Block, terms: np.ndarray, weights: np.ndarray, value: np.ndarray) -> int:
        """Take in a block's documents; returns how many masks were judged."""
        groups, bounds = block.masks(terms, weights)
        done, step = 0, 1
        while done < len(groups) and bounds[done] >= self.least():
            # a few masks at once; those that cannot get in any more are left
            upto = min(done + step, int(np.searchsorted(-bounds, -self.least(), side="right")))
            docs = np.concatenate(groups[done:upto])
            self.add(block.scores(docs, value), block.unknown[docs], block.ids[docs])
            done, step = upto, step * 4
        return done


def best_of_tasks(rows: DataFrame, ranking: Ranking, top: int = TOP) -> DataFrame:
    """``item, doc_id, score``: every task's best documents of each item."""
    shared = rows.sparkSession.sparkContext.broadcast(ranking)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule = shared.value
        best = [Best(top) for _ in rule.names]
        value = np.zeros(len(rule.weights), np.int64)

        def search(held: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(held)
            unknown = table["doc_id"].is_null().to_numpy()
            ids = table["doc_id"].fill_null(0).to_numpy()
            term = np.frombuffer(b"".join(table["terms"].to_pylist()), np.uint32).astype(np.int64)
            tf = np.frombuffer(b"".join(table["tfs"].to_pylist()), np.uint32).astype(np.int64)
            sizes = np.array([len(x) // 4 for x in table["terms"].to_pylist()], np.int64)
            block = Block(ids, unknown, sizes, term, rule.parts(tf, np.repeat(table["n"].to_numpy(), sizes)))
            for found, terms in zip(best, rule.terms):
                value[terms] = rule.weights[terms]
                found.search(block, terms, rule.weights, value)
                value[terms] = 0

        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= BLOCK_DOCS:
                search(held)
                held, n = [], 0
        if n:
            search(held)
        for name, found in zip(rule.names, best):
            score, unknown, ids = found.held
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(ids), pa.string()), pa.array(ids, mask=unknown), pa.array(score)], ["item", "doc_id", "score"]
            )

    some = rows.filter("octet_length(terms) > 0").select("doc_id", "n", "terms", "tfs")
    return some.mapInArrow(run, "item string, doc_id bigint, score bigint")


def _first(rows: DataFrame, keys: list[str], top: int) -> DataFrame:
    """The ``top`` best rows per key, with their ``rank``."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, item_id: str = "item_id") -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` best documents of every item."""
    kind, found = items.schema[item_id].dataType, None
    for block in item_blocks(items, item_id):
        rows = common.stored(counted(docs, block))
        total = rows.agg(
            F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")
        ).first()
        # as large as the item block's vocabulary
        frequency = {r["term"]: r["df"] for r in document_frequencies(rows).collect()}
        lists = best_of_tasks(rows, Ranking(block, total["docs"], total["terms"], frequency), top)
        found = lists if found is None else found.unionByName(lists)
    # lists of some tasks meet first; their number grows like the root of all
    parts = max(2, math.isqrt(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    some = _first(found.withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(parts))), ["item", "_part"], top)
    best = _first(some.drop("rank", "_part"), ["item"], top)
    return best.select(F.col("item").cast(kind).alias(item_id), F.col("rank").cast("int").alias("rank"), "doc_id", "score")
