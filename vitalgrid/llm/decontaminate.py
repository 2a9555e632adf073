"""Benchmark decontamination: windows of test items in a broadcast hash set, scanned over all texts.

Words are runs of a-z, 0-9 and characters beyond ASCII, after lower-casing A-Z.
A window is WIDTH consecutive words of an item, or all of a shorter item. Every
text's words become 64-bit hashes; runs of them are looked up in the sorted
window hashes, and a hit counts only after the words themselves are compared.

The benchmark travels in blocks of ``BLOCK_MB`` at most, each with its own scan,
so what is broadcast has a bound whatever the table's size; the usual benchmark
is one block. Hits of several blocks meet by a shuffle on the document.

Defined cases: null and empty texts have no words, are never contaminated, and
null or empty items have no window. Repeated items are all reported; an item
with a null id is searched for but not named. Every row of documents gives one
row, repeated ids too.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalgrid.llm import common
from vitalgrid.operators.ordering import by_shuffle

WIDTH = 13
#: A text is contaminated if at least one in SHARE of its words is hit.
SHARE = 20
#: Megabytes of item text in one broadcast.
BLOCK_MB = 32

#: After ASCII lower-casing: everything else that is ASCII separates words.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: bytes) -> list[bytes]:
    return _WORD.findall(text.lower())


class Windows:
    """All windows of some items: sorted hashes per width, and each hash's windows for verification."""

    def __init__(self, items: list[tuple[str | None, bytes]]):
        held: dict[int, dict[int, dict[tuple, set]]] = defaultdict(lambda: defaultdict(lambda: defaultdict(set)))
        for item, text in items:
            words = words_of(text)
            width = min(WIDTH, len(words))
            if width:
                for i, h in enumerate(common.windows(common.word_hashes(words), width).tolist()):
                    held[width][h][tuple(words[i : i + width])].add(item)
        self.held = {w: {h: dict(v) for h, v in of.items()} for w, of in held.items()}
        self.sorted = {w: np.array(sorted(of), np.uint64) for w, of in self.held.items()}

    def hits(self, words: list[bytes]) -> Iterator[tuple[int, int, set]]:
        """(first word, width, items) of every verified window of the text."""
        if not words:
            return
        hashes = common.word_hashes(words)
        for width, known in self.sorted.items():
            seen = common.windows(hashes, width)
            if not len(seen):
                continue
            at = np.searchsorted(known, seen)
            at[at == len(known)] = 0
            for i in np.flatnonzero(known[at] == seen).tolist():
                items = self.held[width][int(seen[i])].get(tuple(words[i : i + width]))
                if items:
                    yield i, width, items


def item_blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> list[list[tuple[str | None, bytes]]]:
    """The items in blocks of ``BLOCK_MB``; one block is on the driver at a time."""
    items = benchmark.select(
        F.col(item_id).cast("string").alias("item"), F.coalesce(F.col(text).cast("binary"), F.lit(b"")).alias("text")
    )
    total = items.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0)).alias("n")).first()["n"]
    count = max(1, math.ceil(total * 1.25 / (BLOCK_MB * 2**20)))
    for k in range(count):
        part = items if count == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == k)
        yield [(r["item"], bytes(r["text"])) for r in part.collect()]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [tuple(x) for x in out]


_SCHEMA = "n_words bigint, spans array<struct<start:bigint,end:bigint>>, items array<string>"


def _scan(rows: DataFrame, items: list[tuple[str | None, bytes]], keep: tuple[str, ...]) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(Windows(items))

    def work(batch: list[bytes], _) -> dict:
        counts, spans, found = [], [], []
        for text in batch:
            words = words_of(text)
            here, names = [], set()
            for i, width, items in shared.value.hits(words):
                here.append((i, i + width))
                names |= items
            counts.append(len(words))
            spans.append([{"start": a, "end": b} for a, b in _merged(here)])
            found.append(sorted(n for n in names if n is not None))
        return {"n_words": counts, "spans": spans, "items": found}

    return common.over_texts(rows, work, _SCHEMA, keep=keep)


def scanned(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, n_words, spans, items`` per row: hit word ranges (merged) and the items found."""
    return _scanned(docs, benchmark, ("doc_id",))


def _scanned(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    parts = item_blocks(benchmark)
    rows = common.texts(docs, common.row_key("text").alias("row_key"))
    first = next(parts)
    second = next(parts, None)
    if second is None:
        return _scan(rows, first, keep)
    # several blocks: rows are told apart by their own text and id, equal rows have equal hits
    wide = tuple(dict.fromkeys(("doc_id", "_text", *keep)))
    key = F.struct("doc_id", F.sha2("_text", 256)).alias("_k")
    # the first block's scan also brings the words of every row
    start = common.stored(_scan(rows, first, wide).select(key, *keep, "n_words", "spans", "items"))
    found = start.select("_k", "spans", "items")
    for items in chain([second], parts):
        found = found.unionByName(_scan(rows, items, wide).select(key, "spans", "items"))
    hits = found.filter("size(spans) > 0").groupBy("_k").agg(
        F.flatten(F.collect_set("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items")
    )
    plain = start.drop("spans", "items")
    return plain.join(by_shuffle(hits), "_k", "left").select(
        *keep, "n_words", _joined_spans(F.col("spans")).alias("spans"),
        F.array_sort(F.coalesce("items", F.array().cast("array<string>"))).alias("items"),
    )


_SPANS = "array<struct<start:bigint,end:bigint>>"


def _joined_spans(spans: Column) -> Column:
    """Spans in order, those that touch as one."""
    def add(out: Column, s: Column) -> Column:
        last = F.get(out, F.size(out) - 1)  # null while there is none
        grown = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        touches = F.coalesce(s["start"] <= last["end"], F.lit(False))
        return F.when(touches, F.concat(F.slice(out, 1, F.size(out) - 1), F.array(grown))).otherwise(F.array_append(out, s))

    return F.aggregate(F.array_sort(F.coalesce(spans, F.array().cast(_SPANS))), F.array().cast(_SPANS), add)


def _reported(rows: DataFrame, *columns: str) -> DataFrame:
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return rows.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        *columns,
    ).withColumn("contaminated", (F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words")))


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Words, hit words, items (count and digest) and the verdict of every row."""
    return _reported(scanned(docs, benchmark))


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not contaminated.

    A verdict follows from the text, so rows are told apart by text and id: a row
    goes exactly if its own text is contaminated, whatever its id, null or repeated.
    """
    judged = _reported(_scanned(docs, benchmark, ("doc_id", "row_key")), "row_key")
    gone = common.stored(judged.filter("contaminated").select("doc_id", "row_key"))
    return common.keyed_rows(docs, gone, ("text",), "left_anti")


def without_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, text`` with the hit words of every text cut out; blanks around them stay."""
    def work(batch: list[bytes], rows) -> dict:
        out = []
        for text, spans in zip(batch, rows.column(rows.schema.get_field_index("spans")).to_pylist()):
            at = [m.span() for m in _WORD.finditer(text.lower())] if spans else []
            for span in reversed(spans):
                text = text[: at[span["start"]][0]] + text[at[span["end"] - 1][1] :]
            out.append(text.decode(errors="replace"))
        return {"text": out}

    return common.over_texts(_scanned(docs, benchmark, ("doc_id", "_text")), work, "text string")


def digest(items: list[str]) -> str:
    """The contract's digest of item ids."""
    return hashlib.sha256(common.joined_bytes(sorted(items))).hexdigest()
