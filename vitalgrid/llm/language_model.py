"""LM scoring: a gated recurrent word model with a class-factored output.

P(word | history) = P(class | state) * P(word | class, state). The ``HEAD`` most
frequent words of the training texts are dealt to classes of equal size by
frequency, and the network learns a distribution within each. All other words
belong to ``TAIL`` classes by their last three bytes; within those the share is
(c + 1) / (N + V + 1) from exact counts over all training texts, with one share
for all unseen words of the class, so that everything adds up to one.

Training: counts of every word of every training text are added up by Spark. Then
every text is cut and looked up once, and its words' codes are written. The
network starts from a fit on the driver to at most ``WARM`` texts (smallest hash
of the id). Then every task goes on from it by truncated backpropagation over
all training texts it reads, and the weights are averaged by words seen, part by
part, in two rounds of grouping so that no group grows with the cluster.

Scoring: whole texts run through the network side by side; a text's state is
carried from window to window until its end. Frequent words' counts (``NEAR``
words, a bounded table of hashes) are at hand in every task; the rest are looked
up by a join on the word's 64-bit hash.

Defined cases: null and empty texts are one end token. Rows with null ids are
training texts (they fall into no fold); rows with equal id and text get equal
scores. Without training texts every token is unseen.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalgrid.llm import common
from vitalgrid.llm.recurrent import Adam, Layer, added_rows
from vitalgrid.operators.ordering import by_shuffle

FOLDS, HELD_OUT = 7, 2
CLASS_WORDS, HEAD_CLASSES, TAIL = 64, 48, 64
HEAD = CLASS_WORDS * HEAD_CLASSES
NEAR = 150_000
UNITS, STEPS, LANES = 16, 24, 384
RATE, WARM, WARM_PASSES = 0.01, 600, 2
#: Different words that a task counts before it hands counts on.
FLUSH = 300_000
#: Bytes of codes (four a word) that are scored side by side, and bytes of text whose words are looked up together.
SCORE_BYTES, LOOK_BYTES = 8_000_000, 1_000_000
#: Words whose codes a task keeps.
KNOWN_CODES = 300_000
#: States that are scored together (their class scores stay in a core's cache), and that are learned from together.
OUTPUT_ROWS, LEARN_ROWS = 512, STEPS * LANES
#: Scores below this in size need no shift before the exponential of 32 bits.
SAFE_SCORE = 60.0
#: The end token's key; words are never empty.
END = b""


def words_of(text: bytes) -> list[bytes]:
    """Words of the lower-cased text, then the end token."""
    return [*text.lower().split(), END]


def tail_class(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % TAIL


def tail_classes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, [w[-3:] for w in words]), np.int64, len(words)) % TAIL


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def _signed(h: int) -> int:
    return h - 2**64 if h >= 2**63 else h


# --- counts ------------------------------------------------------------------


def counted(docs: DataFrame) -> DataFrame:
    """``h, cls, c``: hash, tail class and count of every word of the training texts, ends included."""
    common.small_batches(docs.sparkSession)

    def made(counts: Counter) -> pa.RecordBatch:
        words = list(counts)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(word_hashes(words).view(np.int64)),
                pa.array(tail_classes(words), pa.int32()),
                pa.array(list(counts.values()), pa.int64()),
            ],
            ["h", "cls", "c"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(words_of(text))
                if len(counts) > FLUSH:
                    yield made(counts)
                    counts.clear()
        if counts:
            yield made(counts)

    partial = training(docs).select("_text").mapInArrow(run, "h bigint, cls int, c bigint")
    return partial.groupBy("h", "cls").agg(F.sum("c").alias("c"))


def training(docs: DataFrame) -> DataFrame:
    return common.texts(docs).filter(~common.in_fold(F.col("doc_id"), FOLDS, HELD_OUT))


class Vocabulary:
    """Head words by hash, near counts, and the totals of the tail classes."""

    def __init__(self, near: list[tuple[int, int]], total: int, distinct: int, tail: dict[int, tuple[int, int]]):
        """``near``: (hash, count), most frequent first; ``tail``: class -> (N, V) over words beyond the head."""
        self.hashes = np.array([h for h, _ in near], np.int64).view(np.uint64)
        self.near_counts = np.array([-1, *(c for _, c in near)], np.int64)
        self.near_logs = np.log10(np.maximum(self.near_counts, 0) + 1.0)
        self.total, self.distinct = total, distinct
        both = np.array([tail.get(k, (0, 0)) for k in range(TAIL)], np.float64)
        self.tail_room = np.log10(both.sum(axis=1) + 1)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("codes", "sorted", "ranks")}

    def _codes(self, words: list[bytes]) -> np.ndarray:
        hashes = word_hashes(words)
        place = np.full(len(words), -1, np.int64)
        if len(self.sorted):
            at = np.minimum(np.searchsorted(self.sorted, hashes), len(self.sorted) - 1)
            place = np.where(self.sorted[at] == hashes, self.ranks[at], -1)
        code = (place + 1) * TAIL
        tail = np.flatnonzero((place < 0) | (place >= HEAD))
        code[tail] += tail_classes([words[i] for i in tail.tolist()])
        return code

    def encode(self, words: list[bytes]) -> np.ndarray:
        """A code per word: its place among the near words from 1 (0: not near) times TAIL, and its tail class beyond the head."""
        if not hasattr(self, "codes"):
            self.ranks = np.argsort(self.hashes, kind="stable")
            self.sorted, self.codes = self.hashes[self.ranks], {}
        code = np.fromiter(map(self.codes.get, words, repeat(-1)), np.int32, len(words))
        missing = np.flatnonzero(code < 0).tolist()
        if missing:
            # every word that is not at hand is worked out once, all of them together
            new = list({words[i] for i in missing})
            fresh = dict(zip(new, self._codes(new).tolist()))
            code[missing] = [fresh[words[i]] for i in missing]
            if len(self.codes) + len(fresh) > KNOWN_CODES:
                self.codes.clear()
            if len(fresh) <= KNOWN_CODES:
                self.codes.update(fresh)
        return code

    def look_up(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Symbol (head word or HEAD + tail class) and count (-1: not near) of every word."""
        code = self.encode(words)
        return symbols_of(code), self.near_counts[code // TAIL]


def symbols_of(codes: np.ndarray) -> np.ndarray:
    place = codes // TAIL - 1
    return np.where((place >= 0) & (place < HEAD), place, HEAD + codes % TAIL).astype(np.int64)


def encoded(docs: DataFrame, vocabulary_: Vocabulary) -> DataFrame:
    """Per row: hash of the text, the sums that follow from counts at hand, hashes of words beyond those, and the words' codes.

    Training and scoring both read the codes, so a text is cut and looked up once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary_)
    common.small_batches(docs.sparkSession)
    schema = "doc_id bigint, key bigint, n_tokens bigint, n_near bigint, near_sum double, tail_near double, room double, far array<bigint>, codes binary"

    def looked_up(ids: pa.Array, texts: list[bytes]) -> pa.RecordBatch:
        known = shared.value
        words, begins = [], []
        for text in texts:
            begins.append(len(words))
            words += words_of(text)
        code = known.encode(words)
        symbol, place = symbols_of(code), code // TAIL
        tail, logs = symbol >= HEAD, known.near_logs[place]
        room = np.where(tail, known.tail_room[np.where(tail, symbol - HEAD, 0)], 0.0)
        ends = np.array([*begins, len(words)], np.int64)
        # every text has its end token, so no sum is over nothing
        near, near_sum, tail_near, rooms = (
            np.add.reduceat(x, begins) for x in ((place > 0).astype(np.int64), logs, np.where(tail, logs, 0.0), room)
        )
        n = np.diff(ends)
        far = pa.array(word_hashes([words[i] for i in np.flatnonzero(place == 0).tolist()]).view(np.int64))
        offsets = pa.array(np.concatenate([[0], np.cumsum(n - near)]), pa.int32())
        body = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((ends * 4).astype(np.int32)), pa.py_buffer(code)])
        return pa.RecordBatch.from_arrays(
            [
                ids, pa.array(word_hashes(texts).view(np.int64)), pa.array(n), pa.array(near), pa.array(near_sum), pa.array(tail_near),
                pa.array(rooms), pa.ListArray.from_arrays(offsets, far), body,
            ],
            ["doc_id", "key", "n_tokens", "n_near", "near_sum", "tail_near", "room", "far", "codes"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in common.blocks(np.array([len(t) for t in texts], np.int64), LOOK_BYTES):
                yield looked_up(batch.column(0).slice(part.start, part.stop - part.start), texts[part])

    return common.texts(docs).mapInArrow(run, schema)


def _nearest(counts: DataFrame) -> list[tuple[int, int]]:
    """Up to NEAR words as (hash, count), most frequent first.

    Words are binned by the logarithm of their count; whole bins are taken from
    the top while they fit, so no task hands more on than belongs to the table.
    """
    binned = counts.withColumn("bin", F.floor(F.log2("c") * 64).cast("int"))
    least, taken = None, 0
    # some 4,000 bins at the most: counts are below 2 ** 63
    for row in sorted(binned.groupBy("bin").count().collect(), key=lambda r: -r["bin"]):
        taken += row["count"]
        if taken > NEAR:
            break
        least = row["bin"]
    if least is None:
        # not even the first bin fits: as many words as the network has places for
        rows = counts.orderBy(F.desc("c"), "h").limit(HEAD)
    else:
        rows = binned.filter(F.col("bin") >= least)
    return sorted(((r["h"], r["c"]) for r in rows.select("h", "c").collect()), key=lambda x: (-x[1], x[0]))


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The driver gets NEAR rows at most and one per tail class."""
    near = _nearest(counts)
    sums = {r["cls"]: (r["n"], r["v"]) for r in counts.groupBy("cls").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    total, distinct = (sum(x[k] for x in sums.values()) for k in (0, 1))
    if near:
        head = counts.sparkSession.createDataFrame(near[:HEAD], "h bigint, c bigint")
        # HEAD rows at most
        for r in counts.join(F.broadcast(head.select("h")), "h").groupBy("cls").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():
            n, v = sums[r["cls"]]
            sums[r["cls"]] = (n - r["n"], v - r["v"])
    return Vocabulary(near, total, distinct, sums)


# --- network -----------------------------------------------------------------


def _with_bias(w: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, bool]:
    """Weights with their biases as last column, and whether no score of a state within -1..1 needs a shift."""
    whole = np.concatenate([w, b[..., None]], axis=-1)
    return whole, bool(np.abs(whole).sum(axis=-1).max() < SAFE_SCORE)


def _room(held: list[np.ndarray], rows: int, columns: int) -> np.ndarray:
    """An array for scores in memory that is taken once."""
    if held[0].size < rows * columns:
        held[0] = np.empty(rows * columns, np.float32)
    return held[0][: rows * columns].reshape(rows, columns)


def _exps(weights: np.ndarray, states: np.ndarray, chosen: np.ndarray, safe: bool, held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per column of ``states``: exponentials of the scores, their sums, and the log share of what was chosen."""
    p = np.matmul(weights, states, out=_room(held, len(weights), states.shape[1]))
    if not safe:
        p -= p.max()  # one bound for all: states lie within -1..1, so columns differ little
    lp = p[chosen, np.arange(len(chosen))]
    np.exp(p, out=p)
    sums = p.sum(axis=0)
    lp -= np.log(sums)
    return p, sums, lp


class Network:
    """Input rows per symbol, the recurrent weights, class weights and word weights per head class."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.held = [np.empty(0, np.float32)]
        small = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.x = small(HEAD + TAIL, 2 * UNITS, scale=0.2)
        self.u = small(UNITS, 2 * UNITS, scale=0.2)
        self.cw, self.cb = small(HEAD_CLASSES + TAIL, UNITS, scale=0.1), np.zeros(HEAD_CLASSES + TAIL, np.float32)
        self.ww = small(HEAD_CLASSES, CLASS_WORDS, UNITS, scale=0.1)
        self.wb = np.zeros((HEAD_CLASSES, CLASS_WORDS), np.float32)

    def arrays(self) -> list[np.ndarray]:
        return [self.x, self.u, self.cw, self.cb, self.ww, self.wb]

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self.arrays()])

    @classmethod
    def of(cls, flat: np.ndarray) -> Network:
        net, at = cls(), 0
        for a in net.arrays():
            a[...] = flat[at : at + a.size].reshape(a.shape)
            at += a.size
        return net

    def start(self, symbols: np.ndarray) -> None:
        """Biases from the symbols' frequencies, so that training begins at the unigram distribution."""
        n = np.bincount(symbols, minlength=HEAD + TAIL) + 0.5
        head = n[:HEAD].reshape(HEAD_CLASSES, CLASS_WORDS)
        self.wb[...] = np.log(head / head.sum(axis=1, keepdims=True))
        classes = np.concatenate([head.sum(axis=1), n[HEAD:]])
        self.cb[...] = np.log(classes / classes.sum())

    def outputs(self, states: np.ndarray, symbols: np.ndarray, gradients: bool = False):
        """Natural log probability of every symbol in its state; with gradients also those of the loss per word."""
        n = len(symbols)
        head = symbols < HEAD
        cls = np.where(head, symbols // CLASS_WORDS, symbols - HEAD + HEAD_CLASSES)
        # a state of 1 carries the biases through the products
        wide = np.ones((UNITS + 1, n), np.float32)
        wide[:UNITS] = states.T
        lp = np.empty(n, np.float32)
        weights, safe = _with_bias(self.cw, self.cb)
        step = LEARN_ROWS if gradients else OUTPUT_ROWS
        if gradients:
            dstates, dclasses = np.empty((UNITS, n), np.float32), np.zeros_like(weights)
            dwords, turned = np.zeros((HEAD_CLASSES, CLASS_WORDS, UNITS + 1), np.float32), np.ascontiguousarray(self.cw.T)
        for a in range(0, n, step):
            own, one = wide[:, a : a + step], cls[a : a + step]
            p, sums, lp[a : a + step] = _exps(weights, own, one, safe, self.held)
            if gradients:
                # shares less one for what was chosen, but for the division by the sums, which the smaller factors get
                p[one, np.arange(len(one))] -= sums
                dstates[:, a : a + step] = turned @ p / sums
                dclasses += p @ (own / sums).T
        at = np.flatnonzero(head)
        at = at[np.argsort(cls[at].astype(np.uint8), kind="stable")]
        cuts = np.searchsorted(cls[at], np.arange(HEAD_CLASSES + 1)).tolist()
        # words of one class lie side by side
        wide, word = wide[:, at], symbols[at] % CLASS_WORDS
        more, dmore = np.empty(len(at), np.float32), np.empty((UNITS, len(at) if gradients else 0), np.float32)
        weights, safe = _with_bias(self.ww, self.wb)
        turned = np.ascontiguousarray(self.ww.transpose(0, 2, 1)) if gradients else None
        for k in range(HEAD_CLASSES):
            for a in range(cuts[k], cuts[k + 1], step):
                b = min(a + step, cuts[k + 1])
                own, one = wide[:, a:b], word[a:b]
                q, sums, more[a:b] = _exps(weights[k], own, one, safe, self.held)
                if gradients:
                    q[one, np.arange(b - a)] -= sums
                    dmore[:, a:b] = turned[k] @ q / sums
                    dwords[k] += q @ (own / sums).T
        lp[at] += more
        if not gradients:
            return lp
        dstates = np.ascontiguousarray(dstates.T)
        dstates[at] += dmore.T
        return lp, dstates, dclasses[:, :UNITS], dclasses[:, UNITS], dwords[..., :UNITS], dwords[..., UNITS]

    def learn(self, symbols: np.ndarray, first: np.ndarray, h: np.ndarray, adam: Adam, scale: float) -> tuple[np.ndarray, float]:
        """One window [time, lane]: states carried in and out, gradients cut at its edges. ``first``: a text begins here."""
        keep = (~first).astype(np.float32)
        before, gates, last = Layer.forward(self.x[symbols], self.u, h, keep)
        flat = before.reshape(-1, UNITS)
        lp, dstates, *douts = self.outputs(flat, symbols.ravel(), True)
        n = symbols.size
        dx, du = Layer.backward(before, gates, self.u, (dstates / n).reshape(before.shape), None, keep)
        dxrows = added_rows(symbols.ravel().astype(np.uint16), dx.reshape(-1, 2 * UNITS), len(self.x))
        adam.step([dxrows, du, *(d / n for d in douts)], scale)
        return last, float(-lp.sum())


def _stream(vocabulary_: Vocabulary, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts one after the other, and where texts begin."""
    words, begins = [], []
    for text in texts:
        begins.append(len(words))
        words.extend(words_of(text))
    symbols = vocabulary_.look_up(words)[0]
    first = np.zeros(len(symbols), bool)
    first[begins] = True
    return symbols, first


def _read(codes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of texts given by their codes, one after the other, and the length of each."""
    return symbols_of(np.frombuffer(b"".join(codes), np.int32)), np.array([len(c) // 4 for c in codes], np.int64)


def _pass(net: Network, adam: Adam, symbols: np.ndarray, first: np.ndarray, scale: float) -> None:
    """One pass over a stream, cut into lanes that run side by side."""
    lanes = int(np.clip(len(symbols) // (4 * STEPS), 1, LANES))
    steps = len(symbols) // lanes
    # the last few symbols that fill no lane follow in a lane of their own
    grid, begins = (a[: lanes * steps].reshape(lanes, steps).T for a in (symbols, first))
    h = np.zeros((lanes, UNITS), np.float32)
    for t in range(0, steps, STEPS):
        h, _ = net.learn(grid[t : t + STEPS], begins[t : t + STEPS], h, adam, scale)
    if len(symbols) > lanes * steps:
        rest, begins = symbols[lanes * steps :, None], first[lanes * steps :, None]
        h = np.zeros((1, UNITS), np.float32)
        for t in range(0, len(rest), STEPS):
            h, _ = net.learn(rest[t : t + STEPS], begins[t : t + STEPS], h, adam, scale * 0.1)


def warm_network(docs: DataFrame, vocabulary_: Vocabulary, sample: int = WARM) -> Network:
    """A network fitted to a bounded sample of training texts, for all tasks to start from."""
    net = Network()
    ids = training(docs).filter("doc_id IS NOT NULL").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = training(docs).join(F.broadcast(ids), "doc_id").dropDuplicates(["doc_id"])
    texts = [bytes(t) for _, t in sorted((r["doc_id"], r["_text"]) for r in rows.toLocalIterator())]
    if texts:
        symbols, first = _stream(vocabulary_, texts)
        net.start(symbols)
        adam = Adam(net.arrays(), RATE)
        for _ in range(WARM_PASSES):
            _pass(net, adam, symbols, first, 1.0)
    return net


_PARTS = 64


def trained(rows: DataFrame, warm: Network) -> Network:
    """One pass over all training texts (as ``encoded``), by all tasks at once, and the average of their networks."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(warm.flat())
    schema = "part int, task int, weight double, body binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, seen, held, size = Network.of(shared.value), 0, [], 0
        adam = Adam(net.arrays(), RATE * 0.4)

        def learned() -> int:
            symbols, lengths = _read(held)
            first = np.zeros(len(symbols), bool)
            first[np.cumsum(lengths) - lengths] = True
            _pass(net, adam, symbols, first, 1.0)
            held.clear()
            return len(symbols)

        for batch in batches:
            for codes in batch.column(0).to_pylist():
                held.append(codes)
                size += len(codes)
                if size > common.BLOCK_BYTES:
                    seen, size = seen + learned(), 0
        if held:
            seen += learned()
        if seen:
            task = TaskContext.get().partitionId()
            parts = np.array_split(net.flat().astype(np.float64) * seen, _PARTS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(_PARTS), pa.int32()), pa.array([task] * _PARTS, pa.int32()), pa.array([float(seen)] * _PARTS), pa.array([p.astype(np.float32).tobytes() for p in parts])],
                ["part", "task", "weight", "body"],
            )

    def added(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b, np.float32).astype(np.float64) for b in group["body"].to_pylist())
        return pa.table(
            [
                group["part"].slice(0, 1), pa.array([group["task"][0].as_py()], pa.int32()),
                pa.array([float(sum(group["weight"].to_pylist()))]), pa.array([total.astype(np.float32).tobytes()]),
            ],
            names=["part", "task", "weight", "body"],
        )

    found = rows.filter(~common.in_fold(F.col("doc_id"), FOLDS, HELD_OUT)).select("codes").mapInArrow(run, schema)
    some = found.withColumn("task", F.col("task") % 64).groupBy("part", "task").applyInArrow(added, schema)
    whole = some.groupBy("part").applyInArrow(added, schema).collect()
    if not whole:
        return warm
    return Network.of(np.concatenate([np.frombuffer(r["body"], np.float32) / r["weight"] for r in sorted(whole, key=lambda r: r["part"])]))


# --- scoring -----------------------------------------------------------------


def log_likelihoods(net: Network, lengths: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """Natural log probability of the symbols of each text; texts lie one after the other.

    Texts are dealt to lanes, longest first; a lane runs its texts one after the
    other. States are carried through all windows and begin anew with each text.
    """
    out = np.zeros(len(lengths))
    if not len(lengths):
        return out
    order = np.argsort(-lengths, kind="stable")
    lanes = int(np.clip(lengths.sum() // max(int(lengths.max()), 1), 1, LANES))
    filled = [(0, k) for k in range(lanes)]
    held: list[list[int]] = [[] for _ in range(lanes)]
    for doc in order.tolist():
        size, k = heapq.heappop(filled)
        held[k].append(doc)
        heapq.heappush(filled, (size + int(lengths[doc]), k))
    begins = np.cumsum(lengths) - lengths
    sizes = np.array([lengths[h].sum() for h in held])
    longest = np.argsort(-sizes, kind="stable")
    steps = int(sizes.max())
    grid = np.full((steps, lanes), -1, np.int32)
    owner = np.zeros((steps, lanes), np.int32)
    first = np.zeros((steps, lanes), bool)
    for col, k in enumerate(longest.tolist()):
        row = 0
        for doc in held[k]:
            n = int(lengths[doc])
            grid[row : row + n, col] = symbols[begins[doc] : begins[doc] + n]
            owner[row : row + n, col] = doc
            first[row, col] = True
            row += n
    sizes = sizes[longest]
    h = np.zeros((lanes, UNITS), np.float32)
    for t in range(0, steps, STEPS):
        k = int(np.searchsorted(-sizes, -t, side="left"))  # lanes that go on
        part = grid[t : t + STEPS, :k]
        before, _, last = Layer.forward(net.x[np.maximum(part, 0)], net.u, h[:k], (~first[t : t + STEPS, :k]).astype(np.float32))
        h[:k] = last
        real, of = part >= 0, owner[t : t + STEPS, :k]
        if real.all():
            real = slice(None)
            before, part, of = before.reshape(-1, UNITS), part.ravel(), of.ravel()
        lp = net.outputs(before[real], part[real].astype(np.int64))
        out += np.bincount(of[real], weights=lp, minlength=len(out))
    return out


def scored(rows: DataFrame, counts: DataFrame, vocabulary_: Vocabulary, net: Network) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row of ``rows`` (as ``encoded``)."""
    shared = rows.sparkSession.sparkContext.broadcast(net.flat())
    kept = ["doc_id", "key", "n_tokens", "n_near", "near_sum", "tail_near"]
    schema = "doc_id bigint, key bigint, n_tokens bigint, n_near bigint, near_sum double, tail_near double, model double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network, held, size = Network.of(shared.value), [], 0

        def done() -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(held)
            symbols, lengths = _read(whole["codes"].to_pylist())
            lp = log_likelihoods(network, lengths, symbols) / np.log(10)
            held.clear()
            yield from whole.select(kept).append_column("model", pa.array(lp - whole["room"].to_numpy())).to_batches()

        for batch in batches:
            for part in common.blocks(4 * batch.column("n_tokens").to_numpy(), SCORE_BYTES):
                held.append(batch.slice(part.start, part.stop - part.start))
                size += 4 * int(held[-1].column("n_tokens").to_numpy().sum())
                if size > SCORE_BYTES:
                    yield from done()
                    size = 0
        if held:
            yield from done()

    modelled = common.stored(rows.select(*kept, "room", "codes").mapInArrow(run, schema))
    # words beyond the near ones: counted per text, then joined on their hash
    asked = rows.filter("size(far) > 0").dropDuplicates(["doc_id", "key"]).select("doc_id", "key", F.explode("far").alias("h"))
    far = counts.select("h", F.log10(F.col("c") + 1.0).alias("logs"))
    found = asked.join(by_shuffle(far), "h").groupBy("doc_id", "key").agg(F.count("*").alias("n_far"), F.sum("logs").alias("far_sum"))
    found = found.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "n_far", "far_sum")
    joined = modelled.join(by_shuffle(found), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "left")
    far_sum = F.coalesce("far_sum", F.lit(0.0))
    room = float(np.log10(vocabulary_.total + vocabulary_.distinct + 1))
    return joined.select(
        "doc_id",
        common.in_fold(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"),
        "n_tokens",
        (F.col("n_near") + F.coalesce("n_far", F.lit(0))).alias("n_known"),
        F.lit(int(vocabulary_.total)).cast("bigint").alias("train_tokens"),
        (F.col("near_sum") + far_sum - F.col("n_tokens") * room).alias("base_score"),
        (F.col("model") + F.col("tail_near") + far_sum).alias("score"),
    )


def model_scores(docs: DataFrame) -> DataFrame:
    """Count, train and score: the whole operator over one table of documents."""
    counts = common.stored(counted(docs))
    known = vocabulary(counts)
    rows = common.stored(encoded(docs, known))
    net = trained(rows, warm_network(docs, known))
    return scored(rows, counts, known, net)
