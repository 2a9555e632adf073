"""Near-duplicate groups: SuperMinHash signatures, banding, verification and union-find grouping.

A document's set holds its distinct five-word shingles (fewer words: the whole
sequence as one). Two documents are linked when 100 * |A and B| >= 75 * |A or B|.

Steps, none of which gathers a group in one task:

1. Every text becomes a signature (``superminhash``), a set size and a 128-bit
   fingerprint of its set. Documents with equal fingerprints are one class; its
   smallest id stands for it from here on.
2. Signatures are cut into bands. A band's key also holds a size class: linked
   sets differ in size by 4/3 at most, so each set enters its own class and the
   next, and a long text never meets the thousands of short ones that share a
   passage with it.
3. Every bucket proposes its smallest set and its smallest id as partners of
   all its members: two aggregates, no pairs within the bucket. Proposals are
   verified on full sets.
4. Buckets that still hold several groups go through rounds of stars: all
   members outside the bucket's largest group are verified against one member of
   that group, another one each round, so a round's work grows with the members.
   Rounds end when few stars find a link.
5. What is then left of a bucket is compared in blocks: members of the smaller
   groups with all others, and no pair within the largest group, so no link
   between different texts is left to the choice of partners. Blocks hold
   members by count and by size of their sets. Signatures far from the bound go
   first; the sets of the rest are compared exactly, and a block returns only
   links that join its groups.
6. Verified links become components by hooking to the smallest neighbour and
   halving paths, until nothing changes.

Defined cases: null or empty texts, and texts of blanks only, have no shingles,
are linked with nothing and kept. A row with a null id is its own group
(component null, kept). Rows that repeat an id belong to the group of that id.
``deduplicated`` goes by rows: of a group one row stays, also where rows repeat
an id or have none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalgrid.llm import common
from vitalgrid.operators.ordering import by_shuffle

WIDTH = 5
#: A link needs LINK_TOP / LINK_BOTTOM of the union in common.
LINK_TOP, LINK_BOTTOM = 75, 100
#: 36 bands of 5 ranks: a pair at 0.75 is missed with probability 6e-5.
BANDS, ROWS = 36, 5
#: Pairs of step 5 whose signatures agree in a smaller share than this are not
#: verified: at a true similarity of 0.75 that is 4.6 deviations off.
LEAST_AGREEMENT = 0.60
#: Members of a bucket, and shingles of their sets, on one side of a block of step 5.
CHUNK, CHUNK_SHINGLES = 512, 2_000_000
#: Share of a round's stars that must find a link for another round.
WORTHWHILE = 0.05
#: Set elements ranked at once; bounds the memory for permutations.
BLOCK_ELEMENTS = 100_000
_MOST = np.uint64(2**64 - 1)


def shingle_set(text: bytes) -> np.ndarray:
    """Sorted distinct hashes of the lower-cased text's five-word shingles."""
    words = common.word_hashes(text.lower().split())
    if not len(words):
        return np.zeros(0, np.uint64)
    return np.unique(common.windows(words, min(WIDTH, len(words))))


def superminhash(sets: list[np.ndarray], m: int = BANDS * ROWS) -> np.ndarray:
    """One row of ``m`` ranks per set.

    Element e walks through a random permutation p of the slots and offers
    j + r_j(e) to slot p_j. Offers of step j are at least j, so a set is done as
    soon as every slot holds less than the next step's least offer. Sets of many
    elements are ranked in parts and merged by minimum. An empty set stays at the
    largest value.
    """
    out = np.full((len(sets), m), _MOST, np.uint64)
    parts = [(i, s[k : k + BLOCK_ELEMENTS]) for i, s in enumerate(sets) for k in range(0, len(s), BLOCK_ELEMENTS)]
    for cut in common.blocks(np.array([len(s) for _, s in parts]), BLOCK_ELEMENTS):
        owner, held = zip(*parts[cut])
        ranks = _ranked(np.concatenate(held), np.repeat(np.arange(len(held)), [len(s) for s in held]), len(held), m)
        np.minimum.at(out, np.array(owner), ranks)
    return out


def _ranked(elements: np.ndarray, owner: np.ndarray, n: int, m: int) -> np.ndarray:
    ranks = np.full(n * m, _MOST, np.uint64)
    order = np.broadcast_to(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (len(elements), m)).copy()
    for j in range(m):
        drawn = common.mixed(elements + np.uint64((j + 1) * 0x9E3779B97F4A7C15 % 2**64))
        pick = j + ((drawn & np.uint64(0xFFFFFFFF)) * np.uint64(m - j) >> np.uint64(32)).astype(np.int64)
        row = np.arange(len(elements))
        slot = order[row, pick]
        order[row, pick] = order[:, j]
        np.minimum.at(ranks, owner * m + slot, (drawn >> np.uint64(32)) + np.uint64(j << 32))
        open_sets = ranks.reshape(n, m).max(axis=1) >= np.uint64((j + 1) << 32)
        more = open_sets[owner]
        if not more.any():
            break
        if not more.all():
            elements, owner, order = elements[more], owner[more], order[more]
    return ranks.reshape(n, m)


def _size_classes(n: np.ndarray) -> np.ndarray:
    """floor(log n / log(4/3)), moved down a hair so that equal ratios never fall two classes apart."""
    return np.floor(np.log(np.maximum(n, 1)) / np.log(LINK_BOTTOM / LINK_TOP) - 1e-9).astype(np.int64)


def signatures(docs: DataFrame) -> DataFrame:
    """``doc_id, row_key, n_shingles, fingerprint, keys, ranks``: two band keys per band, a 16-bit digest per rank."""

    def work(batch: list[bytes], _) -> dict:
        sets = [shingle_set(t) for t in batch]
        sizes = np.array([len(s) for s in sets], np.int64)
        ranks = superminhash(sets)
        bands = np.stack(
            [common.windows(r, 1) for r in ranks.reshape(-1, ROWS).T.copy()], axis=1
        ).reshape(len(sets), BANDS, ROWS)
        weights = np.array([pow(0x9E3779B97F4A7C15, k + 1, 2**64) for k in range(ROWS)], np.uint64)
        value = (bands * weights).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        classes = _size_classes(sizes)
        keys = np.concatenate(
            [common.mixed(value + ((classes + up).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))[:, None]) for up in (0, 1)],
            axis=1,
        )
        short = common.mixed(ranks.ravel()).astype(np.uint16).reshape(len(sets), -1)
        filled = sizes > 0
        return {
            "n_shingles": sizes,
            "fingerprint": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
            "keys": pa.array([k if f else None for k, f in zip(keys.view(np.int64), filled)], pa.list_(pa.int64())),
            "ranks": [s.tobytes() if f else None for s, f in zip(short, filled)],
        }

    return common.over_texts(
        common.texts(docs, common.row_key("text").alias("row_key")), work,
        "n_shingles bigint, fingerprint binary, keys array<bigint>, ranks binary", keep=("doc_id", "row_key"),
    )


def sets_of(docs: DataFrame) -> DataFrame:
    """``doc_id, shingles`` (sorted 64-bit hashes as bytes), for verification."""

    def work(batch: list[bytes], _) -> dict:
        return {"shingles": [shingle_set(t).tobytes() for t in batch]}

    return common.over_texts(common.texts(docs), work, "shingles binary")


def _sets(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """Sets of some ids, written. A repeated id is one text here: the class of its smallest fingerprint was chosen before."""
    found = common.stored(ids.select("doc_id").distinct())
    few = F.broadcast(found) if found.count() <= common.BROADCAST_KEYS else by_shuffle(found)
    return common.stored(sets_of(docs.join(few, "doc_id", "left_semi")).dropDuplicates(["doc_id"]))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``a, b`` whose full sets are linked."""
    both = (
        pairs.join(by_shuffle(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("left"))), "a")
        .join(by_shuffle(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("right"))), "b")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, left, right = (batch.column(batch.schema.get_field_index(c)) for c in ("a", "b", "left", "right"))
            linked = [
                _linked(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64))
                for x, y in zip(left, right)
            ]
            mask = pa.array(linked, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], ["a", "b"])

    return both.select("a", "b", "left", "right").mapInArrow(run, "a bigint, b bigint")


def _linked(x: np.ndarray, y: np.ndarray) -> bool:
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if LINK_BOTTOM * len(small) < LINK_TOP * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    common_ = int((large[at] == small).sum())
    return LINK_BOTTOM * common_ >= LINK_TOP * (len(x) + len(y) - common_)


def _open_members(members: DataFrame, groups: DataFrame, turn: int) -> DataFrame:
    """Members of buckets with several groups, written: ``g``, the bucket's largest group ``main`` and a member of it, ``centre``.

    The centre is drawn anew each ``turn``. ``chunks`` counts the blocks that the
    main group and all others need.
    """
    grouped = members.join(by_shuffle(groups), "doc_id", "left").select(
        "key", "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("g")
    )
    drawn = F.struct("doc_id", "n_shingles")
    sizes = grouped.groupBy("key", "g").agg(
        F.count("*").alias("n"), F.sum("n_shingles").alias("shingles"), F.min_by(drawn, F.xxhash64("doc_id", F.lit(turn))).alias("centre")
    )
    buckets = sizes.groupBy("key").agg(
        F.max_by(F.struct("g", "centre", "n", "shingles"), F.struct("n", -F.col("g"))).alias("main"),
        F.sum("n").alias("n"), F.sum("shingles").alias("shingles"), F.count("*").alias("groups"),
    ).filter("groups > 1")

    def chunks(n: str, shingles: str) -> str:
        return f"CAST(greatest(ceil(({n}) / {CHUNK}), ceil(({shingles}) / {CHUNK_SHINGLES})) AS INT)"

    named = buckets.selectExpr(
        "key", "main.g AS main", "main.centre.doc_id AS centre", "main.centre.n_shingles AS centre_size",
        chunks("main.n", "main.shingles") + " AS main_chunks", chunks("n - main.n", "shingles - main.shingles") + " AS chunks",
    )
    return common.stored(grouped.join(by_shuffle(named), "key"))


def _fits(n: str, m: str) -> Column:
    """Sets of these sizes can be linked."""
    return LINK_BOTTOM * F.least(n, m) >= LINK_TOP * F.greatest(n, m)


def _stars(members: DataFrame, links: DataFrame, groups: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Rounds of stars: the members that are still open, the links and groups then known, and the sets of the open ones."""
    turn, open_, sets = 0, _open_members(members, groups, 0), None
    while True:
        if sets is None:
            sets = _sets(open_, docs)
        stars = common.stored(
            open_.filter((F.col("g") != F.col("main")) & _fits("n_shingles", "centre_size")).select(
                F.least("doc_id", "centre").alias("a"), F.greatest("doc_id", "centre").alias("b")
            ).distinct()
        )
        found = common.stored(_verified(stars, sets))
        new, asked = found.count(), stars.count()
        if new:
            links = common.stored(links.union(found))
            groups = components(links)
            open_ = _open_members(open_.select("key", "doc_id", "n_shingles"), groups, turn + 1)
        if new <= WORTHWHILE * asked:
            return open_, links, groups, sets
        turn += 1


def _across(open_: DataFrame, reps: DataFrame, sets: DataFrame) -> DataFrame:
    """Links ``a, b`` between different groups of one bucket, enough of them to join all groups that are linked.

    The first pass compares signatures and names the members that have a partner
    worth a look; only these are sent with their full sets to the second, which
    counts common shingles exactly and returns the links of a spanning forest. No
    pair leaves a block otherwise.
    """
    one = reps.select("doc_id", "n_shingles", "ranks").dropDuplicates(["doc_id"])
    placed = _placed(open_).join(by_shuffle(one), "doc_id")
    worth = common.stored(_in_blocks(placed, _promising, "key bigint, i int, j int, doc_id bigint, h int, g bigint"))
    return _in_blocks(worth.join(by_shuffle(sets), "doc_id"), _forest, "a bigint, b bigint").distinct()


def _placed(rows: DataFrame) -> DataFrame:
    """Every row once per block of its bucket: chunk h meets chunk k in block (min, max).

    Chunks of the largest group come first and meet the other chunks only.
    """
    is_main = F.col("g") == F.col("main")
    part = F.xxhash64("doc_id")
    own = rows.withColumn(
        "h", F.when(is_main, F.pmod(part, F.col("main_chunks"))).otherwise(F.col("main_chunks") + F.pmod(part, F.col("chunks"))).cast("int")
    )
    met = own.withColumn(
        "k", F.explode(F.sequence(F.when(is_main, F.col("main_chunks")).otherwise(0), F.col("main_chunks") + F.col("chunks") - 1))
    )
    return met.select("key", "doc_id", "g", "h", F.least("h", "k").alias("i"), F.greatest("h", "k").alias("j"))


def _in_blocks(rows: DataFrame, work, schema: str) -> DataFrame:
    """Apply ``work`` to the rows of each (key, i, j), which arrive next to each other."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            now = pa.Table.from_batches([batch])
            held = now if held is None else pa.concat_tables([held, now])
            tags = np.stack([held[c].to_numpy() for c in ("key", "i", "j")])
            cuts = np.flatnonzero((tags[:, 1:] != tags[:, :-1]).any(axis=0)) + 1
            begin = 0
            for end in cuts.tolist():
                yield from done(held.slice(begin, end - begin))
                begin = end
            held = held.slice(begin).combine_chunks()
        if held is not None and held.num_rows:
            yield from done(held)

    def done(block: pa.Table) -> Iterator[pa.RecordBatch]:
        out = work(block)
        if out and len(out[0]):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, target)], schema=target)

    count = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(count, "key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, schema)


def _sides(block: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    h, i, j = (block[c].to_numpy() for c in ("h", "i", "j"))
    return np.flatnonzero(h == i), np.flatnonzero(h == j)


def _promising(block: pa.Table) -> tuple:
    """Members with a partner of another group, of fitting size and with a signature near enough."""
    x, y = _sides(block)
    ids, g, n = (block[c].to_numpy() for c in ("doc_id", "g", "n_shingles"))
    ranks = np.frombuffer(b"".join(block["ranks"].to_pylist()), np.uint16).reshape(len(ids), -1)
    chosen = np.zeros(len(ids), bool)
    for k in range(0, len(x), 32):
        part = x[k : k + 32]
        alike = (ranks[part][:, None, :] == ranks[y][None]).mean(axis=2) >= LEAST_AGREEMENT
        small, large = np.minimum(n[part][:, None], n[y]), np.maximum(n[part][:, None], n[y])
        fit = alike & (g[part][:, None] != g[y]) & (LINK_BOTTOM * small >= LINK_TOP * large)
        chosen[part[fit.any(axis=1)]] = True
        chosen[y[fit.any(axis=0)]] = True
    at = np.flatnonzero(chosen)
    return tuple(block[c].to_numpy()[at] for c in ("key", "i", "j", "doc_id", "h", "g"))


def _forest(block: pa.Table) -> tuple:
    """Verified links between groups of a block that its earlier links do not already join."""
    x, y = _sides(block)
    ids, g = block["doc_id"].to_numpy(), block["g"].to_numpy()
    sets = [np.frombuffer(s, np.uint64) for s in block["shingles"].to_pylist()]
    n = np.array([len(s) for s in sets])
    both = _common_counts(sets, x, y)
    linked = LINK_BOTTOM * both >= LINK_TOP * (n[x][:, None] + n[y] - both)
    parent = {int(v): int(v) for v in np.unique(g)}

    def root(v: int) -> int:
        while parent[v] != v:
            parent[v] = v = parent[parent[v]]
        return v

    a, b = [], []
    for p, q in np.argwhere(linked & (g[x][:, None] != g[y])).tolist():
        left, right = root(int(g[x[p]])), root(int(g[y[q]]))
        if left != right:
            parent[max(left, right)] = min(left, right)
            a.append(int(ids[x[p]]))
            b.append(int(ids[y[q]]))
    return a, b


def _common_counts(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray, width: int = 4096) -> np.ndarray:
    """Exact sizes of all intersections of two lists of sets, by slices of the shingles that occur twice."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.cumsum(times > 1) - 1
    shared = times[column] > 1
    owner, column = owner[shared], order[column[shared]]
    counts = np.zeros((len(x), len(y)), np.int64)
    sort = np.argsort(column, kind="stable")
    owner, column = owner[sort], column[sort]
    for begin in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [begin, begin + width])
        held = np.zeros((len(sets), width), np.float32)
        held[owner[lo:hi], column[lo:hi] - begin] = 1
        counts += (held[x] @ held[y].T).astype(np.int64)
    return counts


def components(links: DataFrame) -> DataFrame:
    """``doc_id, component_id``: the smallest id reachable over the links ``a, b``; linked ids only.

    Union by hooking: every id points to the smallest id it knows, ids pass their
    pointers to all neighbours, and pointers are halved (an id takes its parent's
    parent) each turn, so long chains fold quickly. Each turn is a written table.
    """
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b")
    edges = common.stored(both.distinct())
    parents = common.stored(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("p")))
    while True:
        known = edges.join(by_shuffle(parents.select(F.col("a").alias("b"), F.col("p").alias("q"))), "b")
        offered = known.groupBy("a").agg(F.min("q").alias("q"))
        hooked = parents.join(by_shuffle(offered), "a").select("a", "p", F.least("p", "q").alias("q"))
        # roots learn what their members were offered, so whole groups move at once
        told = hooked.groupBy(F.col("p").alias("a")).agg(F.min("q").alias("t"))
        merged = hooked.join(by_shuffle(told), "a", "left").select("a", F.col("p").alias("old"), F.least("q", "t").alias("p"))
        up = merged.select(F.col("a").alias("p"), F.col("p").alias("g"))
        moved = common.stored(
            merged.join(by_shuffle(up), "p", "left").select("a", "old", F.least("p", "g").alias("p"))
        )
        parents = moved.select("a", "p")
        if moved.filter("p <> old").isEmpty():
            return parents.select(F.col("a").alias("doc_id"), F.col("p").alias("component_id"))


def _grouped(docs: DataFrame) -> DataFrame:
    """``doc_id, row_key, n_shingles, fingerprint, class_id`` per row: the group of the row's set, null without shingles."""
    signed = common.stored(signatures(docs))
    # one row per different set; the class's smallest id represents it
    classes = signed.filter("fingerprint IS NOT NULL AND doc_id IS NOT NULL").groupBy("fingerprint").agg(
        F.min("doc_id").alias("rep")
    )
    classes = common.stored(classes)
    reps = signed.join(
        by_shuffle(classes.select(F.col("rep").alias("doc_id"), "fingerprint")), ["doc_id", "fingerprint"], "left_semi"
    ).dropDuplicates(["doc_id", "fingerprint"])
    rows = reps.select("doc_id", "n_shingles", F.explode("keys").alias("key"))
    smallest = F.min(F.struct("n_shingles", "doc_id"))["doc_id"]
    buckets = rows.groupBy("key").agg(
        F.count("*").alias("members"), smallest.alias("small"), F.min("doc_id").alias("first")
    ).filter("members > 1").drop("members")
    members = common.stored(rows.join(by_shuffle(buckets), "key"))
    proposed = members.select("doc_id", F.explode(F.array("small", "first")).alias("b"))
    pairs = common.stored(
        proposed.filter("doc_id <> b").select(F.least("doc_id", "b").alias("a"), F.greatest("doc_id", "b").alias("b")).distinct()
    )
    ends = pairs.select(F.col("a").alias("doc_id")).union(pairs.select(F.col("b").alias("doc_id")))
    links = common.stored(_verified(pairs, _sets(ends, docs)))
    # an id that stands for two sets (a repeated id) ties their classes together
    open_, links, groups, sets = _stars(members, links, components(links), docs)
    rest = common.stored(_across(open_, reps, sets))
    if not rest.isEmpty():
        groups = components(links.union(rest))
    # members of a class get the group of its representative; groups carry the smallest id of all classes
    named = classes.select("fingerprint", "rep").join(
        by_shuffle(groups.select(F.col("doc_id").alias("rep"), "component_id")), "rep", "left"
    ).select("fingerprint", F.coalesce("component_id", "rep").alias("class_id"))
    return signed.select("doc_id", "row_key", "n_shingles", "fingerprint").join(by_shuffle(named), "fingerprint", "left")


def near_groups(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``."""
    group = F.coalesce("class_id", "doc_id")
    return _grouped(docs).select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), group).alias("component_id"),
        F.coalesce(group == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """One row of each group, with the columns of ``docs``.

    The row with the smallest id stays; where several rows have it, the one with
    the smallest hash of its text, and of equal rows any one. Rows without id are
    in the group of their set; if that has ids, one of those stays. Rows without
    shingles and without id are told apart by nothing but their text.
    """
    rows = common.stored(_grouped(docs))
    group = F.when(F.col("class_id").isNotNull() | F.col("doc_id").isNotNull(), F.coalesce("class_id", "doc_id"))
    # a null id comes last; without any id in the group, the set itself or else the text names it
    one = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("row_key").alias("k"))
    named = rows.withColumns({"_g": group, "_f": F.when(group.isNull(), F.coalesce(F.hex("fingerprint"), F.col("row_key").cast("string")))})
    chosen = common.stored(
        named.groupBy("_g", "_f").agg(F.min(one).alias("one")).select(F.col("one.d").alias("doc_id"), F.col("one.k").alias("row_key"))
    )
    per_key = rows.groupBy("doc_id", "row_key").agg(F.count("*").alias("rows"))
    same = per_key["doc_id"].eqNullSafe(F.col("c.doc_id")) & (per_key["row_key"] == F.col("c.row_key"))
    marked = common.stored(
        per_key.join(chosen.alias("c"), same, "left").select(per_key["doc_id"], per_key["row_key"], "rows", F.col("c.row_key").isNotNull().alias("stays"))
    )
    repeated = marked.filter("stays AND rows > 1")
    left = common.keyed_rows(docs, marked.filter("NOT stays OR rows > 1"), ("text",), "left_anti")
    if repeated.isEmpty():
        return left
    key, owner = common.fresh(docs, "_key"), common.fresh(docs, "_owner")
    again = common.keyed_rows(docs, repeated, ("text",), "left_semi")
    several = again.withColumns({key: common.row_key("text"), owner: F.col("doc_id")}).dropDuplicates([key, owner])
    return left.unionByName(several.select(*docs.columns))
