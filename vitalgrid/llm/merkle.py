"""Merkle manifest of a dataset by lag and lead windows: a tree of eight per group, and one over the groups.

A row's leaf is the digest of its fields. Leaves of a group lie in key order;
while a group has several nodes, each run of ``FAN`` becomes the digest of its
digests. A group's last node is its subroot; subroots in group order make the
top tree in the same way.

How the work is spread: rows are dealt by ranges of (group, key), which cuts
every group, however large, into as many tasks as it needs; one small row per
range and group turns places within a task into positions within the group.
Positions are cut into aligned blocks of ``FAN ** LEVELS``. Inside a block all
``LEVELS`` levels are columns over one window: at level k the node at position p
is on the row whose position is a multiple of FAN ** k, lag and lead by
j * FAN ** k are its siblings, masked by its slot and the run's length, and
first-child rows hash the parent. The next round starts from one row per block,
so the rounds are logarithmic in the largest group. Going down again, every row
takes the path of its block: a join by (group, block), never by the group alone.

Defined cases: nulls count as ``-`` in a leaf; a null id comes before all others,
a null group before the empty one. Rows with equal id follow their leaves, equal
rows are interchangeable. A lone leaf is its subroot, a lone subroot the root. An
empty table gives no rows. Other columns of the input do not matter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vitalgrid.llm import common

FAN = 8
#: Levels of one round; a block of the window holds FAN ** LEVELS rows.
LEVELS = 3
BLOCK = FAN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Rows of the table of ranges and groups that may be broadcast.
BROADCAST_ROWS = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(value: Column) -> Column:
    return F.sha2(value.cast("binary"), 256)


def leaf_digest(fields: list[Column]) -> Column:
    """Digest of fields: each ``-`` if null, else its UTF-8 bytes' count, a colon and the value."""
    parts = [f.cast("string") for f in fields]
    return digest(F.concat(*[F.coalesce(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts]))


def tampered_text(text: Column, doc_id: Column) -> Column:
    """The text with A-Z in lower case where 3 divides the id's crc32, else as it is."""
    chosen = F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0
    return F.when(chosen, F.translate(text, _UPPER, _LOWER)).otherwise(text)


def leaves(docs: DataFrame) -> DataFrame:
    """``grp, doc_id, leaf, other``: the leaf as it is, and after tampering where that applies (else null)."""
    doc_id, text = F.col("doc_id"), F.col("text")
    chosen = F.crc32(doc_id.cast("string").cast("binary")) % 3 == 0
    fields = [F.col(f) for f in FIELDS]
    changed = [tampered_text(text, doc_id) if f == "text" else F.col(f) for f in FIELDS]
    return docs.select(
        # sorts null before every name, and names by their bytes
        F.coalesce(F.concat(F.lit("="), F.col("lang").cast("string")), F.lit("")).alias("grp"),
        doc_id.cast("bigint").alias("doc_id"),
        leaf_digest(fields).alias("leaf"),
        F.when(chosen, leaf_digest(changed)).alias("other"),
        F.monotonically_increasing_id().alias("row"),
    )


def positions(rows: DataFrame, order: list[str]) -> DataFrame:
    """Add ``p`` (from 0, by ``order`` within ``grp``) and ``n`` (rows of the group); ``rows`` is a written table."""
    count = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sort = [F.col(c).asc_nulls_first() for c in ("grp", *order)]
    dealt = rows.repartitionByRange(count, *sort).sortWithinPartitions(*sort)
    # the task's number above 33 bits, the row's place in the task below
    at = common.stored(dealt.withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_at", 33)))
    ranges = at.groupBy("grp", "_range").agg(F.count("*").alias("_rows"), F.min("_at").alias("_first"))
    before = Window.partitionBy("grp").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = common.stored(
        ranges.select(
            "grp", "_range", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
            F.sum("_rows").over(Window.partitionBy("grp")).alias("n"),
        )
    )
    small = offsets.count() <= BROADCAST_ROWS
    return at.join(F.broadcast(offsets) if small else offsets, ["grp", "_range"]).withColumn(
        "p", F.col("_at") - F.col("_first") + F.col("_before")
    ).drop("_at", "_range", "_first", "_before")


def _level(nodes: DataFrame, k: int) -> DataFrame:
    """Siblings ``side{k}`` of the nodes of level k within the blocks, and their parents ``h{k + 1}``."""
    step, block = FAN**k, "OVER (PARTITION BY grp, block ORDER BY p)"
    slot = f"(p div {step} % {FAN})"
    here = f"((n + {step - 1}) div {step})"  # nodes of the group at this level
    run = f"least({FAN}, {here} - (p div {step} - {slot}))"
    left = ", ".join(f"IF({slot} >= {j}, lag(h{k}, {j * step}) {block}, '')" for j in range(FAN - 1, 0, -1))
    right = ", ".join(f"IF({slot} + {j} < {run}, lead(h{k}, {j * step}) {block}, '')" for j in range(1, FAN))
    sided = nodes.selectExpr(
        "*", f"IF(p % {step} = 0 AND {here} > 1, named_struct('l', concat({left}), 'r', concat({right})), NULL) AS side{k}"
    )
    parent = f"IF({here} > 1, sha2(CAST(concat(h{k}, side{k}.r) AS BINARY), 256), h{k})"
    return sided.selectExpr("*", f"IF(p % {step * FAN} = 0, {parent}, NULL) AS h{k + 1}")


def _blocks(nodes: DataFrame) -> DataFrame:
    return reduce(_level, range(LEVELS), nodes.selectExpr("*", f"p div {BLOCK} AS block", "h AS h0"))


def climbed(nodes: DataFrame) -> list[DataFrame]:
    """``nodes`` (``grp, p, n, h``, a written table), then one written table per round, until groups have one node."""
    rounds, largest = [nodes], nodes.agg(F.max("n").alias("n")).first()["n"] or 0
    while largest > 1:
        top = _blocks(rounds[-1].select("grp", "p", "n", "h")).filter(F.col("p") % BLOCK == 0)
        rounds.append(
            common.stored(top.selectExpr("grp", "block AS p", f"(n + {BLOCK - 1}) div {BLOCK} AS n", f"h{LEVELS} AS h"))
        )
        largest = -(-largest // BLOCK)
    return rounds


def descended(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """The first table of ``rounds`` with ``path`` (siblings from the leaf up) and the columns of ``above``.

    ``above`` has one row per ``grp``: its own ``path`` and what all rows of the group shall carry.
    """
    carried = [c for c in above.columns if c not in ("grp", "path")]
    found = rounds[-1].join(above, "grp")
    for nodes in reversed(rounds[:-1]):
        # a block's rows take its node's path; a node's siblings hold for all rows up to the next node
        so_far = Window.partitionBy("grp", "block").orderBy("p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sided = _blocks(nodes)
        sides = F.array(*[F.last(f"side{k}", ignorenulls=True).over(so_far) for k in range(LEVELS)])
        sided = sided.withColumn("sides", F.filter(sides, lambda s: s.isNotNull())).select(*nodes.columns, "block", "sides")
        up = common.stored(found.select("grp", F.col("p").alias("block"), "path", *carried))
        found = sided.join(up, ["grp", "block"]).withColumn("path", F.concat("sides", "path")).drop("sides", "block")
    return found


def manifest(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` for every row of ``docs``."""
    spark = docs.sparkSession
    placed = positions(common.stored(leaves(docs)), ["doc_id", "leaf", "row"])
    rounds = climbed(common.stored(placed.withColumnRenamed("leaf", "h").drop("row")))
    # the top tree: subroots are the nodes of one group
    subroots = common.stored(rounds[-1].select(F.lit("").alias("grp"), F.col("grp").alias("name"), F.col("h").alias("subroot")))
    tops = climbed(common.stored(positions(subroots, ["name"]).withColumn("h", F.col("subroot"))))
    start = tops[-1].select("grp", F.col("h").alias("root"))
    nothing = F.array().cast("array<struct<l:string,r:string>>")
    named = descended(tops, start.withColumn("path", nothing)).select(F.col("name").alias("grp"), "subroot", "root", "path")
    rows = descended(rounds, common.stored(named))
    siblings = F.concat_ws("", F.transform("path", lambda s: F.concat(s["l"], s["r"])))
    fold = F.aggregate("path", F.coalesce("other", "h"), lambda h, s: digest(F.concat(s["l"], h, s["r"])))
    return rows.select(
        "doc_id", F.col("h").alias("leaf"), "subroot", "root", digest(siblings).alias("proof_sha256"), fold.alias("folded_root")
    ).withColumn("verified", F.col("folded_root") == F.col("root"))


def dataset_root(docs: DataFrame) -> str | None:
    """The root alone, without any proof; None for an empty table."""
    placed = positions(common.stored(leaves(docs).drop("other")), ["doc_id", "leaf", "row"])
    rounds = climbed(common.stored(placed.withColumnRenamed("leaf", "h").drop("row")))
    subroots = common.stored(rounds[-1].select(F.lit("").alias("grp"), F.col("grp").alias("name"), "h"))
    found = climbed(common.stored(positions(subroots, ["name"])))[-1].first()
    return found and found["h"]
