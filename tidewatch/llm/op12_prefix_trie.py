"""Prefix trie of conversations by the Euler-tour technique, with DataFrame functions (Python only streams the digests of members).

1. Turns get their place in the conversation, which is rebuilt. A sequence of turns is known by its length and by two 64-bit XORs over
   hashes of (place, turn). XOR runs over blocks of places, so a conversation with a third of all rows is spread over many tasks.
2. Nodes are the distinct sequences; members, last texts and parents come from partial aggregation and a join by sequence.
3. Every node has an enter and an exit arc. An arc's successor follows from first child, next sibling and parent alone. Siblings are
   cut into ranges before they look for the next one, so a node may have any number of children.
4. The tour is list-ranked: rounds of coin tosses take a quarter of the arcs out of the list (those that toss 1 after an arc that tosses
   0), and put them back in reverse order once the rest is ranked. The work of all rounds is a few times the list; the last LAST arcs,
   a fixed number, are walked in one task.
5. Positions on the tour are dense, so prefix sums of leaves and savings take blocks of positions; a subtree is what lies between its
   node's two arcs.
6. A node's digest streams the sorted ids of the conversations that end there, in pieces; only the hasher's state is held.

Edge cases: rows without conv_id take no part; a null role or text is the empty text; equal turns are ordered by the md5 of role and
text, and repeated rows are turns of their own; a conversation that loses all its turns ends at the root; an empty table gives no
nodes; texts of any length are reduced to a hash and a number of characters before the first shuffle; other columns are dropped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import drop, keep, table

PLACES = 1024  # turns of one conversation that a task sums up together
SPAN = 12  # bits of tour positions in a block of prefix sums
LAST = 1 << 16  # arcs that one task walks
SHARE, HEADS = 100, 6  # conversations c - c % SHARE lend their first crc32(c) % HEADS turns
NODE, SEQUENCE = ["conv_id", "depth"], ["depth", "k1", "k2"]


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, turn_key, n): turns numbered from 0, their hash and code points. Stored."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    key = F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text))
    slim = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", key.alias("turn_key"), F.char_length(text).cast("long").alias("n"),
        F.monotonically_increasing_id().alias("tie"))
    ranged = keep(slim.repartitionByRange("conv_id", "turn", "turn_key", "tie").withColumn("block", F.spark_partition_id()), "turns")
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranged.groupBy("conv_id", "block").agg(F.count(F.lit(1)).alias("c")).select(
        "conv_id", "block", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "turn_key", "tie")
    numbered = ranged.withColumn("at", F.row_number().over(inside)).join(starts, ["conv_id", "block"])
    placed = keep(numbered.select("conv_id", (F.col("start") + F.col("at") - 1).alias("pos"), "turn_key", "n"), "placed")
    drop(ranged)
    return placed


def rebuilt(placed: DataFrame) -> DataFrame:
    """(conv_id, depth, turn_key, n, last): the turns after the lent heads, from depth 1, and a row of depth 0 for every conversation."""
    sizes = placed.groupBy("conv_id").agg(F.count(F.lit(1)).alias("size"))
    sizes = keep(sizes.withColumn("base", F.col("conv_id") - F.col("conv_id") % SHARE).withColumn(
        "h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS), "sizes")
    lender = sizes.select(F.col("conv_id").alias("base"), F.col("size").alias("lends"))
    plan = sizes.join(lender, "base", "left").withColumn("m", F.least("h", F.coalesce("lends", F.lit(0))))
    plan = keep(plan.withColumn("total", F.col("m") + F.greatest(F.col("size") - F.col("h"), F.lit(0))), "plan")
    drop(sizes)
    head = placed.where(F.col("pos") < HEADS - 1).select(F.col("conv_id").alias("base"), "pos", "turn_key", "n")
    lent = plan.join(head, "base").where("pos < m").select("conv_id", (F.col("pos") + 1).alias("depth"), "turn_key", "n", "total")
    own = placed.join(plan.select("conv_id", "h", "m", "total"), "conv_id").where("pos >= h").select(
        "conv_id", (F.expr("m + pos - h") + 1).alias("depth"), "turn_key", "n", "total")
    top = plan.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit("").alias("turn_key"), F.lit(0).cast("long").alias("n"), "total")
    return lent.unionByName(own).unionByName(top).withColumn("last", F.col("depth") == F.col("total")).drop("total")


def sequences(steps: DataFrame) -> DataFrame:
    """Adds k1, k2 (the turns up to this one) and p1, p2 (those before it). Depth 0 is 0, 0. Stored."""
    def own(seed: int) -> Column:
        return F.when(F.col("depth") == 0, F.lit(0).cast("long")).otherwise(F.xxhash64(F.lit(seed), "depth", "turn_key"))

    rows = steps.withColumns({"e1": own(1), "e2": own(2), "block": F.floor(F.col("depth") / PLACES)}).drop("turn_key")
    totals = rows.groupBy("conv_id", "block").agg(F.bit_xor("e1").alias("t1"), F.bit_xor("e2").alias("t2"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("conv_id", "block", F.bit_xor("t1").over(earlier).alias("c1"), F.bit_xor("t2").over(earlier).alias("c2")).where("block > 0")
    inside = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"s{i}": F.bit_xor(f"e{i}").over(inside) for i in (1, 2)}).join(carried, ["conv_id", "block"], "left")
    rows = rows.withColumns({f"k{i}": F.col(f"s{i}").bitwiseXOR(F.coalesce(f"c{i}", F.lit(0).cast("long"))) for i in (1, 2)})
    parents = [F.col(f"k{i}").bitwiseXOR(F.col(f"e{i}")).alias(f"p{i}") for i in (1, 2)]
    return keep(rows.select("conv_id", "depth", "n", "last", "k1", "k2", *parents), "sequences")


def nodes(steps: DataFrame) -> DataFrame:
    """One row per distinct sequence: conv_id, depth, k1, k2, n_convs, n, and the conv_id of the parent (null at the root). Stored."""
    found = keep(steps.groupBy(*SEQUENCE).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("n").alias("n"), F.max("p1").alias("p1"), F.max("p2").alias("p2")), "distinct")
    above = found.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent"))
    out = keep(found.join(above, ["depth", "p1", "p2"], "left").select(*NODE, "k1", "k2", "n_convs", "n", "parent"), "nodes")
    drop(found)
    return out


def linked(found: DataFrame) -> DataFrame:
    """Adds n_children, the first child and the next sibling (smallest member first). Stored."""
    children = found.where("parent is not null").groupBy("parent", "depth").agg(F.count(F.lit(1)).alias("n_children"), F.min("conv_id").alias("child"))
    children = children.select(F.col("parent").alias("conv_id"), (F.col("depth") - 1).alias("depth"), "n_children", "child")
    ranged = keep(found.repartitionByRange("depth", "parent", "conv_id").withColumn("block", F.spark_partition_id()), "siblings")
    family = ["depth", "parent"]
    edge = ranged.groupBy(*family, "block").agg(F.min("conv_id").alias("first"))
    edge = edge.select(*family, "block", F.lead("first").over(Window.partitionBy(*family).orderBy("block")).alias("beyond")).where("beyond is not null")
    inside = F.lead("conv_id").over(Window.partitionBy(*family, "block").orderBy("conv_id"))
    rows = ranged.withColumn("inside", inside).join(edge, [*family, "block"], "left").withColumn("sibling", F.coalesce("inside", "beyond"))
    out = keep(rows.drop("block", "inside", "beyond").join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "linked")
    drop(ranged)
    return out


def tour(family: DataFrame) -> DataFrame:
    """The arcs (a, b) with their successors (sa, sb): a is the node's conv_id, b is 2 * depth to enter and 2 * depth + 1 to leave."""
    d = F.col("depth") * 2
    enter = F.struct(F.col("conv_id").alias("a"), d.alias("b"), F.coalesce("child", "conv_id").alias("sa"), F.when(F.col("child").isNull(), d + 1).otherwise(d + 2).alias("sb"))
    leave = F.struct(F.col("conv_id").alias("a"), (d + 1).alias("b"), F.coalesce("sibling", "parent").alias("sa"),
                     F.when(F.col("sibling").isNotNull(), d).when(F.col("parent").isNotNull(), d - 1).alias("sb"))
    return family.select(F.inline(F.array(enter, leave)))


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A list of at most LAST arcs -> position of each."""
    rows = [r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns))]
    step = {(a, b): (sa, sb, w) for a, b, sa, sb, w in rows}
    after = {(sa, sb) for sa, sb, _ in step.values()}
    out, at, where = [], next((x for x in step if x not in after), None), 0
    while at in step:
        out.append((*at, where))
        *at, w = step[at]
        at, where = tuple(at), where + w
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], names=["a", "b", "at"])


def list_rank(arcs: DataFrame, last: int = LAST) -> DataFrame:
    """(a, b, at): the position of every arc of one linked list (a, b) -> (sa, sb), from 0. Stored."""
    current = keep(arcs.withColumn("w", F.lit(1).cast("long")), "list")
    removed: list[DataFrame] = []
    while current.count() > last:
        def tossed(a: str, b: str, toss: int = len(removed)) -> Column:
            return F.pmod(F.xxhash64(F.lit(toss), a, b), F.lit(2)) == 1

        ahead = F.col("sa").isNotNull() & tossed("sa", "sb")
        marked = current.withColumns({"one": tossed("a", "b"), "ahead": ahead})
        before = marked.where("not one and ahead").select(F.col("a").alias("ua"), F.col("b").alias("ub"), F.col("sa").alias("a"), F.col("sb").alias("b"), F.col("w").alias("uw"))
        met = keep(marked.where("one").drop("one", "ahead").join(before, ["a", "b"], "left"), "met")
        stays = marked.where("not one and not ahead").select("a", "b", "sa", "sb", "w")
        alone = met.where("ua is null").select("a", "b", "sa", "sb", "w")
        spliced = met.where("ua is not null").select(F.col("ua").alias("a"), F.col("ub").alias("b"), "sa", "sb", (F.col("uw") + F.col("w")).alias("w"))
        after = keep(stays.unionByName(alone).unionByName(spliced), "list")
        removed.append(met)
        drop(current)
        current = after
    ranked = keep(current.select("a", "b", "sa", "sb", "w").coalesce(1).mapInArrow(_walk, "a long, b long, at long"), "ranked")
    drop(current)
    for met in reversed(removed):
        out = met.where("ua is not null").select("a", "b", "ua", "ub", "uw").join(ranked.select(F.col("a").alias("ua"), F.col("b").alias("ub"), "at"), ["ua", "ub"])
        wider = keep(ranked.unionByName(out.select("a", "b", (F.col("at") + F.col("uw")).alias("at"))), "ranked")
        drop(ranked)
        drop(met)
        ranked = wider
    return ranked


def subtree_sums(ranked: DataFrame, family: DataFrame) -> DataFrame:
    """(conv_id, depth, n_leaves, saved_tokens) from prefix sums over the positions of the arcs."""
    enters = F.col("b") % 2 == 0
    value = family.select(*NODE, (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("n")).alias("saved"))
    arcs = ranked.select(F.col("a").alias("conv_id"), F.floor(F.col("b") / 2).alias("depth"), enters.alias("enters"), "at").join(value, NODE)
    sums = ["leaf", "saved"]
    arcs = arcs.withColumns({c: F.when(F.col("enters"), F.col(c)).otherwise(0) for c in sums} | {"block": F.shiftright("at", SPAN)})
    blocks = arcs.groupBy("block").agg(*[F.sum(c).alias(c) for c in sums]).withColumn("wide", F.shiftright("block", SPAN))
    wides = blocks.groupBy("wide").agg(*[F.sum(c).alias(f"w_{c}") for c in sums])  # one row per 2 ** (2 * SPAN) arcs

    def earlier(column: str, window) -> Column:
        return F.coalesce(F.sum(column).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    wides = wides.select("wide", *[earlier(f"w_{c}", Window.partitionBy(F.lit(0)).orderBy("wide")).alias(f"w_{c}") for c in sums])
    starts = blocks.join(wides, "wide").select("block", *[(earlier(c, Window.partitionBy("wide").orderBy("block")) + F.col(f"w_{c}")).alias(f"s_{c}") for c in sums])
    inside = Window.partitionBy("block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    through = arcs.withColumns({f"t_{c}": F.sum(c).over(inside) for c in sums}).join(starts, "block")
    # up to the exit arc, less what lies before the enter arc
    return through.groupBy(*NODE).agg(*[F.sum(F.when(F.col("enters"), F.col(c) - F.col(f"t_{c}") - F.col(f"s_{c}")).otherwise(F.col(f"t_{c}") + F.col(f"s_{c}"))).alias(name)
                                        for c, name in zip(sums, ("n_leaves", "saved_tokens"))])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (depth, k1, k2, conv_id) -> (depth, k1, k2, first id, ids joined), a row per sequence and batch."""
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = np.stack([np.asarray(batch.column(c)) for c in range(3)])
        starts = np.concatenate([[0], np.flatnonzero((marks[:, 1:] != marks[:, :-1]).any(axis=0)) + 1])
        ids = np.asarray(batch.column(3))
        texts = [",".join(map(str, part.tolist())) for part in np.split(ids, starts[1:])]
        yield pa.RecordBatch.from_arrays([*(pa.array(m[starts]) for m in marks), pa.array(ids[starts]), pa.array(texts)], names=[*SEQUENCE, "first", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by (depth, k1, k2, first) -> one digest per sequence."""
    last, state = None, None
    for batch in batches:
        done = []
        for *key, _, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if key == last:
                state.update(b"," + ids.encode())
                continue
            if last:
                done.append((*last, state.hexdigest()))
            last, state = key, hashlib.sha256(ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=[*SEQUENCE, "ends_sha256"])
    if last:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*last, state.hexdigest())], names=[*SEQUENCE, "ends_sha256"])


def member_digests(steps: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of the sequences at which a conversation ends."""
    ends = steps.where("last").select(*SEQUENCE, "conv_id")
    order = [*SEQUENCE, "conv_id"]
    pieces = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_pieces, "depth long, k1 long, k2 long, first long, ids string")
    gathered = pieces.repartition(*SEQUENCE).sortWithinPartitions(*SEQUENCE, "first")
    return gathered.mapInArrow(_digests, "depth long, k1 long, k2 long, ends_sha256 string")


def prefix_trie(steps: DataFrame) -> DataFrame:
    """The trie of any sequences (conv_id, depth, turn_key, n, last) that hold depths 0, 1, .. once each; n weighs a turn."""
    found = sequences(steps)
    family = linked(nodes(found))
    sums = subtree_sums(list_rank(tour(family)), family)
    whole = family.join(member_digests(found), SEQUENCE, "left").join(sums, NODE)
    return whole.select(*NODE, F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens",
                        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(rebuilt(turns(table(spark, sf_dir, "conversations"))))


# DuckDB has no crc32: bytes are folded in bit by bit with the reversed polynomial 0xEDB88320
CRC = """xor(list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
  lambda crc, byte: list_reduce(CAST(range(8) AS BIGINT[]), lambda x, i: xor(x >> 1, (x & 1) * 3988292384), xor(crc, byte)), 4294967295), 4294967295)"""
ORACLE = f"""WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id
    ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS pos FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS size, conv_id - conv_id % {SHARE} AS base, {CRC} % {HEADS} AS h FROM t GROUP BY conv_id),
p AS (SELECT c.*, least(c.h, coalesce(b.size, 0)) AS m FROM c LEFT JOIN c b ON b.conv_id = c.base),
r AS (SELECT p.conv_id, pos + 1 AS depth, role, text FROM p JOIN t ON t.conv_id = p.base AND pos < m
  UNION ALL SELECT conv_id, m + pos - h + 1, role, text FROM p JOIN t USING (conv_id) WHERE pos >= h
  UNION ALL SELECT conv_id, 0, '', '' FROM p),
s AS (SELECT conv_id, depth, length(text) AS n, depth = max(depth) OVER (PARTITION BY conv_id) AS last,
  string_agg(length(role) || ':' || length(text) || ':' || role || text, '') OVER (PARTITION BY conv_id ORDER BY depth) AS prefix FROM r),
k AS (SELECT *, min(conv_id) OVER (PARTITION BY depth, prefix) AS node FROM s),
nodes AS (SELECT node, depth, count(*) AS n_convs, max(n) AS n, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (last) AS ends FROM k GROUP BY node, depth),
tied AS (SELECT v.*, u.node AS parent FROM nodes v LEFT JOIN k u ON u.conv_id = v.node AND u.depth = v.depth - 1),
kids AS (SELECT parent, depth - 1 AS depth, count(*) AS n_children FROM tied WHERE parent IS NOT NULL GROUP BY parent, depth),
whole AS (SELECT tied.*, coalesce(n_children, 0) AS n_children FROM tied LEFT JOIN kids ON kids.parent = tied.node AND kids.depth = tied.depth),
sums AS (SELECT u.node, u.depth, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum((n_convs - 1) * w.n) AS BIGINT) AS saved_tokens
  FROM whole w JOIN k u ON u.conv_id = w.node AND u.depth <= w.depth GROUP BY u.node, u.depth)
SELECT w.node AS conv_id, CAST(w.depth AS BIGINT) AS depth, parent AS parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM whole w JOIN sums USING (node, depth)"""
