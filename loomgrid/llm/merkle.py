"""Operator 13, Merkle manifest of a dataset with incremental witnesses.

Leaves are digests of rows; only they leave the scan.  Per group they are
numbered in order by a range partition and counts per partition, and cut to
aligned blocks of ``BLOCK`` leaves.  A block is one stream of appends: an
appended node finds its left siblings in the open run and extends the witness
of each of them; a full run closes into a parent, which is appended one level
up.  Block roots, made by many tasks, are the nodes of the next tier and are
appended the same way, until a group has one root, and the groups' roots, in
order, make one more tree.  On the way back each block gets its root's
witness as a row ahead of its leaves, so that a leaf's whole witness, its hash
and the recomputed root are made in the task that has the leaf, and no witness
is ever shuffled with a leaf.

Rows may lack any column (``-``).  Leaves of one doc_id are ordered by their
digest, rows without doc_id come first, and identical rows are leaves each;
rows without doc_id are never tampered with.  A group without value comes
before all others.  A lone leaf is its group's root, a lone group's root the
dataset's, and a witness of no siblings hashes the empty text.  An empty table
gives an empty result; columns other than the five are not read.  Texts of any
length are hashed whole.
"""

from __future__ import annotations

from hashlib import sha256
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgrid.llm.shared import Workspace

#: Children of a node, levels of a block, leaves of a block.
FAN, LEVELS = 8, 3
BLOCK = FAN**LEVELS
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def leaf(fields: list[Column]) -> Column:
    """Digest of the fields, each by its length in bytes and its value."""
    def said(c: Column) -> Column:
        value = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*[said(c) for c in fields]), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """(k, doc_id, digest, tampered): the group's key, and the digest after tampering where the row is tampered with."""
    plain = [F.col(c) for c in FIELDS]
    changed = leaf([*plain[:-1], F.translate("text", UPPER, LOWER)])
    picked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    k = F.coalesce(F.concat(F.lit("x"), "lang"), F.lit(""))  # no value: before all others
    return docs.select(k.alias("k"), F.col("doc_id").cast("long").alias("doc_id"), leaf(plain).alias("digest"), F.when(picked, changed).alias("tampered"))


def numbered(space: Workspace, rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """``rows`` with idx, gapless from 0 in its group k by ``order``, and n, the group's size."""
    ranges = rows.repartitionByRange("k", *order).sortWithinPartitions("k", *order)
    placed = space.table(ranges.withColumns({"part": F.spark_partition_id(), "seq": F.monotonically_increasing_id()}), f"{name}_ordered")
    counts = placed.groupBy("k", "part").agg(F.count("*").alias("rows"), F.min("seq").alias("first"))  # about a row per partition
    group = Window.partitionBy("k")
    before = F.coalesce(F.sum("rows").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("k", "part", (before - F.col("first")).alias("shift"), F.sum("rows").over(group).alias("n"))
    return space.table(placed.join(starts, ["k", "part"]).withColumn("idx", F.col("seq") + F.col("shift")).drop("part", "seq", "shift"), name)


class Node:
    """A node with its witness: the siblings on its left and right so far."""

    __slots__ = ("digest", "left", "right", "parent")

    def __init__(self, value: str):
        self.digest, self.left, self.right, self.parent = value, "", [], None


class Block:
    """Aligned append of nodes in order; ``runs`` holds the open subtrees of each level."""

    def __init__(self, levels: int):
        self.levels, self.runs = levels, [[] for _ in range(levels + 1)]

    def append(self, node: Node, level: int = 0) -> Node:
        run = self.runs[level]
        node.left = "".join([x.digest for x in run])
        for x in run:
            x.right.append(node.digest)
        run.append(node)
        if len(run) == FAN and level < self.levels:
            self.close(level)
        return node

    def close(self, level: int) -> None:
        run, self.runs[level] = self.runs[level], []
        parent = Node(digest("".join([x.digest for x in run])))
        for x in run:
            x.parent = parent
        self.append(parent, level + 1)

    def root(self) -> str:
        """Close what is open; the block's root."""
        for level in range(self.levels):
            if self.runs[level]:
                self.close(level)
        return self.runs[self.levels][0].digest


def witness(node: Node) -> tuple[list[str], list[str]]:
    """Left and right siblings of each level, up to the block's root."""
    lefts, rights = [], []
    while node.parent:
        lefts.append(node.left)
        rights.append("".join(node.right))
        node = node.parent
    return lefts, rights


def fold(value: str, lefts: list[str], rights: list[str]) -> str:
    """The root that a leaf's digest and its siblings give."""
    for left, right in zip(lefts, rights, strict=True):
        value = digest(left + value + right)
    return value


def levels_of(n: int) -> int:
    """Levels that a block reduces in a group of ``n`` nodes."""
    levels = 0
    while n > 1 and levels < LEVELS:
        n, levels = -(-n // FAN), levels + 1
    return levels


def streamed(batches):
    """(k, block), the row ahead of its nodes if there is one, and the nodes with their rows, block by block."""
    rows = (row for batch in batches for row in batch.to_pylist())
    for (k, block), own in groupby(rows, key=lambda r: (r["k"], r["block"])):
        ahead, nodes, stack = None, [], None
        for row in own:
            if row["digest"] is None:
                ahead = row
                continue
            stack = stack or Block(levels_of(row["n"]))
            nodes.append((stack.append(Node(row["digest"])), row))
        if stack:
            yield k, block, ahead, nodes, stack.root()


def in_blocks(rows: DataFrame) -> DataFrame:
    return rows.withColumn("block", F.expr(f"idx div {BLOCK}L")).repartition("k", "block").sortWithinPartitions("k", "block", "idx")


def arrow_rows(out: list[tuple], schema: str):
    """Rows as one Arrow batch of a schema of strings, longs, booleans and lists of strings."""
    import pyarrow as pa

    kinds = {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(zip(*out, strict=True), fields, strict=True)], names=[name for name, _ in fields])


def block_roots(space: Workspace, nodes: DataFrame, name: str) -> DataFrame:
    """(k, idx, digest, n) of the next tier."""
    schema = "k string, idx long, digest string, n long"

    def run(batches):
        for k, block, _, own, root in streamed(batches):
            yield arrow_rows([(k, block, root, -(-own[0][1]["n"] // BLOCK))], schema)

    return space.table(in_blocks(nodes.select("k", "idx", "digest", "n")).mapInArrow(run, schema), name)


def tiers(space: Workspace, nodes: DataFrame, name: str) -> list[DataFrame]:
    """``nodes``, block roots, their roots and so on, until every group has one."""
    out = [nodes]
    while (out[-1].agg(F.max("n")).first()[0] or 0) > 1:  # a turn divides by 512
        out.append(block_roots(space, out[-1], f"{name}_{len(out)}"))
    return out


ABOVE = "lefts array<string>, rights array<string>, subroot string, root string"


def with_ahead(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """Nodes by block, each block behind the row of its root's witness."""
    ahead = above.select("k", F.col("idx").alias("block"), "lefts", "rights", "subroot", "root")
    rows = nodes.withColumn("block", F.expr(f"idx div {BLOCK}L")).unionByName(ahead.withColumn("idx", F.lit(-1).cast("long")), allowMissingColumns=True)
    return rows.repartition("k", "block").sortWithinPartitions("k", "block", "idx")


def witnesses(space: Workspace, nodes: DataFrame, above: DataFrame, name: str) -> DataFrame:
    """(k, idx, lefts, rights, subroot, root): each node's witness, extended by its block's."""
    schema = f"k string, idx long, {ABOVE}"

    def run(batches):
        for k, _, up, own, _ in streamed(batches):
            out = []
            for node, row in own:
                lefts, rights = witness(node)
                out.append((k, row["idx"], lefts + up["lefts"], rights + up["rights"], up["subroot"], up["root"]))
            yield arrow_rows(out, schema)

    return space.table(with_ahead(nodes.select("k", "idx", "digest", "n"), above).mapInArrow(run, schema), name)


def proofs(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """A row per leaf: its roots, the hash of its witness, and the root recomputed from what it is now."""
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"

    def run(batches):
        for _, _, up, own, _ in streamed(batches):
            out = []
            for node, row in own:
                lefts, rights = witness(node)
                lefts, rights = lefts + up["lefts"], rights + up["rights"]
                siblings = "".join([x + y for x, y in zip(lefts, rights, strict=True)])
                folded = fold(row["tampered"] or row["digest"], lefts, rights)
                out.append((row["doc_id"], row["digest"], up["subroot"], up["root"], digest(siblings), folded, folded == up["root"]))
            yield arrow_rows(out, schema)

    return with_ahead(nodes, above).mapInArrow(run, schema)


def manifest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row."""
    space = Workspace(spark, "merkle")
    own = numbered(space, space.table(leaves(docs), "leaves"), ["doc_id", "digest", "tampered"], "numbered")
    groups = tiers(space, own, "group")
    roots = groups[-1].select(F.lit("").alias("k"), F.col("k").alias("of"), "digest")
    tops = numbered(space, roots, ["of"], "roots")
    top = tiers(space, tops, "top")
    none = F.array().cast("array<string>")
    above = top[-1].select("k", "idx", none.alias("lefts"), none.alias("rights"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    for k in range(len(top) - 2, -1, -1):
        above = witnesses(space, top[k], above, f"top_above_{k}")
    above = tops.join(above.drop("subroot"), ["k", "idx"]).select(F.col("of").alias("k"), F.lit(0).cast("long").alias("idx"), "lefts", "rights", F.col("digest").alias("subroot"), "root")
    for k in range(len(groups) - 2, 0, -1):
        above = witnesses(space, groups[k], above, f"above_{k}")
    space.drop("leaves", "numbered_ordered", "roots_ordered")
    return proofs(own, above)
