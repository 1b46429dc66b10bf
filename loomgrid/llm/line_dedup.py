"""Operator 12, line dedup: sorted hashes, streamed first occurrences, keep bitmaps.

A line's key is the line without white space at its ends and with A-Z
lower-cased; keys of at least ``LEAST`` code points count.  The 128-bit hash of
each such line, with its document and position, is range-partitioned and
sorted by (hash, document, position).  One pass over the sorted rows sees a
key's first document first: lines of later documents go.  A key whose rows
span partitions is settled by one summary row per partition (its first and
last key, and the first document of the last one), so a key that a third of
all lines share is read by many tasks.  What goes comes back as positions, one
compressed bitmap per document; texts are moved once, to meet their bitmaps.

All rows of one doc_id are one document; rows without doc_id are one document
after all others.  Rows of one doc_id and one text share a bitmap, each row
gets its own result.  A null text is an empty one: one empty line, kept.
Several lines of a key in its first document all stay, and so does everything
that is shorter.  An empty table gives an empty result.  Columns other than
doc_id and text are not read.  A document's positions are gathered in one
task: they are bounded by the document, not by the corpus.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.llm.shared import SPACES, Workspace

#: Code points that a key has at least.
LEAST = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands for a missing doc_id.
NO_ID = 2**63 - 1
#: Rows of the streaming pass: a line that goes, a line that an earlier partition may still outdo, a partition's summary.
GOES, OPEN, SUMMARY = 0, 1, 2
STREAM = "kind int, part int, d long, t long, pos int, h1 long, h2 long, last1 long, last2 long"


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (never null), and what identifies them: d, t."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text")).select("doc_id", "text", F.coalesce("doc_id", F.lit(NO_ID)).cast("long").alias("d"), F.xxhash64("text").alias("t"))


def hashed_lines(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(h1, h2, d, t, pos) of every line that counts."""
    lines = keyed(docs).select("d", "t", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    keys = lines.select("d", "t", "pos", F.translate(F.btrim("line", F.lit(SPACES)), UPPER, LOWER).alias("key")).filter(F.length("key") >= least)
    return keys.select(F.xxhash64(F.lit(1), "key").alias("h1"), F.xxhash64(F.lit(2), "key").alias("h2"), "d", "t", "pos")


def first_occurrences(batches):
    """Stream a sorted partition: later documents' lines, the first key's other lines, and the summary."""
    import pyarrow as pa
    from pyspark import TaskContext

    part, names = TaskContext.get().partitionId(), [x.split()[0] for x in STREAM.split(", ")]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()] + [pa.int64()] * 4

    def batch(columns: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    head = last = owner = None
    for rows in batches:
        if not rows.num_rows:
            continue
        h1, h2, d, t, pos = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2", "d", "t", "pos"))
        new = np.ones(len(d), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        new[0] = (h1[0], h2[0]) != last
        head = head or (h1[0], h2[0])
        owners = np.concatenate([[0 if owner is None else owner], d[new]])[np.cumsum(new)]  # the first document of each row's key
        goes = d != owners
        said = goes | ((h1 == head[0]) & (h2 == head[1]))
        last, owner, n = (h1[-1], h2[-1]), owners[-1], int(said.sum())
        if n:
            yield batch([np.where(goes[said], GOES, OPEN), np.full(n, part), d[said], t[said], pos[said], *[[None] * n] * 4])
    if head:
        yield batch([[SUMMARY], [part], [owner], [None], [None], [head[0]], [head[1]], [last[0]], [last[1]]])


def owners_before(summaries: list) -> list[tuple[int, int]]:
    """(partition, first document of its first key), where that key begins in an earlier partition."""
    out, key, owner = [], None, None
    for s in sorted(summaries, key=lambda s: s["part"]):
        head, last, own = (s["h1"], s["h2"]), (s["last1"], s["last2"]), s["d"]
        if head == key:
            out.append((s["part"], owner))
            own = owner if last == head else own
        key, owner = last, own
    return out


def bitmaps(batches):
    """Compressed bitmaps, one bit a line, the first line in the highest bit; 1: the line stays."""
    import pyarrow as pa

    for rows in batches:
        out = []
        for n, dropped in zip(rows.column("n_lines").to_pylist(), rows.column("dropped").to_pylist(), strict=True):
            keep = np.ones(n, bool)
            keep[dropped] = False
            out.append(zlib.compress(np.packbits(keep).tobytes(), 1))
        n_dropped = pa.array([len(x) for x in rows.column("dropped").to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([rows.column("d"), rows.column("t"), rows.column("n_lines"), n_dropped, pa.array(out, pa.binary())], names=["d", "t", "n_lines", "n_dropped", "keep"])


def keep_bitmaps(space: Workspace, docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(d, t, n_lines, n_dropped, keep) of every distinct (doc_id, text)."""
    key = ["h1", "h2", "d", "t", "pos"]
    ranges = hashed_lines(docs, least).repartitionByRange(*key).sortWithinPartitions(*key)
    seen = space.table(ranges.mapInArrow(first_occurrences, STREAM), "occurrences")
    owners = owners_before(seen.filter(F.col("kind") == SUMMARY).collect())  # a row per partition
    goes = seen.filter(F.col("kind") == GOES)
    if owners:
        ahead = space.spark.createDataFrame(owners, "part int, owner long")
        goes = goes.unionByName(seen.filter(F.col("kind") == OPEN).join(F.broadcast(ahead), "part").filter("d <> owner").drop("owner"))
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    every = keyed(docs).select("d", "t", (breaks + 1).cast("long").alias("n_lines"), F.lit(None).cast("int").alias("pos"))
    rows = every.unionByName(goes.select("d", "t", F.lit(0).cast("long").alias("n_lines"), "pos"))
    gathered = rows.groupBy("d", "t").agg(F.max("n_lines").alias("n_lines"), F.collect_set("pos").alias("dropped"))
    return space.table(gathered.mapInArrow(bitmaps, "d long, t long, n_lines long, n_dropped long, keep binary"), "bitmaps")


def kept_lines(batches):
    """Texts without the lines that their bitmaps drop."""
    import pyarrow as pa

    for rows in batches:
        texts = []
        for text, n, dropped, keep in zip(*(rows.column(c).to_pylist() for c in ("text", "n_lines", "n_dropped", "keep")), strict=True):
            if dropped:
                bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=n)
                text = "\n".join([x for x, bit in zip(text.split("\n"), bits, strict=True) if bit])
            texts.append(text)
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("n_lines"), rows.column("n_dropped"), pa.array(texts, pa.string())], names=["doc_id", "n_lines", "n_dropped", "text"])


def apply(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text) of every row, by its bitmap."""
    joined = keyed(docs).join(kept, ["d", "t"]).select("doc_id", "text", "n_lines", "n_dropped", "keep")
    return joined.mapInArrow(kept_lines, "doc_id long, n_lines long, n_dropped long, text string")


def dedup(spark: SparkSession, docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, n_lines (before), n_dropped and the text that stays, of every row."""
    space = Workspace(spark, "line_dedup")
    made = apply(docs, keep_bitmaps(space, docs, least))
    space.drop("occurrences")
    return made
