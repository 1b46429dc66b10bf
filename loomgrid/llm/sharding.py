"""Operator 9, sharding by sampled splitters [native].

Law ``bytes``: shards differ by at most one document's size from the mean.

Rows are ordered by (hash of the text, doc_id), so equal texts stand together
and a group of copies larger than a shard is divided by doc_id.  A sample of
keys, drawn with a chance proportional to size and bounded by ``SAMPLE`` keys
per range, gives quantile boundaries for many more ranges than shards.  Ranges
that turn out overfull are sampled again, more densely, and subdivided.  Byte
and row totals of the ranges, a bounded table, then turn running sums inside
each range into exact places in the whole order, so that no task sees more
than one range and sampling only decides how evenly the work is spread.

A null text has size 0 plus the overhead and the crc32 of no bytes; a null
doc_id comes first among equal texts.  Repeated rows each get a slot of their
own; ties are identical rows.  An empty table gives an empty result.  Extra
columns are not read by ``assign``.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgrid.llm.shared import Workspace, lookup

#: Bytes that a row counts besides its text (fixed by the contract).
OVERHEAD = 16
#: Ranges per shard, and expected sampled keys per range.
RANGES, SAMPLE = 64, 12
#: A range of more than so many times its share is subdivided.
OVERFULL = 4
KEY = "array<array<struct<h:bigint,d:bigint>>>"


def keys(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32 and the sort key (h, d) of every row; texts stay where they are."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(whole) + OVERHEAD).cast("long").alias("size"),
        F.crc32(whole.cast("binary")).alias("text_crc32"),
        F.xxhash64(whole).alias("h"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("d"),
    )


def range_of(bounds: list[tuple[int, int]]) -> Column:
    """Number of boundaries at or before the row's key, by two levels of search."""
    if not bounds:
        return F.lit(0)
    width = max(1, round(len(bounds) ** 0.5))
    groups = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    held = F.from_json(F.lit(json.dumps([[{"h": h, "d": d} for h, d in g] for g in [[g[0] for g in groups], *groups]])), KEY)
    key = F.struct(F.col("h").alias("h"), F.col("d").alias("d"))
    group = F.size(F.filter(F.get(held, F.lit(0)), lambda x: x <= key))
    within = F.size(F.filter(F.get(held, group), lambda x: x <= key))
    return F.when(group == 0, F.lit(0)).otherwise((group - 1) * width + within)


def sample(rows: DataFrame, chance: Column, turn: int) -> list[tuple[int, int]]:
    """Keys of the rows that a hash of (key, turn) selects; the same ones in every run."""
    uniform = F.shiftrightunsigned(F.xxhash64("h", "d", F.lit(turn)), 11) / F.lit(2.0**53)
    return sorted((r["h"], r["d"]) for r in rows.filter(uniform < chance).select("h", "d").collect())


def quantiles(drawn: list[tuple[int, int]], parts: int) -> list[tuple[int, int]]:
    return [drawn[len(drawn) * i // parts] for i in range(1, parts)] if drawn else []


def split(rows: DataFrame, ranges: int, most_turns: int = 4) -> tuple[list[tuple[int, int]], list[int], list[int]]:
    """Boundaries, and bytes and rows before each range."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    if not total:
        return [], [0], [0]
    bounds = quantiles(sample(rows, F.col("size") * (ranges * SAMPLE / total), 0), ranges)
    for turn in range(1, most_turns + 1):
        bounds = sorted(set(bounds))
        stats = {r["range"]: (r["size"], r["n"]) for r in rows.groupBy(range_of(bounds).alias("range")).agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()}
        parts = [-(-size * ranges // total) if n > 1 and size * ranges > OVERFULL * total else 1 for size, n in (stats.get(k, (0, 0)) for k in range(len(bounds) + 1))]
        if turn == most_turns or max(parts) == 1:
            break
        chances = [p * SAMPLE / stats[k][0] if p > 1 else 0.0 for k, p in enumerate(parts)]
        drawn = sample(rows, F.col("size") * lookup(chances, range_of(bounds), "double"), turn)
        new, edges = [], [None, *bounds, None]
        for k, p in enumerate(parts):
            if p > 1:
                own = [x for x in drawn if (edges[k] is None or x >= edges[k]) and (edges[k + 1] is None or x < edges[k + 1])]
                new += quantiles(own, p)
        if not set(new) - set(bounds):
            break
        bounds += new
    sizes, counts = [0], [0]
    for k in range(len(bounds)):
        size, n = stats.get(k, (0, 0))
        sizes.append(sizes[-1] + size)
        counts.append(counts[-1] + n)
    return bounds, sizes, counts


def places(space: Workspace, docs: DataFrame, shards: int, text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, h, d, shard, slot) of every row."""
    rows = space.table(keys(docs, text), "keys")
    bounds, sizes, counts = split(rows, shards * RANGES)
    total = rows.agg(F.sum("size")).first()[0] or 1
    inside = Window.partitionBy("range").orderBy("h", "d", "text_crc32", "size")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        rows.withColumn("range", range_of(bounds))
        .withColumns({"end": F.sum("size").over(upto), "nth": F.row_number().over(inside)})
        .withColumns({"end": F.col("end") + lookup(sizes, F.col("range")), "nth": F.col("nth") + lookup(counts, F.col("range")) - 1})
        .withColumn("shard", F.expr(f"int(((2 * end - size) * {shards}L) div {2 * total}L)"))
    )
    placed = space.table(placed.select("doc_id", "size", "text_crc32", "h", "d", "shard", "nth"), "placed")
    first = {r["shard"]: r["first"] for r in placed.groupBy("shard").agg(F.min("nth").alias("first")).collect()}  # one row per shard
    starts = [first.get(k, 0) for k in range(shards)]
    return placed.withColumn("slot", (F.col("nth") - lookup(starts, F.col("shard"))).cast("long")).drop("nth")


def assign(spark: SparkSession, docs: DataFrame, shards: int = 40, text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row."""
    space = Workspace(spark, "sharding")
    made = places(space, docs, shards, text).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
    space.drop("keys")
    return made


def write(spark: SparkSession, docs: DataFrame, path: str, shards: int = 40) -> None:
    """Write ``docs`` as one folder per shard, in the order of the slots; all rows, repeated ones and those without doc_id included.

    Rows of one text and doc_id are interchangeable and take one of their places each.
    """
    space = Workspace(spark, "sharding")
    alike = Window.partitionBy("h", "d").orderBy("shard", "slot")
    spots = places(space, docs, shards).withColumn("alike", F.row_number().over(alike)).select("h", "d", "alike", "shard", "slot")
    kept = docs.drop("shard", "slot")
    inner = {c: f"own_{k}" for k, c in enumerate(kept.columns)}  # names of the join can't clash
    # In the order of all they hold, so that a task that runs again numbers them the same.
    own = Window.partitionBy("h", "d").orderBy(F.to_json(F.struct(*inner.values())))
    renamed = kept.select(*[F.col(f"`{c}`").alias(n) for c, n in inner.items()])
    keyed = renamed.withColumns({"h": F.xxhash64(F.coalesce(F.col(inner["text"]), F.lit(""))), "d": F.coalesce(F.col(inner["doc_id"]).cast("long"), F.lit(-(2**63)))}).withColumn("alike", F.row_number().over(own))
    joined = keyed.join(spots, ["h", "d", "alike"]).select(*[F.col(n).alias(c) for c, n in inner.items()], "shard", "slot")
    joined.repartition(shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    space.drop(*space.tables)
