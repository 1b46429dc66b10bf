"""Operator 10, best-two-fit packing of documents into sequences.

Only lengths decide which pieces share a sequence, and a piece's length is at
most the sequence's.  So the plan is made on the histogram of lengths (at most
``capacity`` rows, whatever the input): fill a bin greedily with the longest
length that fits, then replace its smallest piece with two unpacked ones that
fit the widened gap more tightly, and repeat the pattern as often as the
histogram allows.  The plan is a list of rank intervals per length; a piece
finds its place by its rank among the pieces of its length, and those ranks
come from counts per (length, salt) group, so that a length that a third of
all pieces share is never one task.

A null text is an empty one: its only id is the end id.  Only documents longer
than ``capacity`` are cut, the first piece taking the remainder; full pieces
are sequences of their own.  Repeated rows are packed each; ties in the order
of ranks are broken by (doc_id, piece, start, ids_crc32).  An empty table gives
no rows.  Extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgrid.llm import tokens
from loomgrid.llm.shared import Workspace, lookup

#: Rows that one (length, salt) group has on average at most.
GROUP_ROWS = 500
#: Groups that are summed up before the sums are.
COARSE = 1000


class Slot(NamedTuple):
    """Pieces of ``length`` with ranks ``low`` to ``high - 1`` go to sequences from ``base`` on, at ``offset``."""

    length: int
    low: int
    high: int
    base: int
    offset: int


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of ``n`` ids."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int) -> DataFrame:
    """Encode ``docs`` and cut: (doc_id, piece, start, length, ids_crc32)."""
    import pyarrow as pa

    fields = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches):
        encoder, end = tokens.encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for rows in tokens.slices(tokens.batch_rows(batches)):
            out = []
            for (doc_id, _), ids in zip(rows, encoder.encode([t for _, t in rows]), strict=True):
                ids += end
                for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    out.append((doc_id, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*out), kinds, strict=True)], names=fields)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def patterns(counts: dict[int, int], capacity: int) -> Iterator[tuple[list[int], int]]:
    """Bin patterns (lengths in the order of their offsets) with how often each is used.

    Uses up ``counts`` exactly.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    top = capacity
    while True:
        while top and not left[top]:
            top -= 1
        if not top:
            return
        free, used, gap = left.copy(), [], capacity
        while gap:  # greedily: the longest that fits
            fits = np.flatnonzero(free[1 : gap + 1])
            if not len(fits):
                break
            length = int(fits[-1]) + 1
            n = min(int(free[length]), gap // length)
            used += [length] * n
            free[length] -= n
            gap -= length * n
        if gap and len(used) > 1:  # two for the smallest one
            small = used[-1]
            free[small] += 1
            pair = _best_two(free, gap + small)
            if pair and sum(pair) > small:
                used[-1:] = sorted(pair, reverse=True)
            # the smallest stays otherwise
        need: dict[int, int] = {}
        for length in used:
            need[length] = need.get(length, 0) + 1
        times = min(int(left[length]) // n for length, n in need.items())
        for length, n in need.items():
            left[length] -= n * times
        yield used, times


def _best_two(free: np.ndarray, room: int) -> tuple[int, int] | None:
    """Two free lengths of the largest sum within ``room``."""
    have = free[: room + 1] > 0
    best = np.maximum.accumulate(np.where(have, np.arange(len(have)), 0))  # longest free length up to each
    long = np.flatnonzero(have)
    long = long[long < room]
    if not len(long):
        return None
    mate = best[np.minimum(room - long, long)]
    lone = (mate == long) & (free[long] < 2)
    if lone.any():
        mate = np.where(lone, best[np.maximum(long - 1, 0)], mate)
    total = np.where(mate > 0, long + mate, 0)
    k = int(total.argmax())
    return (int(long[k]), int(mate[k])) if total[k] else None


def plan(counts: dict[int, int], capacity: int) -> tuple[list[Slot], int]:
    """Slots for all pieces, and the number of sequences."""
    slots, taken, base = [], {}, 0
    for used, times in patterns(counts, capacity):
        at = 0
        for length in used:
            low = taken.get(length, 0)
            slots.append(Slot(length, low, low + times, base, at))
            taken[length] = low + times
            at += length
        base += times
    return slots, base


def ranked(cut_pieces: DataFrame, histogram: dict[int, int], capacity: int) -> DataFrame:
    """``cut_pieces`` with ``rank``: gapless from 0 among the pieces of one length."""
    salts = [max(1, -(-histogram.get(k, 0) // GROUP_ROWS)) for k in range(capacity + 1)]
    salt = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), lookup(salts, F.col("length").cast("int")))
    salted = cut_pieces.withColumn("salt", salt)
    groups = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    # Sums of groups in two levels, so that the groups of a length that very many pieces share are no single task either.
    groups = groups.withColumn("thousand", F.floor(F.col("salt") / COARSE))
    outer = Window.partitionBy("length").orderBy("thousand").rowsBetween(Window.unboundedPreceding, -1)
    inner = Window.partitionBy("length", "thousand").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    coarse = groups.groupBy("length", "thousand").agg(F.sum("n").alias("n")).select("length", "thousand", F.coalesce(F.sum("n").over(outer), F.lit(0)).alias("base"))
    starts = groups.join(coarse, ["length", "thousand"]).select("length", "salt", (F.col("base") + F.coalesce(F.sum("n").over(inner), F.lit(0))).alias("first"))
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")
    return salted.withColumn("nth", F.row_number().over(inside)).join(starts, ["length", "salt"]).withColumn("rank", F.col("first") + F.col("nth") - 1).drop("salt", "nth", "first")


def place(spark: SparkSession, cut_pieces: DataFrame, capacity: int) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece."""
    histogram = {r["length"]: r["n"] for r in cut_pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    slots, _ = plan(histogram, capacity)
    by_length: dict[int, list[Slot]] = {}
    for s in slots:
        by_length.setdefault(s.length, []).append(s)
    kind = T.StructType(
        [T.StructField("length", T.LongType())] + [T.StructField(k, T.ArrayType(T.LongType())) for k in ("lows", "bases", "offsets")]
    )
    # One row per length with its slots in rank order: at most `capacity` rows.
    table = spark.createDataFrame([(k, [s.low for s in v], [s.base for s in v], [s.offset for s in v]) for k, v in by_length.items()], kind)
    joined = ranked(cut_pieces, histogram, capacity).join(F.broadcast(table), "length")
    k = F.size(F.filter("lows", lambda low: low <= F.col("rank"))) - 1
    return joined.withColumn("k", k).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.get("bases", F.col("k")) + F.col("rank") - F.get("lows", F.col("k"))).alias("sequence_id"), F.get("offsets", F.col("k")).alias("offset")
    )


def pack(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 2, capacity: int = 1024) -> DataFrame:
    """Encode, cut and pack all documents."""
    return place(spark, Workspace(spark, "packing").table(pieces(docs, tokenizer, end_id, capacity), "pieces"), capacity)
