"""Operator 11, ranked lexical search over bit-sliced Bloom signatures.

The index is a table of blocks.  A block holds documents whose signatures have
one width; its matrix has a row per signature bit and a column per document,
so that the and of a term's rows is a bitmap of the documents that may hold
it.  A document's signature holds (term, level) for every level that the
term's count reaches (``reaches``), so the slices of a term, each weighted by
what a higher count adds to the score, sum up to an upper bound of its share,
with the document's own length in it.  Bounds are never too low: a Bloom
filter errs towards presence only, and a score rises with the count.

Search is exact.  Documents of the highest bounds, ``top`` an item, are scored
from their texts; the last of their scores is one that the result can't fall
below.  Every document whose bound is not provably below it is scored from its
whole text, however many these are, and the ``top`` best of each item stay.

Items are taken in chunks of bounded size (``CHUNK_BYTES`` of text), so what a
task holds and what is broadcast (``top`` documents an item of the chunk) does
not grow with the documents.  A null text has no terms; documents without
terms are in no block and no count.  Rows that share a doc_id are documents
each; rows without doc_id rank before others of their score.  Rows that share
an item_id are one item with the terms of all of them; an item without terms
has no rows.  Empty tables give an empty result.  Columns other than
doc_id, item_id and text are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgrid.llm.shared import Workspace

#: Bits per entry of a full signature, rows of the matrix that an entry sets, least entries of a width.
BITS, PROBES, LEAST_ENTRIES = 12, 4, 64
#: Documents of a block, and cells of its matrix, at most (8 documents at least).
BLOCK_DOCS, BLOCK_CELLS = 1024, 2**23
#: Text of a chunk of items; cells of (terms x documents) that a task holds at once.
CHUNK_BYTES, CELLS = 2**19, 2**25
#: Stands for a missing doc_id.
NO_ID = -(2**63)
#: Digits, letters and all bytes from 0x80 on make terms; A-Z are lower-cased; the rest separates.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: str | None) -> Counter:
    """Terms of a text, as UTF-8, with their counts."""
    return Counter((text or "").encode().translate(TABLE).split())


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_factor(n, n_docs: int, n_terms: int):
    """m of documents with ``n`` terms."""
    return 100 - 50 + (50 * n * n_docs) // n_terms


def share(tf, m):
    """A term's score without its weight."""
    return (1000000000 * tf) // (1000 * tf + 20 * m)


def reaches() -> np.ndarray:
    """Counts at which a new level begins: 1, 2, 3, 4, 6, 8, 12 and so on."""
    return np.array([1] + [x for k in range(1, 40) for x in (2**k, 3 * 2 ** (k - 1))], np.int64)


def mixed(hashes: np.ndarray, levels: np.ndarray | int, probe: int) -> np.ndarray:
    """A 64-bit number per (term hash, level, probe)."""
    step = np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        x = hashes.astype(np.uint64) + step * (np.asarray(levels, np.uint64) * np.uint64(PROBES) + np.uint64(probe + 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


INDEX = "docs int, terms long, ids binary, lengths binary, counts binary, width long, matrix binary"


def block(held: list[tuple], width: int) -> tuple:
    """A row of the index from (d, number of terms, highest count, hashes, levels) of its documents, in the order of d."""
    held.sort(key=lambda x: x[0])
    matrix = np.zeros((width, -(-len(held) // 8) * 8), bool)
    columns = np.repeat(np.arange(len(held)), [len(x[3]) for x in held])
    hashes, levels = np.concatenate([x[3] for x in held]), np.concatenate([x[4] for x in held])
    for probe in range(PROBES):
        matrix[mixed(hashes, levels, probe) % np.uint64(width), columns] = True
    ids, lengths, counts = (np.array([x[k] for x in held], np.int64) for k in range(3))
    return len(held), int(lengths.sum()), ids.tobytes(), lengths.tobytes(), counts.tobytes(), width, np.packbits(matrix, axis=1).tobytes()


def index(docs: DataFrame) -> DataFrame:
    """Blocks of all documents that have a term."""
    import pyarrow as pa

    kinds = [pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.binary()]

    def row(made: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(made, kinds, strict=True)], names=[x.split()[0] for x in INDEX.split(", ")])

    def run(batches):
        begins, open_blocks = reaches(), {}
        for batch in batches:
            for d, text in zip(batch.column("d").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = terms(text)
                if not found:
                    continue
                hashes = np.fromiter(map(crc32, found), np.uint64, len(found))
                tfs = np.fromiter(found.values(), np.int64, len(found))
                n_levels = np.searchsorted(begins, tfs, "right")
                entries = int(n_levels.sum())
                first = np.repeat(np.cumsum(n_levels) - n_levels, n_levels)
                width = BITS << max(entries - 1, LEAST_ENTRIES - 1).bit_length()
                held = open_blocks.setdefault(width, [])
                held.append((d, int(tfs.sum()), int(tfs.max()), np.repeat(hashes, n_levels), np.arange(entries) - first))
                if len(held) >= max(8, min(BLOCK_DOCS, BLOCK_CELLS // width // 8 * 8)):
                    yield row(block(open_blocks.pop(width), width))
        for width, held in open_blocks.items():
            yield row(block(held, width))

    return docs.select(F.coalesce("doc_id", F.lit(NO_ID)).cast("long").alias("d"), "text").mapInArrow(run, INDEX)


class Items:
    """A chunk of items: their terms as positions in one vocabulary."""

    def __init__(self, rows: list):
        held: dict = {}
        for r in rows:
            held.setdefault(r["item_id"], set()).update(terms(r["text"]))
        self.ids = [i for i, own in held.items() if own]
        self.vocabulary = {t: k for k, t in enumerate(sorted(set().union(*held.values())))}
        self.terms = [np.array(sorted(self.vocabulary[t] for t in held[i]), np.int64) for i in self.ids]
        self.hashes = np.fromiter(map(crc32, self.vocabulary), np.uint64, len(self.vocabulary))


def document_frequencies(docs: DataFrame, vocabulary: dict[bytes, int]) -> list[int]:
    """Documents that hold each term; one row a term reaches the driver."""
    import pyarrow as pa

    def run(batches):
        seen = np.zeros(len(vocabulary), np.int64)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen[[vocabulary[t] for t in terms(text).keys() & vocabulary.keys()]] += 1
        k = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(seen[k])], names=["term", "df"])

    out = [0] * len(vocabulary)
    for r in docs.select("text").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        out[r["term"]] = r["df"]
    return out


class Bounds:
    """Upper bounds of a chunk's scores over blocks of the index."""

    def __init__(self, items: Items, weights: np.ndarray, n_docs: int, n_terms: int):
        self.items, self.weights, self.n_docs, self.n_terms = items, weights, n_docs, n_terms
        self.begins = reaches()

    def levels(self, slices: np.ndarray) -> np.ndarray:
        """Per term and document, how many of the term's levels the signatures may hold."""
        out = np.zeros((len(self.items.hashes), slices.shape[1] * 8), np.uint8)
        alive, held = np.arange(len(out)), None
        for level in range(len(self.begins)):
            rows = slices[mixed(self.items.hashes[alive], level, 0) % np.uint64(len(slices))]
            for probe in range(1, PROBES):
                rows &= slices[mixed(self.items.hashes[alive], level, probe) % np.uint64(len(slices))]
            held = rows if held is None else held & rows
            some = held.any(axis=1)
            alive, held = alive[some], held[some]
            if not len(alive):
                break
            out[alive] += np.unpackbits(held, axis=1)
        return out

    def of(self, row: dict) -> tuple[np.ndarray, np.ndarray]:
        """Documents of a block and (items x documents) bounds."""
        ids, lengths, counts = (np.frombuffer(row[c], np.int64) for c in ("ids", "lengths", "counts"))
        slices = np.frombuffer(row["matrix"], np.uint8).reshape(row["width"], -1)
        out = np.zeros((len(self.items.ids), len(ids)), np.int64)
        step = max(1, CELLS // max(1, len(self.items.hashes)) // 8)
        m = length_factor(lengths, self.n_docs, self.n_terms)
        most = np.concatenate([[0], self.begins[1:] - 1])  # count at most, by the number of levels
        for left in range(0, slices.shape[1], step):
            own = slice(left * 8, min(len(ids), (left + step) * 8))
            levels = self.levels(slices[:, left : left + step])[:, : own.stop - own.start]
            shares = share(np.minimum(most[: int(levels.max(initial=0)) + 1, None], counts[own]), m[own])
            for i, positions in enumerate(self.items.terms):
                out[i, own] = (np.take_along_axis(shares, levels[positions], axis=0) * self.weights[positions, None]).sum(axis=0)
        return ids, out


def highest(blocks: DataFrame, bounds: Bounds, top: int) -> DataFrame:
    """(item, d, bound): each task's ``top`` documents of the highest bounds of every item."""
    import pyarrow as pa

    def run(batches):
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in bounds.items.ids]
        for batch in batches:
            for row in batch.to_pylist():
                ids, made = bounds.of(row)
                for i, (held, held_ids) in enumerate(best):
                    new = np.flatnonzero(made[i] >= max(1, held[-1] if len(held) == top else 1))
                    if len(new):
                        held, held_ids = np.concatenate([held, made[i][new]]), np.concatenate([held_ids, ids[new]])
                        order = np.lexsort((held_ids, -held))[:top]
                        best[i] = held[order], held_ids[order]
        item = np.repeat(np.arange(len(best)), [len(x) for x, _ in best])
        if len(item):
            yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(np.concatenate([x for _, x in best])), pa.array(np.concatenate([x for x, _ in best]))], names=["item", "d", "bound"])

    return blocks.mapInArrow(run, "item long, d long, bound long")


def not_excluded(blocks: DataFrame, bounds: Bounds, floors: np.ndarray, floor_ids: np.ndarray) -> DataFrame:
    """(d, items): the items for which a document may be among the best."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, made = bounds.of(row)
                may = (made > floors[:, None]) | ((made == floors[:, None]) & (ids[None, :] <= floor_ids[:, None]))
                some = np.flatnonzero(may.any(axis=0))
                if len(some):
                    yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array([np.flatnonzero(may[:, j]) for j in some], pa.list_(pa.int64()))], names=["d", "items"])

    return blocks.mapInArrow(run, "d long, items array<long>")


def scored(docs: DataFrame, wanted: DataFrame, bounds: Bounds, top: int) -> DataFrame:
    """(item, doc_id, d, score, rank): exact scores of the wanted documents, the ``top`` best of each item."""
    import pyarrow as pa

    def run(batches):
        vocabulary = bounds.items.vocabulary
        for batch in batches:
            out = []
            for doc_id, d, text, items in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "d", "text", "items")), strict=True):
                found = terms(text)
                m = length_factor(sum(found.values()), bounds.n_docs, bounds.n_terms)
                parts = np.zeros(len(vocabulary), np.int64)
                for t in found.keys() & vocabulary.keys():
                    k = vocabulary[t]
                    parts[k] = bounds.weights[k] * share(found[t], m)
                out += [(i, doc_id, d, s) for i in items if (s := int(parts[bounds.items.terms[i]].sum())) > 0]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["item", "doc_id", "d", "score"])

    keyed = docs.select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).cast("long").alias("d"), "text")
    scores = keyed.join(wanted, "d").select("doc_id", "d", "text", "items").mapInArrow(run, "item long, doc_id long, d long, score long")
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "d"))).filter(F.col("rank") <= top)


def search(spark: SparkSession, docs: DataFrame, items: DataFrame, top: int = 50) -> DataFrame:
    """item_id, rank, doc_id and score of the ``top`` documents of every item."""
    space = Workspace(spark, "search")
    blocks = space.table(index(docs), "index")
    n_docs, n_terms = blocks.agg(F.sum("docs"), F.sum("terms")).first()
    empty = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0]
    if not n_docs or not size:
        return empty
    chunks, made = -(-size // CHUNK_BYTES), []
    for chunk in range(chunks):
        own = Items(items.filter(F.pmod(F.xxhash64("item_id"), F.lit(chunks)) == chunk).select("item_id", "text").collect())  # about CHUNK_BYTES
        if not own.ids:
            continue
        weights = np.array([weight(n_docs, df) for df in document_frequencies(docs, own.vocabulary)], np.int64)
        bounds = Bounds(own, weights, n_docs, n_terms)
        firsts = highest(blocks, bounds, top).withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("bound"), "d"))).filter(F.col("rank") <= top)
        few = firsts.groupBy("d").agg(F.collect_set("item").alias("items"))  # at most `top` documents an item of the chunk
        floors, floor_ids = np.zeros(len(own.ids), np.int64), np.full(len(own.ids), NO_ID, np.int64)
        for r in scored(docs, F.broadcast(few), bounds, top).filter(F.col("rank") == top).select("item", "score", "d").collect():
            floors[r["item"]], floor_ids[r["item"]] = r["score"], r["d"]
        wanted = space.table(not_excluded(blocks, bounds, floors, floor_ids).groupBy("d").agg(F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")), f"wanted_{chunk}")
        names = spark.createDataFrame(list(enumerate(own.ids)), "item long, item_id long")  # the chunk's items
        best = scored(docs, wanted, bounds, top).join(F.broadcast(names), "item")
        made.append(space.table(best.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), f"best_{chunk}"))
        space.drop(f"wanted_{chunk}")
    space.drop("index")
    for k, part in enumerate(made):
        empty = part if k == 0 else empty.unionByName(part)
    return empty
