"""Operator 3, near-duplicate documents by bottom-k sketches of one hash function.

Sketch: the ``K`` smallest hashes of a document's shingle set.  Documents with
the same set are one class from here on.  Inverted lists are keyed by ``RUN``
adjacent retained values.  Two sets of a Jaccard similarity of 0.8 or more
share such a run for certain if the sketches are whole sets (each value of the
union that only one set has breaks at most three runs, and they are at most a
fifth of the union) and but for a chance below 1e-7 otherwise; sets of 4 or 5,
where that counting fails, are also listed by their smallest values, which is
exact by the prefix rule.

Lists are resolved in two turns.  First every class of a list is paired with
the list's most central one only (that whose runs are the most common), and
with all others where the list has at most ``SMALL`` classes.  Pairs whose
union sketch estimates a similarity below ``ESTIMATE`` go, the rest is verified
on full sets.  Lists whose classes are then in one component need no more
pairs.  The classes of the lists that are left get an exact second turn: a
class of which more than a fifth of the shingles occur in no other such class
has no partner and goes; the others are listed by their rarest shingles as far
as the prefix rule asks, and paired across components where sizes and
positions leave room for a link.  So no link between components is lost, and a
large group of near copies doesn't become all its pairs.

Null and empty texts have the empty set and are linked with nothing; a row
without doc_id is linked with nothing and kept.  Rows that share a doc_id are
one document with all of their texts: each text is compared on its own, and
the classes of one document are in one component.  Texts are read whole.  Repeated rows give repeated results; an empty
table gives an empty one; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgrid.llm import shingles, tokens
from loomgrid.llm.components import components
from loomgrid.llm.quality_rules import let
from loomgrid.llm.shared import Workspace

K = 48
RUN = 3
#: Sketch estimate below which a pair isn't verified: 5 standard deviations under 0.8.
ESTIMATE = 0.5
#: Classes of a list that are all paired.
SMALL = 12


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, t): rows with a hash of their text, which tells the texts of one doc_id apart."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("t"))


def sketches(docs: DataFrame, words: int, k: int = K) -> DataFrame:
    """(doc_id, t, n, signature, sketch): set size, hash of the whole set, its k smallest hashes."""
    import pyarrow as pa

    def run(batches):
        import xxhash

        parts = (batch.slice(at, 512) for batch in batches for at in range(0, batch.num_rows, 512))
        rows_of = (((d, t), text) for part in parts for d, text, t in zip(*[c.to_pylist() for c in part.columns], strict=True))
        for rows in tokens.slices(rows_of, 1024):
            sets = [shingles.shingle_set(text, words) for _, text in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([d for (d, _), _ in rows], pa.int64()),
                    pa.array([t for (_, t), _ in rows], pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    pa.array([s[:k] for s in sets], pa.list_(pa.int64())),
                ],
                names=["doc_id", "t", "n", "signature", "sketch"],
            )

    return keyed(docs).mapInArrow(run, "doc_id long, t long, n long, signature binary, sketch array<long>")


def texts_of(docs: DataFrame, classes: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text): the text that stands for each class of ``nodes`` (node)."""
    wanted = classes.select("node", F.col("doc").alias("doc_id"), "t").join(nodes.select("node").distinct(), "node", "left_semi")
    return keyed(docs).join(wanted, ["doc_id", "t"]).select("node", "text").dropDuplicates(["node"])


def shared_documents(made: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): links between the classes that one doc_id has rows of, each with the first of them."""
    several = made.groupBy("doc_id").agg(F.min("signature").alias("low"), F.max("signature").alias("high")).filter("low <> high").select("doc_id")
    nodes = made.join(several, "doc_id", "left_semi").select("doc_id", "signature").distinct().join(classes.select("signature", "node"), "signature")
    first = nodes.groupBy("doc_id").agg(F.min("node").alias("a"))
    return nodes.join(first, "doc_id").filter("node <> a").select("a", F.col("node").alias("b")).distinct()


def postings(classes: DataFrame) -> DataFrame:
    """(key, node, n): one row per class and run of adjacent retained values."""
    runs = F.transform(F.sequence(F.lit(0), F.size("sketch") - RUN), lambda i: F.xxhash64(*[F.get("sketch", i + k) for k in range(RUN)]))
    runs = F.when(F.size("sketch") >= RUN, runs).otherwise(F.array().cast("array<long>"))
    single = F.when(F.col("n").between(4, 5), F.transform(F.slice("sketch", F.lit(1), (F.col("n") - 3).cast("int")), lambda v: F.xxhash64(F.lit(1), v))).otherwise(F.array().cast("array<long>"))
    return classes.filter("n >= 4").select("node", "n", F.explode(F.concat(runs, single)).alias("key"))


def may_match(a: str, b: str, percent: int) -> str:
    return f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})"


def distinct_pairs(pairs: DataFrame, percent: int) -> DataFrame:
    """(a, b), a < b, of (node, n, other, m) whose sizes allow a link."""
    near = pairs.filter("node <> other").filter(may_match("n", "m", percent))
    return near.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def rare_pairs(space: Workspace, left: DataFrame, docs: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """All pairs of ``left`` (node, n, c) across components that the exact prefix rule admits."""
    import pyarrow as pa

    def run(batches):
        for rows in tokens.slices(tokens.batch_rows(batches)):
            yield pa.RecordBatch.from_arrays(
                [pa.array([k for k, _ in rows], pa.int64()), pa.array([shingles.shingle_set(t, words) for _, t in rows], pa.list_(pa.int64()))], names=["node", "shingles"]
            )

    own = texts_of(docs, classes, left)
    each = space.table(own.mapInArrow(run, "node long, shingles array<long>").select("node", F.explode("shingles").alias("s")), "left-shingles")
    often = each.groupBy("s").agg(F.count("*").alias("f")).filter("f > 1")
    met = space.table(each.join(often, "s"), "left-met")
    need = F.ceil(F.col("n") * percent / 100)  # shingles that a partner has to share
    live = met.groupBy("node").agg(F.count("*").alias("shared")).join(left, "node").filter(F.col("shared") >= need)
    order = Window.partitionBy("node").orderBy("f", "s")
    prefix = (
        met.join(live, "node")
        .withColumn("at", F.col("n") - F.col("shared") + F.row_number().over(order) - 1)  # unshared ones stand before
        .filter(F.col("at") <= F.col("n") - need)
        .select("s", "node", "n", "c", "at")
    )
    prefix = space.table(prefix, "prefixes")
    several = prefix.groupBy("s").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low <> high").select("s")
    prefix = prefix.join(several, "s", "left_semi")
    other = prefix.select("s", F.col("node").alias("other"), F.col("n").alias("m"), F.col("c").alias("d"), F.col("at").alias("bt"))
    room = F.least(F.col("n") - F.col("at"), F.col("m") - F.col("bt"))
    pairs = prefix.join(other, "s").filter("c < d").filter((100 + percent) * room >= percent * (F.col("n") + F.col("m")))
    return distinct_pairs(pairs.select("node", "n", "other", "m"), percent)


def estimated(pairs: DataFrame, classes: DataFrame, k: int = K) -> DataFrame:
    """``pairs`` whose union sketch doesn't rule them out."""
    s = classes.select("node", "sketch")
    both = pairs.join(s.select(F.col("node").alias("a"), F.col("sketch").alias("sa")), "a").join(s.select(F.col("node").alias("b"), F.col("sketch").alias("sb")), "b")
    union = let(F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k), lambda u: F.size(F.array_intersect(F.array_intersect(F.col("sa"), F.col("sb")), u)) / F.size(u))
    return both.filter(union >= ESTIMATE).select("a", "b")


def verified(space: Workspace, pairs: DataFrame, docs: DataFrame, classes: DataFrame, words: int, percent: int, name: str) -> DataFrame:
    """``pairs`` (a, b) of classes that are links on the full sets of their texts."""
    import pyarrow as pa

    ids = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node")))
    texts = space.table(texts_of(docs, classes, ids), f"{name}-texts")
    sides = [texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}")) for c in "ab"]
    both = pairs.join(sides[0], "a").join(sides[1], "b").select("a", "b", "text_a", "text_b")

    def run(batches):
        held: dict[int, np.ndarray] = {}

        def of(node, text):
            if node not in held:
                if len(held) >= 64:
                    held.pop(next(iter(held)))
                held[node] = shingles.shingle_set(text, words)
            return held[node]

        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part, good = batch.slice(at, 128), []
                for a, b, x, y in zip(*[c.to_pylist() for c in part.columns], strict=True):
                    s, t = of(b, y), of(a, x)
                    if min(len(s), len(t)):
                        shared = len(np.intersect1d(s, t, assume_unique=True))
                        good.append(100 * shared >= percent * (len(s) + len(t) - shared))
                    else:
                        good.append(False)
                kept = part.select([0, 1]).filter(pa.array(good, pa.bool_()))
                if kept.num_rows:
                    yield kept

    return both.mapInArrow(run, "a long, b long")


def link(spark: SparkSession, docs: DataFrame, words: int = 5, percent: int = 80, space: Workspace | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row."""
    space = space or Workspace(spark, "near-dedup")
    made = space.table(sketches(docs, words), "sketches")
    known = made.filter("n > 0 and doc_id is not null")
    first_of = known.groupBy("signature").agg(F.min(F.struct("doc_id", "t")).alias("of"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = space.table(first_of.select("signature", F.monotonically_increasing_id().alias("node"), F.col("of.doc_id").alias("doc"), F.col("of.t").alias("t"), "n", "sketch"), "classes")
    # Lists of two classes or more; all others go before anything else is done with them.
    every = postings(classes)
    shared = every.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1")
    lists = space.table(every.join(shared, "key"), "lists")
    weight = lists.groupBy("node").agg(F.sum(F.log("c")).alias("w"))
    members = lists.join(weight, "node")
    heads = members.groupBy("key").agg(F.max_by(F.struct("node", "n"), F.struct("w", "node")).alias("head"))
    stars = members.join(heads, "key").select("node", "n", F.col("head.node").alias("other"), F.col("head.n").alias("m"))
    few = lists.filter(F.col("c") <= SMALL)
    small = few.join(few.select("key", F.col("node").alias("other"), F.col("n").alias("m")), "key").filter("node < other").select("node", "n", "other", "m")
    first = space.table(estimated(distinct_pairs(stars.unionByName(small), percent), classes), "pairs-1")
    links = space.table(verified(space, first, docs, classes, words, percent, "turn-1").unionByName(shared_documents(known, classes)), "links-1")
    labels = components(space, links, "components-1")
    labelled = lists.select("key", "node", "n").join(labels, "node", "left").withColumn("c", F.coalesce("component", "node"))
    several = labelled.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low <> high").select("key")
    left = space.table(labelled.join(several, "key", "left_semi").select("node", "n", "c").distinct(), "left")
    second = space.table(estimated(rare_pairs(space, left, docs, classes, words, percent), classes), "pairs-2")
    links = links.unionByName(space.table(verified(space, second, docs, classes, words, percent, "turn-2"), "links-2"))
    final = components(space, links, "components-last")
    joined = classes.select("signature", "node", "doc").join(final, "node", "left")
    lone = joined.filter("component is null").select("signature", F.col("doc").alias("component_id"))
    grouped = joined.filter("component is not null")
    lowest = grouped.groupBy("component").agg(F.min("doc").alias("component_id"))
    labelled = lone.unionByName(grouped.join(lowest, "component").select("signature", "component_id"))
    return made.join(labelled, "signature", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
