"""Audit of boards of pencils: a head, a rectangular body behind it, and an open trail through it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.operators import graph
from loomgrid.operators.audit import verdict
from loomgrid.operators.joins import kept, long

PLACE = ["board_id", "r", "c"]
#: By a head's value (up, down, left, right): the step to its body, and the wall between them as (layer, step to the cell that carries it).
HEADS = {-1: ((1, 0), "h", (0, 0)), -2: ((-1, 0), "h", (-1, 0)), -3: ((0, 1), "v", (0, 0)), -4: ((0, -1), "v", (0, -1))}


def heads_of(cells: DataFrame, layers: DataFrame) -> DataFrame:
    """(board_id, r, c, d): a board's own heads, and the player's where it has none."""
    drawn = layers.filter("layer = 'hd'").select(*PLACE, F.col("v").alias("hd"))
    return cells.join(long(drawn), PLACE, "left").select(*PLACE, F.when(F.col("v") < 0, F.col("v")).otherwise(F.col("hd")).alias("d")).filter("d < 0")


def by_head(column: int):
    """What ``HEADS`` says of a head's value: 0 the step to the body, 2 that to the cell of the wall."""
    return [F.coalesce(*[F.when(F.col("d") == d, F.lit(row[column][k])) for d, row in HEADS.items()]) for k in (0, 1)]


def walls(heads: DataFrame, layers: DataFrame) -> DataFrame:
    """(board_id, layer h or v, r, c, v): drawn edges, and those between heads and their bodies."""
    drawn = layers.filter("layer in ('eh', 'ev') and v = 1").select("board_id", F.substring("layer", 2, 1).alias("layer"), "r", "c")
    dr, dc = by_head(2)
    implied = heads.select("board_id", F.coalesce(*[F.when(F.col("d") == d, F.lit(row[1])) for d, row in HEADS.items()]).alias("layer"), (F.col("r") + dr).alias("r"), (F.col("c") + dc).alias("c"))
    return drawn.unionByName(implied).distinct().withColumn("v", F.lit(1))


def trail_links(layers: DataFrame) -> DataFrame:
    """(board_id, r, c, nr, nc): drawn pieces of trails, both ways, with ``way``: 0 left, 1 right, 2 up, 3 down."""
    flat = F.col("layer") == "th"
    one = layers.filter("layer in ('th', 'tv') and v = 1").select(*PLACE, F.when(flat, F.col("r")).otherwise(F.col("r") + 1).alias("nr"), F.when(flat, F.col("c") + 1).otherwise(F.col("c")).alias("nc"), F.when(flat, 1).otherwise(3).alias("way"))
    return one.unionByName(one.select("board_id", F.col("nr").alias("r"), F.col("nc").alias("c"), F.col("r").alias("nr"), F.col("c").alias("nc"), (F.col("way") - 1).alias("way")))


def audit_pencils(cells: DataFrame, layers: DataFrame) -> DataFrame:
    """Every cell belongs to exactly one pencil: a head, the rectangle behind it, and a trail as long as the rectangle's cells and clues say.

    Cells: (board_id, r, c, v), negative a head, positive a clue; layers: (board_id, layer, r, c, v) of an answer,
    trails th and tv, heads hd, edges eh and ev.

    A trail without its head falls into arms, one for each neighbour of the head.  Arms that don't branch are
    paths whose one end is that neighbour: no place in them has three links, and the neighbour has one at most.
    If both neighbours are in one arm it comes back to the head, and is followed from the one on the left, or
    else the right, above, below.  Heads that share an arm claim it twice.
    """
    heads = kept(heads_of(cells, layers), "heads")
    links = kept(trail_links(layers), "links")
    # Bodies.
    rooms = kept(graph.rooms(cells, walls(heads, layers)).withColumnRenamed("component", "room"), "rooms")
    dr, dc = by_head(0)
    at = heads.select("board_id", F.col("r").alias("hr"), F.col("c").alias("hc"), (F.col("r") + dr).alias("r"), (F.col("c") + dc).alias("c")).join(long(rooms), PLACE, "left").select("board_id", "hr", "hc", "room")
    clue = rooms.join(long(cells), PLACE).join(long(heads.select(*PLACE, F.lit(True).alias("head"))), PLACE, "left")
    box = clue.groupBy("board_id", "room").agg(
        F.count("*").alias("n"), ((F.max("r") - F.min("r") + 1) * (F.max("c") - F.min("c") + 1)).alias("area"), F.count("head").alias("heads"), F.min(F.when(F.col("v") > 0, F.col("v"))).alias("low"), F.max("v").alias("high")
    )
    bodies = at.join(long(box), ["board_id", "room"], "left")
    # Arms, and the links between places that are no heads.
    inner = links.join(long(heads.select(*PLACE)), PLACE, "left_anti").join(long(heads.select("board_id", F.col("r").alias("nr"), F.col("c").alias("nc"))), ["board_id", "nr", "nc"], "left_anti")
    places = links.select("board_id", F.col("nr").alias("r"), F.col("nc").alias("c")).distinct().join(long(heads.select(*PLACE)), PLACE, "left_anti")
    degree = inner.groupBy(*PLACE).agg(F.count("*").alias("d"))
    arms = kept(graph.connected_components(places, inner).withColumnRenamed("component", "arm").join(long(degree), PLACE, "left").withColumn("d", F.coalesce("d", F.lit(0))), "arms")
    sizes = arms.groupBy("board_id", "arm").agg(F.count("*").alias("size"), F.max("d").alias("most"))
    ends = links.join(long(heads), PLACE).select("board_id", F.col("r").alias("hr"), F.col("c").alias("hc"), F.col("nr").alias("r"), F.col("nc").alias("c"), "way")
    met = ends.join(long(arms), PLACE, "left").select("board_id", "hr", "hc", "way", "arm", "d")  # no arm: the neighbour is a head, too
    followed = met.groupBy("board_id", "hr", "hc", "arm").agg(F.count("*").alias("n"), F.min_by("d", "way").alias("d")).join(long(sizes), ["board_id", "arm"], "left")
    trails = followed.groupBy("board_id", "hr", "hc").agg(F.sum("n").alias("links"), F.sum("size").alias("length"), F.every(F.coalesce((F.col("most") <= 2) & (F.col("d") <= 1), F.lit(False))).alias("plain"))
    both = bodies.join(long(trails), ["board_id", "hr", "hc"], "left")
    fits = "n = area and heads = 0 and links <= 2 and plain and length = n and coalesce(low, n) = n and (high <= 0 or high = n)"
    bad = both.filter(f"not coalesce({fits}, false)")
    # Claims.
    claimed = heads.select(*PLACE).unionByName(rooms.join(long(at), ["board_id", "room"]).select(*PLACE)).unionByName(arms.join(long(followed.select("board_id", "arm")), ["board_id", "arm"]).select(*PLACE))
    count = cells.select(*PLACE).join(long(claimed.groupBy(*PLACE).agg(F.count("*").alias("n"))), PLACE, "left").filter("n is null or n <> 1")
    return verdict(cells, bad, count)
