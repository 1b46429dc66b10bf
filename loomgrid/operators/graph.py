"""Graph queries on all boards at once: boards are dealt out whole, and go through ``boardwise``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomgrid.operators import boardwise

#: Bits of a node's number below the board's: row and column of up to 1024 each.
BITS = 20


def ensure_checkpoints(df: DataFrame) -> None:
    from loomgrid.sources.tables import shared_folder

    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession, "checkpoints"))


def node(r: str = "r", c: str = "c", board: str = "board_id"):
    """Number of a place; one beyond 1024 rows or columns is an error, as it would be another's."""
    inside = F.col(r).between(0, 1023) & F.col(c).between(0, 1023)
    return F.when(inside | F.col(r).isNull() | F.col(c).isNull(), F.shiftleft(F.col(board).cast("long"), BITS) + F.col(r) * 1024 + F.col(c)).otherwise(F.raise_error(F.lit("a board has more than 1024 rows or columns")).cast("long"))


def placed(rows: DataFrame, x: str = "x") -> DataFrame:
    """``rows`` with the number of their place; those without a place go."""
    return rows.withColumn(x, node()).filter(F.col(x).isNotNull())


def connected_components(cells: DataFrame, links: DataFrame) -> DataFrame:
    """(board_id, r, c, component): the smallest place reachable over links (board_id, r, c, nr, nc)."""
    ways = links.select("board_id", node().alias("x"), node("nr", "nc").alias("y")).filter("x is not null and y is not null")
    rows = placed(cells).select("board_id", "x", F.lit(None).cast("long").alias("y")).unionByName(ways)
    labels = boardwise.each(rows, boardwise.linked, "x long, l long")
    return labels.select(*place_of(), F.col("l").bitwiseAND((1 << BITS) - 1).cast("int").alias("component"))


def in_pieces(cells: DataFrame) -> DataFrame:
    """``cells`` with ``component``, the smallest place that neighbours of one value lead to."""
    rows = placed(cells)
    return boardwise.each(rows, boardwise.same_value, StructType([x for x in rows.schema if x.name != "x"]).add("component", "integer"))


def in_rooms(cells: DataFrame, borders: DataFrame) -> DataFrame:
    """``cells`` with ``component``, the smallest place that neighbours lead to which no border (board_id, layer h below or v right of a cell, r, c, v) parts."""
    drawn = placed(borders.filter("v = 1 and layer in ('h', 'v') and r between 0 and 1023 and c between 0 and 1023")).select("board_id", "x", F.col("layer").alias("wall"))
    rows = placed(cells).withColumn("wall", F.lit(None).cast("string")).unionByName(drawn, allowMissingColumns=True)
    return boardwise.each(rows, boardwise.rooms, StructType([x for x in rows.schema if x.name not in ("x", "wall")]).add("component", "integer"))


def rooms(cells: DataFrame, borders: DataFrame) -> DataFrame:
    """(board_id, r, c, component) of rooms."""
    return in_rooms(cells.select("board_id", "r", "c"), borders)


def same_value(cells: DataFrame) -> DataFrame:
    """(board_id, r, c, component) of neighbours of one value."""
    return in_pieces(cells.select("board_id", "r", "c", "v")).drop("v")


def progress_double_choco(cells: DataFrame, borders: DataFrame) -> DataFrame:
    """(board_id, progress): share of cells in rooms with as many white (0) as gray (1) cells, in percent."""
    room = in_rooms(cells, borders).groupBy("board_id", "component").agg(F.count_if(F.col("v") == 0).alias("white"), F.count_if(F.col("v") == 1).alias("gray"))
    good = F.sum(F.when((F.col("white") == F.col("gray")) & (F.col("white") > 0), F.col("white") + F.col("gray")).otherwise(0))
    return room.groupBy("board_id").agg((good / F.sum(F.col("white") + F.col("gray")) * 100).alias("progress"))


def place_of(x: str = "x"):
    """board_id, r and c of a node's number."""
    place = F.col(x).bitwiseAND((1 << BITS) - 1)
    return [F.shiftright(x, BITS).alias("board_id"), F.shiftright(place, 10).cast("int").alias("r"), place.bitwiseAND(1023).cast("int").alias("c")]


def searched(places: DataFrame, starts: DataFrame, goals: DataFrame | None = None) -> DataFrame:
    """Places, starts and goals in one table, for ``boardwise.search``."""
    each = [placed(x).select("board_id", "x", F.lit(k).alias("what")) for k, x in enumerate((places, starts, goals)) if x is not None]
    return reduce(DataFrame.unionByName, each)


def shortest_path(places: DataFrame, starts: DataFrame) -> DataFrame:
    """(board_id, r, c, distance): breadth-first distances from the start of each board over neighbouring places (board_id, r, c).

    Of equal parents that of the lowest rank is taken; the places of a level are
    ranked by their parent's rank, and of one parent's neighbours those above,
    below, left and right come in this order.
    """
    return boardwise.each(searched(places, starts), boardwise.distances, "x long, parent long, distance int").select(*place_of(), "distance")


def path_steps(places: DataFrame, starts: DataFrame, goals: DataFrame) -> DataFrame:
    """(board_id, step, r, c): one shortest path from each board's start to its goal, ties as in ``shortest_path``.

    A board whose goal is reached goes no further; those whose goal isn't reached have no rows.
    """
    steps = boardwise.each(searched(places, starts, goals), boardwise.way_back, "x long, distance int")
    return steps.select(F.col("distance").alias("step"), *place_of()).select("board_id", "step", "r", "c")


def loop_order(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(board_id, r, c, position): places along the loop through each board's start.

    ``edges`` (board_id, r, c, nr, nc) on which every place has two; ``starts``
    (board_id, r, c).  Of the two ways round the one to the smaller
    neighbour is taken; loops away from the start are left out.
    """
    ways = edges.select("board_id", node().alias("x"), node("nr", "nc").alias("y")).filter("x is not null and y is not null")
    rows = ways.unionByName(placed(starts).select("board_id", "x", F.lit(None).cast("long").alias("y")))
    return boardwise.each(rows, boardwise.around, "x long, position int").select(*place_of(), "position")
