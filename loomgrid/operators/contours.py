"""Audit of boards of half-filled cells: closed contours, rectangles by their bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.operators import boardwise, graph
from loomgrid.operators.audit import verdict
from loomgrid.operators.joins import kept, long

PLACE = ["board_id", "r", "c"]
STEPS, CORNERS = boardwise.STEPS, boardwise.CORNERS


def closed_contours(shades: DataFrame) -> DataFrame:
    """(board_id, x, first): half-filled places on contours that close with four turns, and the first place of each, which is its topmost.

    ``shades``: (board_id, r, c, k), k = 0 for white and 1 to 4 for half-filled places.
    """
    rings = boardwise.each(graph.placed(shades).select("board_id", "x", "k"), boardwise.contours, "x long, first long")
    return rings.select(F.shiftright("x", graph.BITS).alias("board_id"), "x", "first")


def audit_shakashaka(cells: DataFrame, states: DataFrame) -> DataFrame:
    """Clues equal the half-filled places beside them; half-filled places lie on closed contours; white pieces are rectangles, or touch a contour that begins before them.

    Cells: (board_id, r, c, v), -1 white, 0 to 4 a clue, 5 black; states: (board_id, r, c, v), 1 to 4 half-filled,
    5 marked and 0 or missing unset, which are white both.
    """
    shown = cells.join(long(states.select(*PLACE, F.col("v").alias("s"))), PLACE, "left").withColumn("s", F.when(F.col("s").between(1, 4), F.col("s")).otherwise(0))
    shown = kept(shown, "shades")
    beside = F.explode(F.array(*[F.struct((F.col("r") + dr).alias("r"), (F.col("c") + dc).alias("c")) for dr, dc in ((-1, 0), (1, 0), (0, -1), (0, 1))])).alias("p")
    near = shown.filter("s > 0").select("board_id", beside).select("board_id", "p.*").groupBy(*PLACE).agg(F.count("*").alias("n"))
    wrong = shown.filter("v between 0 and 4").join(long(near), PLACE, "left").filter("v <> coalesce(n, 0)")
    shades = shown.filter("v = -1").select(*PLACE, F.col("s").alias("k"))
    contours = kept(closed_contours(shades), "contours")
    loose = shades.filter("k > 0").select("board_id", graph.node().alias("x")).join(long(contours), "x", "left_anti")
    whites = graph.same_value(shades.filter("k = 0").select(*PLACE, F.lit(0).alias("v")))
    box = whites.groupBy("board_id", "component").agg(F.count("*").alias("n"), (F.max("r") - F.min("r") + 1).alias("rows"), (F.max("c") - F.min("c") + 1).alias("columns"))
    rows_of = lambda x: F.col(x).bitwiseAND((1 << graph.BITS) - 1)  # noqa: E731  a place without its board
    ring = contours.select("board_id", F.shiftright(rows_of("x"), 10).cast("int").alias("r"), rows_of("x").bitwiseAND(1023).cast("int").alias("c"), rows_of("first").alias("first"))
    touched = ring.select("board_id", "first", beside).select("board_id", "first", "p.*").join(long(whites), PLACE).filter("first < component").select("board_id", "component").distinct()
    return verdict(cells, wrong, loose, box.filter("n <> rows * columns").join(long(touched), ["board_id", "component"], "left_anti"))
