"""Boards as long tables of cells and edges, and the set-based work on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.operators.joins import long, looked_up


def explode_cells(boards: DataFrame, grid: str) -> DataFrame:
    """(board_id, r, c, v) of a matrix column."""
    rows = boards.select("board_id", F.posexplode(grid).alias("r", "row"))
    return rows.select("board_id", "r", F.posexplode("row").alias("c", "v"))


def nest_cells(cells: DataFrame) -> DataFrame:
    """(board_id, grid): the matrix again, rows and columns in order."""
    rows = cells.groupBy("board_id", "r").agg(F.sort_array(F.collect_list(F.struct("c", "v"))).alias("row"))
    whole = rows.groupBy("board_id").agg(F.sort_array(F.collect_list(F.struct("r", "row"))).alias("rows"))
    return whole.select("board_id", F.transform("rows", lambda x: F.transform(x["row"], lambda y: y["v"])).alias("grid"))


def box(r: Column, c: Column) -> Column:
    return F.floor(r / 3) * 3 + F.floor(c / 3)


def sudoku_conflicts(cells: DataFrame) -> DataFrame:
    """Filled cells whose digit occurs again in their row, column or box."""
    filled = cells.filter("v > 0").withColumn("b", box(F.col("r"), F.col("c")))
    seen = [F.count("*").over(Window.partitionBy("board_id", line, "v")) > 1 for line in ("r", "c", "b")]
    return filled.withColumns({f"_{k}": x for k, x in enumerate(seen)}).filter("_0 or _1 or _2").select("board_id", "r", "c", "v")


def line_runs(cells: DataFrame) -> DataFrame:
    """(board_id, axis, line, runs): lengths of filled runs of every row and column, [0] if none."""
    both = cells.select("board_id", F.lit("row").alias("axis"), F.col("r").alias("line"), F.col("c").alias("pos"), "v").unionByName(
        cells.select("board_id", F.lit("col").alias("axis"), F.col("c").alias("line"), F.col("r").alias("pos"), "v")
    )
    line = ["board_id", "axis", "line"]
    island = both.filter("v = 1").withColumn("g", F.col("pos") - F.row_number().over(Window.partitionBy(*line).orderBy("pos")))
    runs = island.groupBy(*line, "g").agg(F.min("pos").alias("at"), F.count("*").cast("int").alias("n"))
    ordered = runs.groupBy(*line).agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "n"))), lambda x: x["n"]).alias("runs"))
    return looked_up(both.select(*line).distinct(), ordered, line).withColumn("runs", F.coalesce("runs", F.array(F.lit(0))))


def merge_gate_runs(dashed: DataFrame) -> DataFrame:
    """(board_id, line, lo, hi): contiguous dashed cells (board_id, line, pos) as gates."""
    order = Window.partitionBy("board_id", "line").orderBy("pos")
    return dashed.withColumn("g", F.col("pos") - F.row_number().over(order)).groupBy("board_id", "line", "g").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi")).drop("g")


def covered_cells(subcells: DataFrame) -> DataFrame:
    """Global cells that any part covers, each once."""
    return subcells.select("board_id", "gr", "gc").distinct()


def neighbours(cells: DataFrame) -> DataFrame:
    """(board_id, r, c, v, nr, nc, nv): every cell with its neighbours below and to the right.

    An equi-join on the neighbour's place, so that it is hashed and not compared.
    """
    steps = F.explode(F.array(F.struct((F.col("r") + 1).alias("nr"), F.col("c").alias("nc")), F.struct(F.col("r").alias("nr"), (F.col("c") + 1).alias("nc")))).alias("step")
    other = cells.select("board_id", F.col("r").alias("nr"), F.col("c").alias("nc"), F.col("v").alias("nv"))
    return cells.select("board_id", "r", "c", "v", steps).select("board_id", "r", "c", "v", "step.*").join(long(other), ["board_id", "nr", "nc"])


def block_2x2(cells: DataFrame, value: int) -> DataFrame:
    """(board_id, r, c): top left corners of 2 x 2 blocks of one value."""
    corners = F.explode(F.array(*[F.struct((F.col("r") - dr).alias("br"), (F.col("c") - dc).alias("bc")) for dr in (0, 1) for dc in (0, 1)])).alias("k")
    each = cells.filter(F.col("v") == value).select("board_id", corners).groupBy("board_id", "k.br", "k.bc").agg(F.count("*").alias("n"))
    return each.filter("n = 4").select("board_id", F.col("br").alias("r"), F.col("bc").alias("c"))


def edge_nodes(edges: DataFrame) -> DataFrame:
    """(board_id, r, c): both end points of every drawn edge (board_id, layer h or v, r, c, v)."""
    ends = F.array(F.struct("r", "c"), F.when(F.col("layer") == "h", F.struct(F.col("r").alias("r"), (F.col("c") + 1).alias("c"))).otherwise(F.struct((F.col("r") + 1).alias("r"), F.col("c").alias("c"))))
    return edges.filter("v = 1").select("board_id", F.explode(ends).alias("n")).select("board_id", "n.r", "n.c")


def degree_check(edges: DataFrame) -> DataFrame:
    """(board_id, ok): at least one edge, and every node on none or two."""
    degree = edge_nodes(edges).groupBy("board_id", "r", "c").agg(F.count("*").alias("d"))
    good = degree.groupBy("board_id").agg(F.every(F.col("d") == 2).alias("ok"))
    return edges.select("board_id").distinct().join(long(good), "board_id", "left").withColumn("ok", F.coalesce("ok", F.lit(False)))


def sides(edges: DataFrame) -> DataFrame:
    """(board_id, r, c): cells beside every drawn edge of a slitherlink board, with repeats."""
    beside = F.array(F.struct("r", "c"), F.when(F.col("layer") == "h", F.struct((F.col("r") - 1).alias("r"), F.col("c").alias("c"))).otherwise(F.struct(F.col("r").alias("r"), (F.col("c") - 1).alias("c"))))
    return edges.filter("v <> 0").select("board_id", F.explode(beside).alias("n")).select("board_id", "n.r", "n.c")


def progress_filled(cells: DataFrame, wanted: Column, filled: Column) -> DataFrame:
    """(board_id, progress): filled share of wanted cells in percent; 100 where none is wanted."""
    n = cells.groupBy("board_id").agg(F.count_if(wanted).alias("want"), F.count_if(wanted & filled).alias("have"))
    return n.select("board_id", F.when(F.col("want") == 0, 100.0).otherwise(F.col("have") / F.col("want") * 100).alias("progress"))


def progress_touched(cells: DataFrame, touched: DataFrame) -> DataFrame:
    """(board_id, progress): share of cells that ``touched`` (board_id, r, c) has, in percent."""
    there = touched.select("board_id", "r", "c").distinct().withColumn("there", F.lit(True))
    n = looked_up(cells, there, ["board_id", "r", "c"]).groupBy("board_id").agg(F.count("there").alias("have"), F.count("*").alias("n"))
    return n.select("board_id", (F.col("have") / F.col("n") * 100).alias("progress"))


def audit_sudoku(cells: DataFrame) -> DataFrame:
    """(board_id, passed): 81 filled cells, nine digits in every row, column and box."""
    each = cells.select("board_id", "v", "r", "c", box(F.col("r"), F.col("c")).alias("b"))
    inside = "v between 1 and 9 and r between 0 and 8 and c between 0 and 8"
    # A bit for each digit of a line, and lines 0 to 4 and 5 to 8 side by side: with 81 filled cells in all, none can be twice.
    seen = [(F.bit_or(F.expr(f"case when {inside} and {line} between {low} and {high} then shiftleft(1L, cast({line} - {low} as int) * 9 + cast(v as int) - 1) end")), (1 << 9 * (high - low + 1)) - 1) for line in "rcb" for low, high in ((0, 4), (5, 8))]
    whole = reduce(lambda x, y: x & y, [F.coalesce(bits == full, F.lit(False)) for bits, full in seen])
    return each.groupBy("board_id").agg((whole & (F.count_if(F.expr("v between 1 and 9")) == 81)).alias("passed"))


def audit_nonogram(cells: DataFrame, clues: DataFrame) -> DataFrame:
    """(board_id, passed): the runs of every line equal its clue (board_id, axis, line, clue)."""
    same = looked_up(clues, line_runs(cells), ["board_id", "axis", "line"]).withColumn("same", F.coalesce(F.col("clue") == F.col("runs"), F.lit(False)))
    return same.groupBy("board_id").agg(F.every("same").alias("passed"))


def shape_key(points: Column) -> Column:
    """Normal form of a polyomino (array of (r, c)) under shifts, turns and reflections."""

    def normal(shape: Column) -> Column:
        low = F.array_min(F.transform(shape, lambda p: p["r"])), F.array_min(F.transform(shape, lambda p: p["c"]))
        moved = F.array_sort(F.transform(shape, lambda p: F.struct((p["r"] - low[0]).alias("r"), (p["c"] - low[1]).alias("c"))))
        return F.array_join(F.transform(moved, lambda p: F.concat_ws(",", p["r"], p["c"])), ";")

    def turned(swap: bool, sr: int, sc: int) -> Column:
        return F.transform(points, lambda p: F.struct(((p["c"] if swap else p["r"]) * sr).alias("r"), ((p["r"] if swap else p["c"]) * sc).alias("c")))

    return F.array_min(F.array(*[normal(turned(swap, sr, sc)) for swap in (False, True) for sr in (1, -1) for sc in (1, -1)]))
