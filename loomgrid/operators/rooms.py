"""Audits of boards with rooms and gates, and gates from recognised cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.operators import audit, graph, grid
from loomgrid.operators.audit import verdict
from loomgrid.operators.joins import kept, long

PLACE = ["board_id", "r", "c"]


def pieces(cells: DataFrame) -> DataFrame:
    """(board_id, room, v, component, n): pieces of one value within one room of cells (board_id, r, c, room, v); values below 16."""
    both = cells.withColumn("v", F.col("room") * 16 + F.col("v"))
    each = graph.in_pieces(both).groupBy("board_id", "v", "component").agg(F.count("*").alias("n"))
    return each.select("board_id", F.floor(F.col("v") / 16).cast("int").alias("room"), (F.col("v") % 16).alias("v"), "component", "n")


def in_rooms(cells: DataFrame, borders: DataFrame) -> DataFrame:
    """``cells`` with the number of their room."""
    return graph.in_rooms(cells, borders).withColumnRenamed("component", "room")


def beside_borders(cells: DataFrame, borders: DataFrame) -> DataFrame:
    """Drawn borders between two cells, with the rooms of both (a, b); cells (board_id, r, c, room)."""
    down = F.col("layer") == "h"
    drawn = borders.filter("v = 1").select("board_id", "layer", "r", "c", F.when(down, F.col("r") + 1).otherwise(F.col("r")).alias("nr"), F.when(down, F.col("c")).otherwise(F.col("c") + 1).alias("nc"))
    other = cells.select("board_id", F.col("r").alias("nr"), F.col("c").alias("nc"), F.col("room").alias("b"))
    return drawn.join(long(cells.select(*PLACE, F.col("room").alias("a"))), PLACE).join(long(other), ["board_id", "nr", "nc"])


def audit_double_choco(cells: DataFrame, borders: DataFrame) -> DataFrame:
    """Every room has one white and one gray piece of one size and shape, which its clues name; borders part rooms.

    Cells: (board_id, r, c, v, clue), white 0 and gray 1, clue 0 for none.
    """
    placed = kept(in_rooms(cells, borders), "rooms")
    count = placed.groupBy("board_id", "room").agg(F.count_if(F.expr("v = 0")).alias("white"), F.count_if(F.expr("v <> 0")).alias("gray"), F.collect_set(F.when(F.col("clue") > 0, F.col("clue"))).alias("clues"))
    uneven = count.filter("white <> gray or white = 0 or exists(clues, x -> x <> white)")
    torn = pieces(placed.withColumn("v", F.least("v", F.lit(1)))).groupBy("board_id", "room", "v").agg(F.count("*").alias("k")).filter("k > 1")
    points = lambda v: F.collect_list(F.when(F.col("v") == v, F.struct("r", "c")))
    shapes = placed.withColumn("v", F.least("v", F.lit(1))).groupBy("board_id", "room").agg(points(0).alias("white"), points(1).alias("gray"))
    unlike = shapes.filter((F.size("white") > 0) & (F.size("gray") > 0)).filter(grid.shape_key(F.col("white")) != grid.shape_key(F.col("gray")))
    drawn = beside_borders(placed, borders)
    none = cells.select("board_id").distinct().join(long(drawn.select("board_id").distinct()), "board_id", "left_anti")
    return verdict(cells, uneven, torn, unlike, drawn.filter("a = b"), none)


def audit_nuritwin(cells: DataFrame, borders: DataFrame, states: DataFrame) -> DataFrame:
    """Black (1) is one piece without 2 x 2 blocks, and two pieces of one size in every room, which its last clue names.

    Cells: (board_id, r, c, v) with the clue; states: the player's values, 0 for unset.
    """
    placed = kept(in_rooms(cells, borders).withColumnRenamed("v", "clue").join(long(states), PLACE, "left").withColumn("v", F.coalesce("v", F.lit(0))), "rooms")
    black = placed.filter("v = 1")
    whole = pieces(black.withColumn("room", F.lit(0))).groupBy("board_id").agg(F.count("*").alias("k"))
    split = cells.select("board_id").distinct().join(long(whole), "board_id", "left").filter("k is null or k > 1")
    sizes = pieces(black).groupBy("board_id", "room").agg(F.count("*").alias("k"), F.min("n").alias("low"), F.max("n").alias("high"))
    clues = placed.groupBy("board_id", "room").agg(F.max_by(F.when(F.col("clue") > 0, F.col("clue")), F.when(F.col("clue") > 0, F.struct("r", "c"))).alias("clue"))
    wrong = clues.join(long(sizes), ["board_id", "room"], "left").filter("k is null or k <> 2 or low <> high or clue <> low")
    return verdict(cells, placed.filter("v = 0"), grid.block_2x2(black, 1), split, wrong)


def audit_nurimaze(cells: DataFrame, borders: DataFrame, rooms: DataFrame) -> DataFrame:
    """Every room is set; no 2 x 2 block of black (1) or of others; the others are one piece; the way from S (3) to G (4) has all circles (1) and no triangle (2).

    Cells: (board_id, r, c, v); rooms: the state (board_id, r, c, v) of each room, given at any of its cells.
    """
    placed = in_rooms(cells, borders)
    state = placed.select(*PLACE, "room").join(long(rooms.withColumnRenamed("v", "state")), PLACE).groupBy("board_id", "room").agg(F.max("state").alias("state"))
    full = kept(placed.join(long(state), ["board_id", "room"], "left").withColumn("state", F.coalesce("state", F.lit(0))), "rooms")
    shade = full.select(*PLACE, F.when(F.col("state") == 1, 1).otherwise(0).alias("v"))
    open_ = shade.filter("v = 0")
    whole = pieces(open_.withColumn("room", F.lit(0))).groupBy("board_id").agg(F.count("*").alias("k"))
    boards = cells.select("board_id").distinct()
    split = boards.join(long(whole), "board_id", "left").filter("k is null or k > 1")
    ends = [full.filter(f"v = {v}").groupBy("board_id").agg(F.max(F.struct("r", "c")).alias("p")).select("board_id", "p.r", "p.c") for v in (3, 4)]
    # The search leaves S whatever its room is.
    free = open_.select(*PLACE).unionByName(ends[0])
    on = kept(graph.path_steps(free, *ends).select(*PLACE), "way")
    lost = boards.join(long(on), "board_id", "left_anti")
    off = cells.filter("v = 1").join(long(on), PLACE, "left_anti")
    return verdict(cells, full.filter("state = 0"), grid.block_2x2(shade, 1), grid.block_2x2(shade, 0), split, lost, off, cells.filter("v = 2").join(long(on), PLACE, "left_semi"))


def crossings(walk: DataFrame, gates: DataFrame) -> DataFrame:
    """(board_id, gate, nth): gates in the order in which a loop (board_id, r, c, position) first enters them across.

    Of the two ways round, that is taken which leaves the start to the right, or else left, down or up.
    """
    board = Window.partitionBy("board_id")
    around = walk.withColumns({"size": F.count("*").over(board).cast("int"), "sr": F.min_by("r", "position").over(board), "sc": F.min_by("c", "position").over(board)})
    by = F.expr("position = 1 or position = size - 1")
    way = F.when((F.col("r") == F.col("sr")) & (F.col("c") > F.col("sc")), 0).when((F.col("r") == F.col("sr")) & (F.col("c") < F.col("sc")), 1).when(F.col("r") > F.col("sr"), 2).otherwise(3)
    turned = around.withColumn("turned", F.min_by(F.when(by, F.col("position")), F.when(by, way)).over(board) != 1)
    placed = turned.withColumn("position", F.when(F.col("turned"), (F.col("size") - F.col("position")) % F.col("size")).otherwise(F.col("position")))
    order = board.orderBy("position")
    # The first place is entered last.
    steps = placed.select(
        *PLACE, *[F.coalesce(F.lag(x).over(order), F.max_by(x, "position").over(board)).alias(f"p{x}") for x in ("r", "c")], F.when(F.col("position") == 0, F.col("size")).otherwise(F.col("position")).alias("at")
    )
    gate = audit.gate_cells(gates).join(long(gates.select("board_id", "gate", "orientation")), ["board_id", "gate"])
    across = steps.join(long(gate), PLACE).filter("orientation = 'v' and c <> pc or orientation = 'h' and r <> pr")
    first = across.groupBy("board_id", "gate").agg(F.min("at").alias("at"))
    return first.withColumn("nth", F.row_number().over(Window.partitionBy("board_id").orderBy("at", "gate"))).select("board_id", "gate", "nth")


def audit_slalom(cells: DataFrame, starts: DataFrame, gates: DataFrame, gate_count: DataFrame, edges: DataFrame) -> DataFrame:
    """A loop through the start, off the walls (1), that crosses every gate, in the order of their numbers or the reverse.

    Gates: (board_id, gate, orientation, line, lo, hi, number); gate_count: (board_id, gate_count).
    """
    walls = cells.filter("v = 1").select(*PLACE)
    on = grid.edge_nodes(edges)
    degree = on.groupBy(*PLACE).agg(F.count("*").alias("d"))
    off = starts.join(long(degree), PLACE, "left").filter("d is null or d <> 2")
    flat = F.col("layer") == "h"
    steps = edges.filter("v = 1").select(*PLACE, F.when(flat, F.col("r")).otherwise(F.col("r") + 1).alias("nr"), F.when(flat, F.col("c") + 1).otherwise(F.col("c")).alias("nc"))
    loose = degree.filter("d <> 2")
    sound = edges.select("board_id").distinct().join(long(loose.unionByName(off.select(*PLACE, "d")).select("board_id").distinct()), "board_id", "left_anti")
    walk = graph.loop_order(steps.join(long(sound), "board_id", "left_semi"), starts.join(long(sound), "board_id", "left_semi"))
    order = kept(crossings(walk, gates).join(long(gates.select("board_id", "gate", "number")), ["board_id", "gate"]), "crossings")
    met = order.groupBy("board_id").agg(F.count("*").alias("met"))
    few = gate_count.join(long(met), "board_id", "left").filter("coalesce(met, 0) <> gate_count")
    misplaced = order.join(long(met), "board_id").groupBy("board_id").agg(F.count_if(F.expr("number <> nth")).alias("there"), F.count_if(F.expr("number <> met + 1 - nth")).alias("back")).filter("there > 0 and back > 0")
    return verdict(cells, starts.join(long(walls), PLACE, "left_semi"), on.join(long(walls), PLACE, "left_semi"), off, loose, few, misplaced)


def infer_gates(cells: DataFrame) -> DataFrame:
    """(board_id, gate, orientation, line, lo, hi) from dashed cells (board_id, r, c, kind, side).

    Neighbours on a line are one gate.  Gates are numbered by the first dashed
    cell of their line in reading order, then along the line.
    """
    upright = F.col("side").isin("left", "right")
    dashed = cells.filter(F.col("kind").eqNullSafe("dash") & F.col("side").isin("left", "right", "top", "bottom")).select(
        "board_id", F.when(upright, "v").otherwise("h").alias("orientation"), F.when(upright, F.col("c")).otherwise(F.col("r")).alias("line"), F.when(upright, F.col("r")).otherwise(F.col("c")).alias("at"), "r", "c"
    )
    line = Window.partitionBy("board_id", "orientation", "line")
    runs = dashed.withColumns({"run": F.col("at") - F.row_number().over(line.orderBy("at")), "seen": F.min(F.struct("r", "c")).over(line)})
    gates = runs.groupBy("board_id", "orientation", "line", "run", "seen").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    number = F.row_number().over(Window.partitionBy("board_id").orderBy("seen", "orientation", "line", "lo")) - 1
    return gates.withColumn("gate", number).select("board_id", "gate", "orientation", "line", "lo", "hi")


def first_free_gate(cells: DataFrame, gates: DataFrame) -> DataFrame:
    """``gates`` with ``number``: that of the first arrow (board_id, r, c, kind arrow, side, value) in reading order whose next cell's first gate it is."""
    step = {"up": (-1, 0), "down": (1, 0), "left": (0, -1), "right": (0, 1)}

    def moved(k: int) -> Column:
        return F.coalesce(*[F.when(F.col("side") == side, F.lit(d[k])) for side, d in step.items()])

    arrows = cells.filter(F.col("kind").eqNullSafe("arrow") & F.col("side").isin(*step)).select("board_id", F.struct("r", "c").alias("from"), (F.col("r") + moved(0)).alias("r"), (F.col("c") + moved(1)).alias("c"), "value")
    inside = arrows.join(long(cells.select(*PLACE)), PLACE, "left_semi")
    met = inside.join(long(audit.gate_cells(gates)), PLACE).groupBy("board_id", "from").agg(F.min_by(F.struct("gate", "value"), "gate").alias("g"))
    first = met.groupBy("board_id", F.col("g.gate").alias("gate")).agg(F.min_by("g.value", "from").alias("number"))
    return gates.join(long(first), ["board_id", "gate"], "left")


def start_and_count(cells: DataFrame, gates: DataFrame) -> DataFrame:
    """(board_id, row, col, gate_count) of the last circled number in reading order; (0, 0) without one, and all gates where it is none or 0."""
    circle = cells.filter(F.col("kind").eqNullSafe("circle")).groupBy("board_id").agg(F.max_by(F.struct("r", "c", "value"), F.struct("r", "c")).alias("s"))
    count = gates.groupBy("board_id").agg(F.count("*").alias("n"))
    every = cells.select("board_id").distinct().join(long(circle), "board_id", "left").join(long(count), "board_id", "left")
    some = F.when(F.col("s.value") != 0, F.col("s.value"))
    return every.select("board_id", F.coalesce("s.r", F.lit(0)).alias("row"), F.coalesce("s.c", F.lit(0)).alias("col"), F.coalesce(some.cast("long"), "n", F.lit(0)).alias("gate_count"))
