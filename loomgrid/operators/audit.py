"""Audits of claimed solutions, and repairs of recognised boards, over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.operators import boardwise, graph, grid
from loomgrid.operators.joins import long, looked_up


def verdict(boards: DataFrame, *failed: DataFrame) -> DataFrame:
    """(board_id, passed): boards that are in none of ``failed`` (board_id)."""
    bad = failed[0].select("board_id")
    for f in failed[1:]:
        bad = bad.unionByName(f.select("board_id"))
    marked = bad.distinct().withColumn("bad", F.lit(True))
    return boards.select("board_id").distinct().join(long(marked), "board_id", "left").select("board_id", F.col("bad").isNull().alias("passed"))


def audit_combo(subcells: DataFrame) -> DataFrame:
    """Every covered cell filled; digits of every part's rows, columns and boxes distinct (board_id, sub_idx, r, c, v)."""
    each = subcells.withColumn("b", grid.box(F.col("r"), F.col("c")))
    lines = each.select("board_id", "sub_idx", "v", F.explode(F.array(*[F.struct(F.lit(k).alias("axis"), F.col(k).cast("long").alias("line")) for k in ("r", "c", "b")])).alias("x"))
    twice = lines.filter("v > 0").groupBy("board_id", "sub_idx", "x", "v").agg(F.count("*").alias("n")).filter("n > 1")
    return verdict(subcells, subcells.filter("v is null or v = 0"), twice)


def one_loop(edges: DataFrame) -> DataFrame:
    """(board_id): boards whose drawn edges are not in one piece, or that have none."""
    drawn = edges.filter("v = 1")
    right = F.col("layer") == "h"
    links = drawn.select("board_id", "r", "c", F.when(right, F.col("r")).otherwise(F.col("r") + 1).alias("nr"), F.when(right, F.col("c") + 1).otherwise(F.col("c")).alias("nc"))
    ways = links.select("board_id", graph.node().alias("x"), graph.node("nr", "nc").alias("y")).filter("x is not null and y is not null")
    pieces = boardwise.each(ways, boardwise.pieces, "board_id long, n long")
    return edges.select("board_id").distinct().join(long(pieces), "board_id", "left").filter("n is null or n > 1").select("board_id")


def audit_slitherlink(clues: DataFrame, edges: DataFrame) -> DataFrame:
    """Clues (board_id, r, c, v) equal the drawn sides; every node on none or two edges; one loop."""
    drawn = grid.sides(edges).groupBy("board_id", "r", "c").agg(F.count("*").alias("n"))
    wrong = looked_up(clues.filter("v >= 0"), drawn, ["board_id", "r", "c"]).filter(F.coalesce("n", F.lit(0)) != F.col("v"))
    return verdict(clues, wrong, grid.degree_check(edges).filter("not ok"), one_loop(edges))


def audit_summary(claims: DataFrame, audits: DataFrame) -> DataFrame:
    """(puzzle_type, finished, confirmed, false_finishes) of claims (board_id, puzzle_type, finished)."""
    both = claims.filter("finished").join(long(audits), "board_id", "left")
    return both.groupBy("puzzle_type").agg(F.count("*").alias("finished"), F.count_if("passed").alias("confirmed"), F.count_if(~F.coalesce("passed", F.lit(False))).alias("false_finishes"))


def gate_cells(gates: DataFrame) -> DataFrame:
    """(board_id, gate, r, c): cells that a gate's span covers, by explode and not by a range join."""
    span = gates.select("board_id", "gate", "orientation", "line", F.explode(F.sequence("lo", "hi")).alias("k"))
    upright = F.col("orientation") == "v"
    return span.select("board_id", "gate", F.when(upright, F.col("k")).otherwise(F.col("line")).alias("r"), F.when(upright, F.col("line")).otherwise(F.col("k")).alias("c"))


def overlapping_parts(parts: DataFrame) -> DataFrame:
    """(board_id, i, j): parts (board_id, sub_idx, x, y) in list order with 0 < dx < 3 and 0 < dy < 3."""
    other = parts.select("board_id", F.col("sub_idx").alias("j"), F.col("x").alias("xj"), F.col("y").alias("yj"))
    near = parts.join(long(other), "board_id").filter("sub_idx < j and xj - x between 1 and 2 and yj - y between 1 and 2")
    return near.select("board_id", F.col("sub_idx").alias("i"), "j")


def reconcile_overlaps(subcells: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cells with repaired blanks, disagreements, boards on which more than two parts meet in a cell).

    ``subcells``: (board_id, sub_idx, r, c, gr, gc, v).  The pairs of parts that meet in a cell (0 < dx < 3 and
    0 < dy < 3 in boxes, in list order) are gone through one after the other, so that a pair sees what earlier
    ones repaired: a blank takes the other's digit, and two digits that differ stay and are noted
    (board_id, i, j, gr, gc, vi, vj).  A cell has at most as many values as its board has parts.
    """
    part = F.struct("sub_idx", "v", ((F.col("gc") - F.col("c")) / 3).alias("x"), ((F.col("gr") - F.col("r")) / 3).alias("y"), "r", "c")
    cells = subcells.groupBy("board_id", "gr", "gc").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    single, shared = cells.filter(F.size("parts") == 1), cells.filter(F.size("parts") > 1)

    def near(a: Column, b: Column) -> Column:
        return (b["x"] - a["x"]).between(1, 2) & (b["y"] - a["y"]).between(1, 2)

    at = F.sequence(F.lit(0), F.size("parts") - 1)
    pairs = F.flatten(F.transform(at, lambda i: F.transform(F.filter(at, lambda j: (i < j) & near(F.get("parts", i), F.get("parts", j))), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    none = F.array().cast("array<struct<i:int,j:int,vi:int,vj:int>>")

    def step(held: Column, p: Column) -> Column:
        values, met = held["values"], held["met"]
        a, b = F.get(values, p["i"]), F.get(values, p["j"])
        filled = F.transform(values, lambda v, k: F.when((k == p["i"]) & (a == 0), b).when((k == p["j"]) & (b == 0), a).otherwise(v))
        noted = F.when((a != 0) & (b != 0) & (a != b), F.array(F.struct(F.get("parts", p["i"])["sub_idx"].cast("int").alias("i"), F.get("parts", p["j"])["sub_idx"].cast("int").alias("j"), a.alias("vi"), b.alias("vj")))).otherwise(none)
        return F.struct(filled.alias("values"), F.concat(met, noted).alias("met"))

    begin = F.struct(F.transform("parts", lambda x: x["v"].cast("int")).alias("values"), none.alias("met"))
    folded = shared.withColumn("held", F.aggregate(pairs, begin, step))
    zipped = F.zip_with("parts", "held.values", lambda x, v: F.struct(x["sub_idx"].alias("sub_idx"), x["r"].alias("r"), x["c"].alias("c"), v.alias("v")))
    as_is = F.transform("parts", lambda x: F.struct(x["sub_idx"].alias("sub_idx"), x["r"].alias("r"), x["c"].alias("c"), x["v"].cast("int").alias("v")))
    rows = folded.select("board_id", "gr", "gc", F.explode(zipped).alias("x")).unionByName(single.select("board_id", "gr", "gc", F.explode(as_is).alias("x")))
    repaired = rows.select("board_id", "x.sub_idx", "x.r", "x.c", "gr", "gc", "x.v")
    unlike = folded.select("board_id", "gr", "gc", F.explode("held.met").alias("m")).select("board_id", "m.i", "m.j", "gr", "gc", "m.vi", "m.vj")
    return repaired, unlike, shared.filter(F.size("parts") > 2).select("board_id").distinct()


def pad_clue_lists(clues: Column, lines: Column) -> Column:
    """A list of clues cut or padded with [0] to the number of lines."""
    short = F.greatest(lines - F.size(clues), F.lit(0))
    return F.concat(F.slice(clues, F.lit(1), F.greatest(lines, F.lit(0))), F.array_repeat(F.array(F.lit(0)), short))


def reply_shape_check(matrix: Column, rows: Column, columns: Column) -> Column:
    """A message if a reply's matrix has another number of rows, or a row of another length; else null."""
    odd = F.filter(F.transform(matrix, lambda row, k: F.when(F.size(row) != columns, k)), lambda k: k.isNotNull())
    return (
        F.when(matrix.isNull(), F.lit("no matrix"))
        .when(F.size(matrix) != rows, F.concat(F.lit("expected "), rows, F.lit(" rows, got "), F.size(matrix)))
        .when(F.size(odd) > 0, F.concat(F.lit("row "), F.get(odd, F.lit(0)), F.lit(": expected "), columns, F.lit(" columns")))
    )


def classified_cells(expected: DataFrame, replies: DataFrame, known: list[str]) -> DataFrame:
    """(board_id, ordinal, kind): every expected cell with its reply; missing and unknown kinds are empty, replies beyond go."""
    kind = F.when(F.col("kind").isin(*known), F.col("kind")).otherwise("empty")
    return expected.join(long(replies), ["board_id", "ordinal"], "left").select("board_id", "ordinal", F.coalesce(kind, F.lit("empty")).alias("kind"))


#: Bits of the directions in which a place is left.
RIGHT, LEFT, DOWN, UP = 1, 2, 4, 8
STRAIGHT = (RIGHT | LEFT, DOWN | UP)
TURNS = (RIGHT | DOWN, RIGHT | UP, LEFT | DOWN, LEFT | UP)


def directions(edges: DataFrame) -> DataFrame:
    """(board_id, r, c, dirs): bits of the directions of drawn edges at every place that has one."""
    flat = F.col("layer") == "h"
    one = F.struct(F.col("r").alias("r"), F.col("c").alias("c"), F.when(flat, RIGHT).otherwise(DOWN).alias("d"))
    two = F.struct(F.when(flat, F.col("r")).otherwise(F.col("r") + 1).alias("r"), F.when(flat, F.col("c") + 1).otherwise(F.col("c")).alias("c"), F.when(flat, LEFT).otherwise(UP).alias("d"))
    each = edges.filter("v = 1").select("board_id", F.explode(F.array(one, two)).alias("x")).select("board_id", "x.*")
    return each.groupBy("board_id", "r", "c").agg(F.sum("d").alias("dirs"))


def audit_masyu(circles: DataFrame, edges: DataFrame) -> DataFrame:
    """One loop through all circles (board_id, r, c, v): white (1) straight with a turn next to it, black (2) a turn between straights."""
    dirs = directions(edges)
    on = looked_up(circles.filter("v > 0"), dirs, ["board_id", "r", "c"]).withColumn("dirs", F.coalesce("dirs", F.lit(0)))
    wrong = on.filter(((F.col("v") == 1) & ~F.col("dirs").isin(*STRAIGHT)) | ((F.col("v") == 2) & ~F.col("dirs").isin(*TURNS)))
    steps = [(RIGHT, 0, 1), (LEFT, 0, -1), (DOWN, 1, 0), (UP, -1, 0)]
    near = F.explode(F.array_compact(F.array(*[F.when(F.col("dirs").bitwiseAND(bit) != 0, F.struct((F.col("r") + dr).alias("nr"), (F.col("c") + dc).alias("nc"))) for bit, dr, dc in steps]))).alias("p")
    beside = on.select("board_id", "r", "c", "v", near).select("board_id", "r", "c", "v", F.col("p.nr").alias("nr"), F.col("p.nc").alias("nc"))
    other = dirs.select("board_id", F.col("r").alias("nr"), F.col("c").alias("nc"), F.col("dirs").alias("nd"))
    seen = looked_up(beside, other, ["board_id", "nr", "nc"]).groupBy("board_id", "r", "c", "v").agg(
        F.bool_or(F.col("nd").isin(*TURNS)).alias("turn"), F.every(F.coalesce(F.col("nd").isin(*STRAIGHT), F.lit(False))).alias("straight")
    )
    lonely = seen.filter(((F.col("v") == 1) & ~F.coalesce("turn", F.lit(False))) | ((F.col("v") == 2) & ~F.col("straight")))
    return verdict(circles, wrong, lonely, grid.degree_check(edges).filter("not ok"), one_loop(edges))

