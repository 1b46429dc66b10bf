"""Queries of audits and repairs: name to (function of Tables, SQL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgrid.operators import audit, grid
from loomgrid.operators.joins import long, looked_up
from loomgrid.plans.answers import COMBO, gates
from loomgrid.plans.boards import QUERIES as BOARDS, STATES, cell_sql, clues
from loomgrid.sources import boards
from loomgrid.sources.analog import Tables


def solved_combo(t: Tables):
    """Two overlapping solved parts; one cell repeats a digit for some boards."""
    cells = boards.cells(t, 15, 15, boards.DIGIT).withColumn("v", F.expr("case when board_id % 4 = 0 and r = 0 and c = 0 then (1 + board_id) % 9 + 1 when board_id % 4 = 1 and r = 14 and c = 14 then 0 else v end"))
    each = cells.withColumnsRenamed({"r": "gr", "c": "gc"}).withColumn("sub_idx", F.explode(F.array(F.lit(0), F.lit(1))))
    placed = each.withColumns({"r": F.col("gr") - 6 * F.col("sub_idx"), "c": F.col("gc") - 6 * F.col("sub_idx")})
    return placed.filter("r between 0 and 8 and c between 0 and 8")


def rings(t: Tables, whole: bool = False):
    """The border ring, and a small ring inside it where board_id % 5 = 0."""
    inner = "board_id % 5 = 0 and (layer = 'h' and c = 1 and r in (1, 2) or layer = 'v' and r = 1 and c in (1, 2))"
    sized = boards.ring(t).join(long(boards.boards(t).select("board_id", F.expr("4 + board_id % 4").alias("m"), F.expr("4 + board_id % 5").alias("n"))), "board_id")
    full = "layer = 'h' and (r = 0 or r = m - 1) or layer = 'v' and (c = 0 or c = n - 1)"
    lost = "false" if whole else "board_id % 3 = 0 and layer = 'h' and r = 0 and c = 0"
    return sized.withColumn("v", F.expr(f"case when ({full}) and not ({lost}) or {inner} and m > 4 and n > 4 then 1 else 0 end")).select("board_id", "layer", "r", "c", "v")


def slitherlink_cells(t: Tables):
    cells = boards.cells(t, F.expr("3 + board_id % 4"), F.expr("3 + board_id % 5"), "0")
    drawn = grid.sides(rings(t, whole=True)).groupBy("board_id", "r", "c").agg(F.count("*").cast("int").alias("n"))
    return looked_up(cells, drawn, ["board_id", "r", "c"]).select("board_id", "r", "c", F.when((F.col("r") + F.col("c")) % 4 == 3, -1).otherwise(F.coalesce("n", F.lit(0))).alias("v"))


def slitherlink(t: Tables):
    return audit.audit_slitherlink(slitherlink_cells(t), rings(t))


#: A black circle in the corner and a white one beside it; wrong ones for some boards.
CIRCLES = "case when r = 0 and c = 0 then case board_id % 7 when 1 then 1 else 2 end when r = 0 and c = 1 then case board_id % 7 when 2 then 2 else 1 end when r = 0 and c = 2 and board_id % 7 = 3 then 1 else 0 end"


def parts(t: Tables):
    shift = F.expr("cast(1 + board_id % 3 as int)")
    one = boards.boards(t).select("board_id", F.lit(0).alias("sub_idx"), F.lit(0).alias("x"), F.lit(0).alias("y"))
    return one.unionByName(one.withColumns({"sub_idx": F.lit(1), "x": shift, "y": shift}))


#: What three parts on a diagonal show: a solved board with blanks, and other digits on some boards.
TORN_V = "(3 * gr + cast(floor(gr / 3.0) as int) + gc + board_id) % 9 + 1"
TORN_SHOWN = f"case when (gr + 2 * gc + sub_idx + board_id) % 3 = 0 then 0 when board_id % 6 = 0 and (gr + gc + sub_idx) % 5 = 0 then {TORN_V} % 9 + 1 else {TORN_V} end"


def torn(t: Tables):
    """Parts at (0, 0), (1, 1) and (2, 2), of which up to three meet in a cell."""
    one = boards.sudoku(t, "0").select("board_id", "r", "c", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("sub_idx"))
    return one.withColumns({"gr": F.col("r") + 3 * F.col("sub_idx"), "gc": F.col("c") + 3 * F.col("sub_idx")}).withColumn("v", F.expr(TORN_SHOWN).cast("int"))


#: The values of a place in one row, and the three pairs one after the other.
TORN_SQL = f"""WITH {cell_sql('9', '9', '0')}, s AS (SELECT board_id, k AS sub_idx, r + 3 * k AS gr, c + 3 * k AS gc FROM cells, range(3) x(k)), d AS (SELECT *, {TORN_SHOWN} AS v FROM s),
p AS (SELECT board_id, gr, gc, max(v) FILTER (sub_idx = 0) AS a, max(v) FILTER (sub_idx = 1) AS b, max(v) FILTER (sub_idx = 2) AS c FROM d GROUP BY ALL),
p1 AS (SELECT * REPLACE (CASE WHEN a = 0 THEN coalesce(b, a) ELSE a END AS a, CASE WHEN b = 0 THEN coalesce(a, b) ELSE b END AS b), a <> b AND a > 0 AND b > 0 AS m1 FROM p),
p2 AS (SELECT * REPLACE (CASE WHEN a = 0 THEN coalesce(c, a) ELSE a END AS a, CASE WHEN c = 0 THEN coalesce(a, c) ELSE c END AS c), a <> c AND a > 0 AND c > 0 AS m2 FROM p1),
p3 AS (SELECT * REPLACE (CASE WHEN b = 0 THEN coalesce(c, b) ELSE b END AS b, CASE WHEN c = 0 THEN coalesce(b, c) ELSE c END AS c), b <> c AND b > 0 AND c > 0 AS m3 FROM p2)"""


#: Drawn edges of the border ring and the small ring of n (board_id, r, c, m, n).
RINGS_SQL = """rings AS (
  SELECT board_id, 'h' AS layer, r, c FROM n WHERE c < n - 1 AND ((r = 0 OR r = m - 1) AND NOT (board_id % 3 = 0 AND r = 0 AND c = 0) OR board_id % 5 = 0 AND m > 4 AND n > 4 AND c = 1 AND r IN (1, 2))
  UNION ALL SELECT board_id, 'v', r, c FROM n WHERE r < m - 1 AND (c = 0 OR c = n - 1 OR board_id % 5 = 0 AND m > 4 AND n > 4 AND r = 1 AND c IN (1, 2)))"""
#: The rings' places, the ways between them, how many leave each place, in which directions, and the pieces that they make.
LOOPS_SQL = f"""{cell_sql('4 + board_id % 4', '4 + board_id % 5', '0')}, n AS (SELECT board_id, r, c, 4 + board_id % 4 AS m, 4 + board_id % 5 AS n FROM cells), {RINGS_SQL},
ways AS (SELECT board_id, 32 * r + c AS x, CASE layer WHEN 'h' THEN 32 * r + c + 1 ELSE 32 * r + c + 32 END AS y FROM rings), both_ways AS (SELECT * FROM ways UNION ALL SELECT board_id, y, x FROM ways),
places AS (SELECT board_id, x, count(*) AS d, max(y - x) + min(y - x) = 0 AS straight FROM both_ways GROUP BY ALL),
reach AS (SELECT board_id, x, x AS y FROM places UNION SELECT e.board_id, e.x, w.y FROM reach e JOIN both_ways w ON w.board_id = e.board_id AND w.x = e.y),
loops AS (SELECT board_id, count(DISTINCT low) AS pieces FROM (SELECT board_id, x, min(y) AS low FROM reach GROUP BY ALL) GROUP BY ALL)"""
LOOP_OK = "p_partkey IN (SELECT board_id FROM loops WHERE pieces = 1) AND p_partkey NOT IN (SELECT board_id FROM places WHERE d <> 2)"
COMBO_SHOWN = f"case when board_id % 4 = 0 and r = 0 and c = 0 then (1 + board_id) % 9 + 1 when board_id % 4 = 1 and r = 14 and c = 14 then 0 else {boards.DIGIT} end"

QUERIES = {
    "audit_combo": (
        lambda t: audit.audit_combo(solved_combo(t)),
        f"""WITH {cell_sql('15', '15', COMBO_SHOWN)}, part_cells AS (SELECT board_id, k, r - 6 * k AS r, c - 6 * k AS c, v FROM cells, range(2) x(k) WHERE r - 6 * k BETWEEN 0 AND 8 AND c - 6 * k BETWEEN 0 AND 8),
           lines AS (SELECT board_id, k, v, unnest(['r' || r, 'c' || c, 'b' || (r // 3 * 3 + c // 3)]) AS line FROM part_cells)
           SELECT board_id, bool_and(d = 9 AND low > 0) AS passed FROM (SELECT board_id, k, line, count(DISTINCT v) AS d, min(v) AS low FROM lines GROUP BY ALL) GROUP BY ALL""",
    ),
    "audit_slitherlink": (
        slitherlink,
        f"""WITH RECURSIVE {LOOPS_SQL}, whole AS (SELECT board_id, r, c, layer FROM (SELECT board_id, r, c, 'h' AS layer, (r = 0 OR r = m - 1) AND c < n - 1 AS drawn FROM n UNION ALL SELECT board_id, r, c, 'v', (c = 0 OR c = n - 1) AND r < m - 1 FROM n) WHERE drawn
             UNION SELECT board_id, r, c, layer FROM rings),
           around AS (SELECT board_id, r, c, layer FROM whole UNION ALL SELECT board_id, CASE layer WHEN 'h' THEN r - 1 ELSE r END, CASE layer WHEN 'v' THEN c - 1 ELSE c END, layer || '+' FROM whole),
           given AS (SELECT board_id, r, c, CASE WHEN (r + c) % 4 = 3 THEN -1 ELSE k END AS clue FROM (SELECT n.board_id, n.r, n.c, count(a.layer) AS k FROM n LEFT JOIN around a USING (board_id, r, c) WHERE n.r < n.m - 1 AND n.c < n.n - 1 GROUP BY n.board_id, n.r, n.c)),
           sides AS (SELECT board_id, r, c, layer FROM rings UNION ALL SELECT board_id, CASE layer WHEN 'h' THEN r - 1 ELSE r END, CASE layer WHEN 'v' THEN c - 1 ELSE c END, layer || '+' FROM rings),
           wrong AS (SELECT g.board_id FROM given g LEFT JOIN sides s USING (board_id, r, c) WHERE clue >= 0 GROUP BY g.board_id, g.r, g.c, clue HAVING count(s.layer) <> clue)
           SELECT p_partkey AS board_id, {LOOP_OK} AND p_partkey NOT IN (SELECT board_id FROM wrong) AS passed FROM part""",
    ),
    "audit_masyu": (
        lambda t: audit.audit_masyu(boards.cells(t, F.expr("4 + board_id % 4"), F.expr("4 + board_id % 5"), CIRCLES), rings(t)),
        f"""WITH RECURSIVE {LOOPS_SQL}, circles AS (SELECT board_id, 32 * r + c AS x, v FROM (SELECT *, {CIRCLES} AS v FROM n) WHERE v > 0),
           seen AS (SELECT k.board_id, k.x, k.v, any_value(p.straight) AS straight, any_value(p.d) AS d, count(*) FILTER (q.d = 2 AND NOT q.straight) AS turned, count(*) FILTER (q.d = 2 AND q.straight) AS straights
             FROM circles k LEFT JOIN places p ON p.board_id = k.board_id AND p.x = k.x LEFT JOIN both_ways w ON w.board_id = k.board_id AND w.x = k.x LEFT JOIN places q ON q.board_id = w.board_id AND q.x = w.y GROUP BY ALL),
           wrong AS (SELECT board_id FROM seen WHERE d IS NULL OR d <> 2 OR v = 1 AND (NOT straight OR turned = 0) OR v = 2 AND (straight OR straights < 2))
           SELECT p_partkey AS board_id, {LOOP_OK} AND p_partkey NOT IN (SELECT board_id FROM wrong) AS passed FROM part""",
    ),
    "audit_summary": (
        lambda t: audit.audit_summary(
            boards.boards(t).select("board_id", F.lit(1).alias("puzzle_type"), (F.col("board_id") % 5 != 0).alias("finished")).unionByName(
                boards.boards(t).select((F.col("board_id") + 1_000_000_000).alias("board_id"), F.lit(6).alias("puzzle_type"), F.lit(True).alias("finished"))
            ),
            grid.audit_sudoku(boards.sudoku(t)).unionByName(grid.audit_nonogram(boards.nonogram(t), clues(t)).withColumn("board_id", F.col("board_id") + 1_000_000_000)),
        ),
        f"""SELECT 1 AS puzzle_type, count(*) AS finished, count(*) FILTER (passed) AS confirmed, count(*) FILTER (NOT passed) AS false_finishes FROM ({BOARDS['audit_sudoku'][1]}) WHERE board_id % 5 <> 0
           UNION ALL SELECT 6, count(*), count(*) FILTER (passed), count(*) FILTER (NOT passed) FROM ({BOARDS['audit_nonogram'][1]})""",
    ),
    "gate_cell_range_join": (
        lambda t: audit.gate_cells(gates(t)).join(long(boards.states(t)), ["board_id", "r", "c"]).select("board_id", "gate", "r", "c", "v"),
        f"""WITH {cell_sql(*STATES, boards.STATE)}, gates AS (SELECT p_partkey AS board_id, 0 AS gate, 'v' AS o, 2 AS line, 0 AS lo, p_partkey % 3 AS hi FROM part UNION ALL SELECT p_partkey, 1, 'h', 1 + p_partkey % 3, 0, 0 FROM part)
           SELECT c.board_id, gate, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, v FROM cells c JOIN gates g ON g.board_id = c.board_id
           AND (o = 'v' AND c = line AND r BETWEEN lo AND hi OR o = 'h' AND r = line AND c BETWEEN lo AND hi)""",
    ),
    "overlap_self_join": (lambda t: audit.overlapping_parts(parts(t)), "SELECT p_partkey AS board_id, 0 AS i, 1 AS j FROM part WHERE p_partkey % 3 < 2"),
    "reconcile_overlaps": (
        lambda t: audit.reconcile_overlaps(torn(t))[0].select("board_id", "sub_idx", "gr", "gc", "v"),
        TORN_SQL + " UNION ALL ".join(f" SELECT board_id, {k} AS sub_idx, CAST(gr AS INTEGER) AS gr, CAST(gc AS INTEGER) AS gc, CAST({x} AS INTEGER) AS v FROM p3 WHERE {x} IS NOT NULL" for k, x in enumerate("abc")),
    ),
    "overlap_disagreements": (
        lambda t: (lambda made: made[1].groupBy("board_id").agg(F.count("*").alias("n")).join(long(made[2].withColumn("ambiguous", F.lit(True))), "board_id", "left"))(audit.reconcile_overlaps(torn(t))),
        TORN_SQL + " SELECT board_id, CAST(count(*) FILTER (m1) + count(*) FILTER (m2) + count(*) FILTER (m3) AS BIGINT) AS n, true AS ambiguous FROM p3 GROUP BY ALL HAVING n > 0",
    ),
    "pad_clue_lists": (
        lambda t: boards.boards(t).select("board_id", F.to_json(audit.pad_clue_lists(F.array(F.array(F.col("size")), F.array(F.lit(2), F.lit(3))), (F.col("board_id") % 4).cast("int"))).alias("clues")),
        "SELECT p_partkey AS board_id, CASE p_partkey % 4 WHEN 0 THEN '[]' WHEN 1 THEN '[[' || p_size || ']]' WHEN 2 THEN '[[' || p_size || '],[2,3]]' ELSE '[[' || p_size || '],[2,3],[0]]' END AS clues FROM part",
    ),
    "reply_shape_check": (
        lambda t: boards.boards(t).select("board_id", audit.reply_shape_check(F.when(F.col("board_id") % 4 != 0, F.array(F.array(F.lit(1), F.lit(2)), F.when(F.col("board_id") % 4 == 1, F.array(F.lit(3))).otherwise(F.array(F.lit(3), F.lit(4))))), F.when(F.col("board_id") % 4 == 2, 3).otherwise(2), F.lit(2)).alias("message")),
        "SELECT p_partkey AS board_id, CASE p_partkey % 4 WHEN 0 THEN 'no matrix' WHEN 1 THEN 'row 1: expected 2 columns' WHEN 2 THEN 'expected 3 rows, got 2' END AS message FROM part",
    ),
    "classified_cells": (
        lambda t: (lambda every: audit.classified_cells(
            every.select("board_id", (F.col("r") * 10 + F.col("c")).alias("ordinal")),
            boards.cells(t, 6, 10, "(r + c + board_id) % 4").filter("(r * c + board_id) % 5 <> 0").select("board_id", (F.col("r") * 10 + F.col("c")).alias("ordinal"), F.element_at(F.array(F.lit("wall"), F.lit("dash"), F.lit("odd"), F.lit("empty")), F.col("v") + 1).alias("kind")),
            ["wall", "dash", "empty"],
        ))(boards.cells(t, 4, 3, "0")),
        f"""WITH {cell_sql('4', '3', '0')} SELECT board_id, CAST(r * 10 + c AS INTEGER) AS ordinal, CASE WHEN (r * c + board_id) % 5 = 0 THEN 'empty' ELSE CASE (r + c + board_id) % 4 WHEN 0 THEN 'wall' WHEN 1 THEN 'dash' ELSE 'empty' END END AS kind FROM cells""",
    ),
}
