"""Queries of audits of boards with rooms and gates, and of lines: name to (function of Tables, SQL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgrid.operators import grid, lines, rooms
from loomgrid.operators.joins import long
from loomgrid.plans.answers import CHOCO, CHOCO_CELLS, choco_borders
from loomgrid.plans.boards import NONOGRAM, RING, RUNS, cell_sql
from loomgrid.sources import boards
from loomgrid.sources.analog import Tables

#: Clues of one for some cells, and a wrong one for some boards.
CHOCO_CLUE = "case when r = 1 and c = 0 and board_id % 5 = 4 then 2 when (r + c + board_id) % 5 = 0 then 1 else 0 end"


def double_choco(t: Tables):
    cells = boards.cells(t, F.expr(CHOCO[0]), F.expr(CHOCO[1]), CHOCO_CELLS).withColumn("clue", F.expr(CHOCO_CLUE))
    return rooms.audit_double_choco(cells, choco_borders(t))


#: Black cells of a solved board of 5 x 5 in three rooms: columns 0 and 1 of three rows, the others of these rows, the last two rows.
TWIN_BLACK = (0, 1, 2, 4, 7, 9, 10, 11, 12, 14, 15, 17, 18, 19, 20, 21)
#: One fault for each remainder: a smaller twin, a wrong clue, twins that touch, an unset cell, a block of four.
TWIN_STATE = f"""case when board_id % 7 = 1 and r = 4 and c = 1 then 2 when board_id % 7 = 3 and r = 1 and c = 0 then 1 when board_id % 7 = 4 and r = 1 and c = 1 then 0
  when board_id % 7 = 5 and r = 3 and c = 1 then 1 when 5 * r + c in {TWIN_BLACK} then 1 else 2 end"""
TWIN_CLUE = "case when r = 0 and c = 0 then case when board_id % 7 = 2 then 3 else 2 end when r = 2 and c = 3 then 3 when r = 4 and c = 4 then 3 else 0 end"


TWIN_VERDICT = "SELECT p_partkey AS board_id, p_partkey % 7 IN (0, 6) AS passed FROM part"
#: A maze of 5 x 5 single rooms: a comb of open cells; S top left, G at the end of the last tooth.
MAZE = """case when r = 0 and c = 0 then 3 when r = 4 and c = 4 then case when board_id % 7 = 6 then 0 else 4 end when r = 0 and c = 3 and board_id % 7 <> 1 then 1 when r = 3 and c = 2 then case when board_id % 7 = 2 then 1 else 2 end
  when r = 2 and c = 4 and board_id % 7 = 3 then 2 else 0 end"""
MAZE_STATE = "case when board_id % 7 = 4 and r = 1 and c = 1 then 0 when board_id % 7 = 5 and r = 0 and c = 2 then 1 when r > 0 and c % 2 = 1 then 1 else 2 end"


MAZE_VERDICT = "SELECT p_partkey AS board_id, p_partkey % 7 IN (0, 1) AS passed FROM part"

# The 5 x 5 board of twins in its eight positions, and one cell of most boards in another state.
_R, _C = "(case when board_id % 2 = 0 then r else 4 - r end)", "(case when floor(board_id / 2.0) % 2 = 0 then c else 4 - c end)"
_SWAP = "floor(board_id / 4.0) % 2 = 0"
TURNED_R, TURNED_C = f"(case when {_SWAP} then {_R} else {_C} end)", f"(case when {_SWAP} then {_C} else {_R} end)"
TURNED_CELL = f"cast(5 * {TURNED_R} + {TURNED_C} as int)"
TURNED_ROOM = f"(case when {TURNED_R} > 2 then 2 when {TURNED_C} > 1 then 1 else 0 end)"
TURNED_CLUE = f"case {TURNED_CELL} when 0 then case when board_id % 11 = 2 then 3 else 2 end when 13 then 3 when 24 then 3 else 0 end"
TURNED_STATE = f"case when board_id % 3 = 0 and {TURNED_CELL} = (board_id * 7) % 25 then (board_id * 5) % 3 when {TURNED_CELL} in {TWIN_BLACK} then 1 else 2 end"


def turned_twins(t: Tables):
    """Boards, borders between unlike rooms, states."""
    rooms_ = boards.cells(t, 5, 5, TURNED_ROOM)
    unlike = grid.neighbours(rooms_).select("board_id", F.when(F.col("nr") > F.col("r"), "h").otherwise("v").alias("layer"), "r", "c", (F.col("v") != F.col("nv")).cast("int").alias("v"))
    return boards.cells(t, 5, 5, TURNED_CLUE), unlike, boards.cells(t, 5, 5, TURNED_STATE)


TWINS_SQL = f"""WITH RECURSIVE {cell_sql('5', '5', TURNED_ROOM, 'rooms')}, {cell_sql('5', '5', TURNED_CLUE, 'clues')}, {cell_sql('5', '5', TURNED_STATE, 'states')},
g AS (SELECT board_id, r, c, 8 * r + c AS x, o.v AS room, k.v AS clue, s.v AS s FROM rooms o JOIN clues k USING (board_id, r, c) JOIN states s USING (board_id, r, c)),
near AS (SELECT a.board_id, a.x, b.x AS y, a.room = b.room AS same FROM g a JOIN g b ON b.board_id = a.board_id AND abs(a.r - b.r) + abs(a.c - b.c) = 1 WHERE a.s = 1 AND b.s = 1),
whole AS (SELECT board_id, x, x AS y FROM g WHERE s = 1 UNION SELECT w.board_id, w.x, n.y FROM whole w JOIN near n ON n.board_id = w.board_id AND n.x = w.y),
inside AS (SELECT board_id, x, x AS y FROM g WHERE s = 1 UNION SELECT w.board_id, w.x, n.y FROM inside w JOIN near n ON n.board_id = w.board_id AND n.x = w.y WHERE n.same),
parts AS (SELECT board_id, count(DISTINCT low) AS n FROM (SELECT board_id, x, min(y) AS low FROM whole GROUP BY ALL) GROUP BY ALL),
pieces AS (SELECT i.board_id, g.room, low, count(*) AS n FROM (SELECT board_id, x, min(y) AS low FROM inside GROUP BY ALL) i JOIN g ON g.board_id = i.board_id AND g.x = i.x GROUP BY ALL),
twins AS (SELECT r.board_id, r.room, r.clue, count(p.n) AS k, min(p.n) AS low, max(p.n) AS high FROM (SELECT board_id, room, arg_max(clue, x) FILTER (clue > 0) AS clue FROM g GROUP BY ALL) r LEFT JOIN pieces p USING (board_id, room) GROUP BY ALL),
blocks AS (SELECT a.board_id FROM g a JOIN g b ON b.board_id = a.board_id AND b.s = 1 AND b.r - a.r IN (0, 1) AND b.c - a.c IN (0, 1) WHERE a.s = 1 GROUP BY a.board_id, a.x HAVING count(*) = 4)
SELECT p_partkey AS board_id, p_partkey NOT IN (SELECT board_id FROM g WHERE s = 0) AND p_partkey IN (SELECT board_id FROM parts WHERE n = 1) AND p_partkey NOT IN (SELECT board_id FROM blocks)
  AND p_partkey NOT IN (SELECT board_id FROM twins WHERE k <> 2 OR low <> high OR coalesce(clue, low) <> low) AS passed FROM part"""

# Mazes of several sizes: a comb of open teeth, rooms of up to three cells along them, some cells in another state.
COMB = ("3 + board_id % 3", "5 + 2 * (board_id % 2)")
COMB_CELL = f"""case when r = 0 and c = 0 then 3 when r = {COMB[0]} - 1 and c = {COMB[1]} - 1 then case when board_id % 17 = 6 then 0 else 4 end
  when r = 0 and c = 1 + board_id % 3 then case when board_id % 5 = 1 then 2 else 1 end when r = 2 and c = 2 and board_id % 7 = 2 then 1 when r > 0 and c < {COMB[1]} - 1 and (7 * r + 3 * c + board_id) % 11 = 0 then 2 else 0 end"""
_COMB_BASE = "case when r > 0 and c % 2 = 1 then 1 else 2 end"
COMB_STATE = f"case when board_id % 13 = 5 and r = 1 and c = 1 then 0 when board_id % 4 = 0 and r = (board_id * 7) % ({COMB[0]}) and c = (board_id * 5) % ({COMB[1]}) then 3 - ({_COMB_BASE}) else {_COMB_BASE} end"
#: No border below these cells.
COMB_OPEN = "r > 0 and (r + c + board_id) % 3 = 0"


def combs(t: Tables):
    """Boards, borders, states."""
    every = boards.cells(t, *[F.expr(x) for x in COMB], COMB_CELL)
    h = every.select("board_id", F.lit("h").alias("layer"), "r", "c", F.when(F.expr(COMB_OPEN), 0).otherwise(1).alias("v"))
    v = every.select("board_id", F.lit("v").alias("layer"), "r", "c", F.lit(1).alias("v"))
    return every, h.unionByName(v), boards.cells(t, *[F.expr(x) for x in COMB], COMB_STATE)


COMBS_SQL = f"""WITH RECURSIVE {cell_sql(*COMB, COMB_CELL)}, {cell_sql(*COMB, COMB_STATE, 'states')},
c0 AS (SELECT board_id, r, c, 16 * r + c AS x, cells.v AS v, s.v AS s FROM cells JOIN states s USING (board_id, r, c)),
down AS (SELECT a.board_id, a.x, a.x + 16 AS y FROM c0 a JOIN c0 b ON b.board_id = a.board_id AND b.x = a.x + 16 WHERE a.r > 0 AND (a.r + a.c + a.board_id) % 3 = 0),
ways AS (SELECT * FROM down UNION ALL SELECT board_id, y, x FROM down),
reach AS (SELECT board_id, x, x AS y FROM c0 UNION SELECT e.board_id, e.x, w.y FROM reach e JOIN ways w ON w.board_id = e.board_id AND w.x = e.y),
rooms AS (SELECT e.board_id, e.x, max(s) AS state FROM reach e JOIN c0 ON c0.board_id = e.board_id AND c0.x = e.y GROUP BY ALL),
g AS (SELECT board_id, r, c, x, v, state, state <> 1 AS free FROM c0 JOIN rooms USING (board_id, x)),
blocks AS (SELECT a.board_id FROM g a JOIN g b ON b.board_id = a.board_id AND b.free = a.free AND b.r - a.r IN (0, 1) AND b.c - a.c IN (0, 1) GROUP BY a.board_id, a.x HAVING count(*) = 4),
steps AS (SELECT a.board_id, a.x, b.x AS y, CASE b.x - a.x WHEN -16 THEN '0' WHEN 16 THEN '1' WHEN -1 THEN '2' ELSE '3' END AS turn FROM g a JOIN g b ON b.board_id = a.board_id AND b.free AND abs(a.r - b.r) + abs(a.c - b.c) = 1),
one AS (SELECT board_id, min(x) AS y FROM g WHERE free GROUP BY ALL UNION SELECT o.board_id, w.y FROM one o JOIN steps w ON w.board_id = o.board_id AND w.x = o.y),
lone AS (SELECT board_id FROM g WHERE free AND (board_id, x) NOT IN (SELECT (board_id, y) FROM one)),
far AS (SELECT board_id, x, 0 AS d FROM g WHERE v = 3 UNION SELECT f.board_id, w.y, d + 1 FROM far f JOIN steps w ON w.board_id = f.board_id AND w.x = f.x WHERE d < 60),
dist AS (SELECT board_id, x, min(d) AS d FROM far GROUP BY ALL),
walk AS (SELECT board_id, x, 0 AS d, '' AS turns, [x] AS xs FROM g WHERE v = 3
  UNION ALL SELECT w.board_id, m.y, w.d + 1, min(w.turns || m.turn), arg_min(list_append(w.xs, m.y), w.turns || m.turn) FROM walk w JOIN steps m ON m.board_id = w.board_id AND m.x = w.x JOIN dist t ON t.board_id = m.board_id AND t.x = m.y AND t.d = w.d + 1 GROUP BY w.board_id, m.y, w.d + 1),
won AS (SELECT w.board_id, w.xs FROM walk w JOIN g ON g.board_id = w.board_id AND g.x = w.x AND g.v = 4),
signs AS (SELECT g.board_id FROM g JOIN won USING (board_id) WHERE v = 1 AND NOT list_contains(xs, x) OR v = 2 AND list_contains(xs, x))
SELECT p_partkey AS board_id, p_partkey NOT IN (SELECT board_id FROM g WHERE state = 0) AND p_partkey NOT IN (SELECT board_id FROM blocks) AND p_partkey NOT IN (SELECT board_id FROM lone)
  AND p_partkey IN (SELECT board_id FROM won) AND p_partkey NOT IN (SELECT board_id FROM signs) AS passed FROM part"""


#: A wall on the way for some boards.
SLALOM_WALL = "case when board_id % 4 = 3 and r = 0 and c = 1 then 1 else 0 end"


def slalom_tables(t: Tables):
    """Boards, starts, gates and their number; the border ring goes through two gates, numbered forwards, backwards or wrongly."""
    every = boards.boards(t)
    number = "cast(case when board_id % 4 = 1 then 2 - gate when board_id % 4 = 2 and gate = 1 then 3 else gate + 1 end as int)"
    both = every.select("board_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("gate"))
    gates = both.select("board_id", "gate", F.expr("if(gate = 0, 'v', 'h') as orientation"), F.expr("if(gate = 0, 2, 1) as line"), F.lit(0).alias("lo"), F.lit(0).alias("hi"), F.expr(number).alias("number"))
    starts = every.select("board_id", F.lit(0).alias("r"), F.lit(0).alias("c"))
    cells = boards.cells(t, F.expr("4 + board_id % 4"), F.expr("4 + board_id % 5"), SLALOM_WALL)
    return cells, starts, gates, every.select("board_id", F.lit(2).alias("gate_count"))


#: Dashed cells of column 2 and row 3, arrows of column 1 to the right, a circle in a corner of some boards.
TYPED = """case when c = 2 and (r + board_id) % 3 <> 0 then 1 when r = 3 and c > 2 and (c + board_id) % 4 <> 0 then 2 when c = 1 and (r + board_id) % 2 = 0 then 3 when r = 0 and c = 0 and board_id % 3 > 0 then 4 else 0 end"""
KINDS = ("4 + board_id % 5", "5 + board_id % 4")


def typed(t: Tables):
    cells = boards.cells(t, F.expr(KINDS[0]), F.expr(KINDS[1]), TYPED)
    return cells.select(
        "board_id", "r", "c", F.expr("case v when 1 then 'dash' when 2 then 'dash' when 3 then 'arrow' when 4 then 'circle' end as kind"), F.expr("case v when 1 then 'left' when 2 then 'top' when 3 then 'right' end as side"), F.expr("case v when 3 then r + 1 when 4 then cast(board_id % 3 - 1 as int) end as value")
    )


TYPED_SQL = f"""WITH {cell_sql(*KINDS, TYPED)},
dashed AS (SELECT board_id, 'v' AS orientation, c AS line, r AS pos FROM cells WHERE v = 1 UNION ALL SELECT board_id, 'h', r, c FROM cells WHERE v = 2),
runs AS (SELECT *, pos - row_number() OVER (PARTITION BY board_id, orientation, line ORDER BY pos) AS g FROM dashed),
spans AS (SELECT board_id, orientation, line, min(pos) AS lo, max(pos) AS hi FROM runs GROUP BY board_id, orientation, line, g),
-- The column's first dashed cell stands in row 0 or 1, before any of row 3.
gates AS (SELECT *, row_number() OVER (PARTITION BY board_id ORDER BY orientation DESC, lo) - 1 AS gate FROM spans)"""


#: A player's line: most cells as they should be, some unset, crossed or wrong.
PLAYED = f"case when (r * 7 + c * 3 + board_id) % 6 = 0 then 0 when (r * 5 + c * 11 + board_id) % 17 = 0 then 1 + ({boards.FILL}) else 2 - ({boards.FILL}) end"


def played(t: Tables):
    """(board_id, axis, line, clue, cells) of all rows and columns."""
    cells = boards.nonogram(t, PLAYED)
    both = cells.select("board_id", F.lit("row").alias("axis"), F.col("r").alias("line"), F.col("c").alias("pos"), "v").unionByName(cells.select("board_id", F.lit("col").alias("axis"), F.col("c").alias("line"), F.col("r").alias("pos"), "v"))
    whole = both.groupBy("board_id", "axis", "line").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("cells"))  # one line
    clues = grid.line_runs(boards.nonogram(t, boards.FILL)).select("board_id", "axis", "line", F.col("runs").cast("array<int>").alias("clue"))
    return whole.join(long(clues), ["board_id", "axis", "line"])


LINES_SQL = f"""WITH {cell_sql(*NONOGRAM, boards.FILL)}, {RUNS},
clues AS (SELECT board_id, axis, line, CAST(string_split(runs, ' ') AS INTEGER[]) AS clue FROM lines),
{cell_sql(*NONOGRAM, PLAYED, 'shown')},
placed AS (SELECT board_id, 'row' AS axis, r AS line, c AS pos, v FROM shown UNION ALL SELECT board_id, 'col', c, r, v FROM shown),
size_of AS (SELECT board_id, axis, line, count(*) AS n FROM placed GROUP BY ALL),
marked AS (SELECT *, pos - row_number() OVER (PARTITION BY board_id, axis, line ORDER BY pos) AS g FROM placed WHERE v = 1),
blocks AS (SELECT board_id, axis, line, min(pos) AS s, max(pos) + 1 AS e, count(*) AS len FROM marked GROUP BY board_id, axis, line, g),
ranked AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY board_id, axis, line) AS k, coalesce(lag(e) OVER w, 0) AS pe, lead(s) OVER w AS ns FROM blocks WINDOW w AS (PARTITION BY board_id, axis, line ORDER BY s)),
seen AS (SELECT b.*, z.n, (s = 0 OR EXISTS (SELECT 1 FROM placed p WHERE p.board_id = b.board_id AND p.axis = b.axis AND p.line = b.line AND p.pos = s - 1 AND p.v = 2))
    AND (e = z.n OR EXISTS (SELECT 1 FROM placed p WHERE p.board_id = b.board_id AND p.axis = b.axis AND p.line = b.line AND p.pos = e AND p.v = 2)) AS sealed,
  NOT EXISTS (SELECT 1 FROM placed p WHERE p.board_id = b.board_id AND p.axis = b.axis AND p.line = b.line AND p.v = 0 AND p.pos >= pe AND p.pos < s) AS clear_before,
  NOT EXISTS (SELECT 1 FROM placed p WHERE p.board_id = b.board_id AND p.axis = b.axis AND p.line = b.line AND p.v = 0 AND p.pos >= e AND p.pos < coalesce(ns, z.n)) AS clear_after
  FROM ranked b JOIN size_of z USING (board_id, axis, line)),
ends AS (SELECT board_id, axis, line, max(k) AS k, count(*) FILTER (sealed) AS n_sealed, list(len ORDER BY i) AS lens, max(len) FILTER (sealed) AS longest,
  coalesce(min(i) FILTER (NOT (sealed AND clear_before)) - 1, max(k)) AS lead_, coalesce(max(k) - max(i) FILTER (NOT (sealed AND clear_after)), max(k)) AS tail FROM seen GROUP BY ALL),
sides AS (SELECT c.*, len(clue) AS m, coalesce(k, 0) AS k, coalesce(n_sealed, 0) AS n_sealed, coalesce(lens, []) AS lens, longest, least(len(clue), coalesce(lead_, 0)) AS front, coalesce(tail, 0) AS tail FROM clues c LEFT JOIN ends USING (board_id, axis, line)),
both_sides AS (SELECT *, least(m - front, tail) AS back FROM sides),
judged AS (SELECT b.*, EXISTS (SELECT 1 FROM seen x WHERE x.board_id = b.board_id AND x.axis = b.axis AND x.line = b.line AND (x.i <= front AND x.len <> clue[x.i] OR x.k - x.i < back AND x.len <> clue[m - (x.k - x.i)])) AS wrong,
  (SELECT count(*) FROM seen x WHERE x.board_id = b.board_id AND x.axis = b.axis AND x.line = b.line AND x.sealed AND x.i > front AND x.i <= b.k - back) AS between_
  FROM both_sides b),
told AS (SELECT *, CASE WHEN lens = clue THEN 'satisfied' WHEN n_sealed > m THEN 'error' WHEN m = 1 AND clue[1] = 0 THEN CASE WHEN k > 0 THEN 'error' ELSE 'satisfied' END
  WHEN longest > list_max(clue) THEN 'error' WHEN wrong OR between_ > m - front - back THEN 'error' WHEN front + back = m THEN 'satisfied' ELSE 'normal' END AS status FROM judged)
SELECT board_id, axis, CAST(line AS INTEGER) AS line, status, CAST(CASE status WHEN 'satisfied' THEN m WHEN 'normal' THEN front ELSE 0 END AS INTEGER) AS done_front, CAST(CASE status WHEN 'normal' THEN back ELSE 0 END AS INTEGER) AS done_back FROM told"""

#: Rooms by their open sides, pieces of a colour within them, and their shapes in all positions.
CHOCO_SQL = f"""WITH RECURSIVE {cell_sql(*CHOCO, CHOCO_CELLS)}, g AS (SELECT board_id, r, c, 32 * r + c AS x, v, {CHOCO_CLUE} AS clue FROM cells),
sides AS (SELECT a.board_id, a.x, b.x AS y, CASE WHEN b.x = a.x + 32 THEN true ELSE NOT (a.board_id % 3 = 2 AND a.r = 0 AND a.c = 1) AND a.c % 2 = 1 END AS drawn FROM g a JOIN g b ON b.board_id = a.board_id AND b.x - a.x IN (1, 32)),
ways AS (SELECT board_id, x, y FROM sides WHERE NOT drawn UNION ALL SELECT board_id, y, x FROM sides WHERE NOT drawn),
reach AS (SELECT board_id, x, x AS y FROM g UNION SELECT e.board_id, e.x, w.y FROM reach e JOIN ways w ON w.board_id = e.board_id AND w.x = e.y),
rooms AS (SELECT board_id, x, min(y) AS room FROM reach GROUP BY ALL), k AS (SELECT g.*, room FROM g JOIN rooms USING (board_id, x)),
counts AS (SELECT board_id, room, count(*) FILTER (v = 0) AS white, count(*) FILTER (v = 1) AS gray, min(clue) FILTER (clue > 0) AS low, max(clue) AS high FROM k GROUP BY ALL),
inner_ways AS (SELECT a.board_id, a.x, b.x AS y FROM k a JOIN k b ON b.board_id = a.board_id AND b.room = a.room AND b.v = a.v AND abs(a.r - b.r) + abs(a.c - b.c) = 1),
inside AS (SELECT board_id, x, x AS y FROM k UNION SELECT e.board_id, e.x, w.y FROM inside e JOIN inner_ways w ON w.board_id = e.board_id AND w.x = e.y),
torn AS (SELECT k.board_id FROM (SELECT board_id, x, min(y) AS low FROM inside GROUP BY ALL) p JOIN k USING (board_id, x) GROUP BY k.board_id, room, v HAVING count(DISTINCT low) > 1),
turned AS (SELECT board_id, room, v, 4 * s + 2 * a + b AS k, CASE s WHEN 0 THEN r ELSE c END * (1 - 2 * a) AS r, CASE s WHEN 0 THEN c ELSE r END * (1 - 2 * b) AS c FROM k, range(2) p(s), range(2) q(a), range(2) t(b)),
moved AS (SELECT board_id, room, v, k, r - min(r) OVER w AS r, c - min(c) OVER w AS c FROM turned WINDOW w AS (PARTITION BY board_id, room, v, k)),
shapes AS (SELECT board_id, room, v, min(shape) AS shape FROM (SELECT board_id, room, v, k, string_agg(r || ',' || c, ';' ORDER BY r, c) AS shape FROM moved GROUP BY ALL) GROUP BY ALL),
unlike AS (SELECT a.board_id FROM shapes a JOIN shapes b ON b.board_id = a.board_id AND b.room = a.room AND a.v = 0 AND b.v = 1 WHERE a.shape <> b.shape),
idle AS (SELECT s.board_id FROM sides s JOIN rooms a ON a.board_id = s.board_id AND a.x = s.x JOIN rooms b ON b.board_id = s.board_id AND b.x = s.y WHERE drawn AND a.room = b.room)
SELECT p_partkey AS board_id, p_partkey NOT IN (SELECT board_id FROM counts WHERE white <> gray OR white = 0 OR coalesce(low, white) <> white OR high > 0 AND high <> white) AND p_partkey NOT IN (SELECT board_id FROM torn)
  AND p_partkey NOT IN (SELECT board_id FROM unlike) AND p_partkey NOT IN (SELECT board_id FROM idle) AND p_partkey IN (SELECT board_id FROM sides WHERE drawn) AS passed FROM part"""

#: The loop step by step from its start, and where it enters the gates across.
SLALOM_SQL = f"""WITH RECURSIVE {cell_sql('4 + board_id % 4', '4 + board_id % 5', SLALOM_WALL)}, {RING.replace('grid AS', 'sized AS').replace('FROM grid', 'FROM sized')},
one AS (SELECT board_id, 32 * r + c AS x, CASE layer WHEN 'h' THEN 32 * r + c + 1 ELSE 32 * r + c + 32 END AS y FROM edges WHERE v = 1), link AS (SELECT * FROM one UNION ALL SELECT board_id, y, x FROM one),
degree AS (SELECT board_id, x, count(*) AS d FROM link GROUP BY ALL),
walk AS (SELECT board_id, 1 AS n, 0 AS p, min(y) AS x FROM link WHERE x = 0 GROUP BY board_id
  UNION ALL SELECT w.board_id, n + 1, w.x, l.y FROM walk w JOIN link l ON l.board_id = w.board_id AND l.x = w.x AND l.y <> w.p WHERE w.x <> 0),
gates AS (SELECT p_partkey AS board_id, g, CASE g WHEN 0 THEN 2 ELSE 32 END AS x, CASE p_partkey % 4 WHEN 1 THEN 2 - g WHEN 2 THEN CASE g WHEN 1 THEN 3 ELSE 1 END ELSE g + 1 END AS number FROM part, range(2) q(g)),
met AS (SELECT g.board_id, g.g, any_value(number) AS number, min(n) AS first FROM gates g JOIN walk w ON w.board_id = g.board_id AND w.x = g.x AND CASE g.g WHEN 0 THEN w.x % 32 <> w.p % 32 ELSE w.x // 32 <> w.p // 32 END GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY board_id ORDER BY first, g) AS nth, count(*) OVER (PARTITION BY board_id) AS k FROM met),
crossed AS (SELECT board_id FROM ranked GROUP BY board_id HAVING count(*) = 2 AND (bool_and(number = nth) OR bool_and(number = k + 1 - nth))),
walled AS (SELECT c.board_id FROM cells c JOIN degree d ON d.board_id = c.board_id AND d.x = 32 * c.r + c.c WHERE c.v = 1)
SELECT p_partkey AS board_id, p_partkey NOT IN (SELECT board_id FROM degree WHERE d <> 2) AND p_partkey IN (SELECT board_id FROM degree WHERE x = 0) AND p_partkey IN (SELECT board_id FROM crossed) AND p_partkey NOT IN (SELECT board_id FROM walled) AS passed FROM part"""

QUERIES = {
    "nonogram_line_status": (lambda t: lines.nonogram_line_status(played(t)).drop("clue", "cells"), LINES_SQL),
    "audit_double_choco": (double_choco, CHOCO_SQL),
    "audit_nuritwin": (lambda t: rooms.audit_nuritwin(*turned_twins(t)), TWINS_SQL),
    "audit_nurimaze": (lambda t: rooms.audit_nurimaze(*combs(t)), COMBS_SQL),
    "audit_slalom": (lambda t: rooms.audit_slalom(*slalom_tables(t), boards.ring(t)), SLALOM_SQL),
    "infer_gates": (
        lambda t: rooms.infer_gates(typed(t)),
        f"{TYPED_SQL} SELECT board_id, CAST(gate AS INTEGER) AS gate, orientation, CAST(line AS INTEGER) AS line, CAST(lo AS INTEGER) AS lo, CAST(hi AS INTEGER) AS hi FROM gates",
    ),
    "first_free_gate": (
        lambda t: rooms.first_free_gate(typed(t), rooms.infer_gates(typed(t))).select("board_id", "gate", "number"),
        f"""{TYPED_SQL} SELECT g.board_id, CAST(gate AS INTEGER) AS gate, CAST(min(a.r) + 1 AS INTEGER) AS number FROM gates g
           LEFT JOIN cells a ON a.board_id = g.board_id AND a.v = 3 AND g.orientation = 'v' AND a.r BETWEEN g.lo AND g.hi GROUP BY ALL""",
    ),
    "slalom_start": (
        lambda t: rooms.start_and_count(typed(t), rooms.infer_gates(typed(t))),
        f"""{TYPED_SQL} SELECT p_partkey AS board_id, 0 AS row, 0 AS col, CASE WHEN p_partkey % 3 = 2 THEN 1 ELSE count(gate) END AS gate_count FROM part LEFT JOIN gates ON board_id = p_partkey GROUP BY p_partkey""",
    ),
}
