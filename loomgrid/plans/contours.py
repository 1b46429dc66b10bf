"""Queries of audits of half-filled boards and of pencils: name to (function of Tables, SQL that follows contours and trails step by step)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgrid.operators import answers, contours, trails
from loomgrid.plans.boards import cell_sql
from loomgrid.sources import boards
from loomgrid.sources.analog import Tables

# A diamond of 2 or 4 rows at (A, B), H half of them; a clue below it, and a white rectangle at the bottom.
A, B, H, S = "(board_id % 3)", "(board_id % 2)", "(1 + board_id % 2)", "(2 + 2 * (board_id % 2))"
SHADED = (f"{A} + {S} + 3", f"{B} + {S} + 1 + board_id % 4")
X, Y = f"(r - {A})", f"(c - {B})"
INSIDE = f"{X} + {Y} >= {H} - 1 and {Y} - {X} <= {H} and {X} - {Y} <= {H} and {X} + {Y} <= {S} - 1 + {H}"
BELOW = f"r > {A} + {S} and c <= 1 + board_id % 3"
SHADED_CELL = f"""case when {INSIDE} then -1 when {BELOW} and not (board_id % 13 = 4 and r = {A} + {S} + 1 and c = 0) then -1
  when r = {A} + {S} and c = {B} + {H} - 1 then case when board_id % 11 = 5 then 2 else 1 end else 5 end"""
#: The solved state, another one at one place of every third board.
SHADED_STATE = f"""case when board_id % 3 = 0 and r = (board_id * 7) % ({SHADED[0]}) and c = (board_id * 5) % ({SHADED[1]}) then board_id % 6
  when {INSIDE} and {X} + {Y} = {H} - 1 then 1 when {INSIDE} and {Y} - {X} = {H} then 2 when {INSIDE} and {X} - {Y} = {H} then 3 when {INSIDE} and {X} + {Y} = {S} - 1 + {H} then 4
  when (r + c + board_id) % 4 = 0 then 5 else 0 end"""
SHAKASHAKA_SQL = f"""WITH RECURSIVE {cell_sql(*SHADED, SHADED_CELL)}, {cell_sql(*SHADED, SHADED_STATE, 'states')},
g AS (SELECT c.board_id, c.r, c.c, c.v, CASE WHEN s.v BETWEEN 1 AND 4 THEN s.v ELSE 0 END AS s FROM cells c JOIN states s USING (board_id, r, c)),
wrong AS (SELECT a.board_id FROM g a LEFT JOIN g b ON b.board_id = a.board_id AND abs(a.r - b.r) + abs(a.c - b.c) = 1 AND b.s > 0 WHERE a.v BETWEEN 0 AND 4 GROUP BY a.board_id, a.r, a.c, a.v HAVING count(b.s) <> a.v),
k AS (SELECT board_id, r, c, s FROM g WHERE v = -1),
-- The place beside and the place ahead of each kind on a contour.
turns(s, dr, dc, t, er, ec) AS (VALUES (1, 0, 1, 2, -1, 1), (2, 1, 0, 4, 1, 1), (4, 0, -1, 3, 1, -1), (3, -1, 0, 1, -1, -1)),
nexts AS (SELECT k.board_id, k.r, k.c, CASE WHEN b.s = t THEN b.r ELSE d.r END AS nr, CASE WHEN b.s = t THEN b.c ELSE d.c END AS nc, CAST(b.s = t AS INTEGER) AS turn
  FROM k JOIN turns USING (s) JOIN k b ON b.board_id = k.board_id AND b.r = k.r + dr AND b.c = k.c + dc LEFT JOIN k d ON d.board_id = k.board_id AND d.r = k.r + er AND d.c = k.c + ec AND d.s = k.s
  WHERE b.s = t OR b.s = 0 AND d.s IS NOT NULL),
walk AS (SELECT board_id, r AS sr, c AS sc, nr AS r, nc AS c, turn AS n FROM nexts
  UNION ALL SELECT w.board_id, sr, sc, x.nr, x.nc, n + turn FROM walk w JOIN nexts x ON x.board_id = w.board_id AND x.r = w.r AND x.c = w.c WHERE NOT (w.r = sr AND w.c = sc)),
closed AS (SELECT board_id, sr, sc FROM walk WHERE r = sr AND c = sc AND n = 4),
ring AS (SELECT w.board_id, sr AS r, sc AS c, min(w.r * 1024 + w.c) AS first FROM walk w JOIN closed USING (board_id, sr, sc) GROUP BY ALL),
loose AS (SELECT board_id FROM k WHERE s > 0 AND (board_id, r, c) NOT IN (SELECT (board_id, sr, sc) FROM closed)),
white AS (SELECT board_id, r, c FROM k WHERE s = 0),
reach AS (SELECT board_id, r, c, r * 1024 + c AS y FROM white UNION SELECT a.board_id, b.r, b.c, y FROM reach a JOIN white b ON b.board_id = a.board_id AND abs(a.r - b.r) + abs(a.c - b.c) = 1),
piece AS (SELECT board_id, r, c, min(y) AS piece FROM reach GROUP BY ALL),
bent AS (SELECT board_id, piece FROM piece GROUP BY ALL HAVING count(*) <> (max(r) - min(r) + 1) * (max(c) - min(c) + 1)),
led AS (SELECT p.board_id, p.piece FROM piece p JOIN ring x ON x.board_id = p.board_id AND abs(p.r - x.r) + abs(p.c - x.c) = 1 AND x.first < p.piece)
SELECT p_partkey AS board_id, p_partkey NOT IN (SELECT board_id FROM wrong) AND p_partkey NOT IN (SELECT board_id FROM loose) AND p_partkey NOT IN (SELECT board_id FROM (FROM bent EXCEPT FROM led)) AS passed FROM part"""

# Pencils side by side, each of K cells, a head and a trail; along rows, or along columns where board_id is odd.
K, ALONG, ACROSS = "(1 + board_id % 3)", "(case when board_id % 2 = 0 then c else r end)", "(case when board_id % 2 = 0 then r else c end)"
PENCIL = tuple(f"(case when board_id % 2 = {k} then 1 + board_id % 4 else 2 * {K} + 1 end)" for k in (0, 1))
HEAD = "(case when board_id % 2 = 0 then -4 else -2 end)"
PENCIL_CELL = f"""case when {ALONG} = {K} and ({ACROSS} + board_id) % 2 = 0 then {HEAD} when {ALONG} = 0 and ({ACROSS} + board_id) % 3 = 0 then case when board_id % 7 = 3 then {K} + 1 else {K} end else 0 end"""
#: Numbers of the layers of an answer; one place of layer board_id % 9 is changed.
LAYER_NUMBERS = {"th": 0, "tv": 1, "hd": 2, "eh": 3, "ev": 4}
NUMBER = "(case layer " + " ".join(f"when '{x}' then {k}" for x, k in LAYER_NUMBERS.items()) + " end)"
CHANGED = f"{NUMBER} = board_id % 9 and r = (board_id * 3) % {PENCIL[0]} and c = (board_id * 5) % {PENCIL[1]}"
LAYER_VALUE = f"""case when layer = 'hd' then case when ({ALONG} = {K} and ({ACROSS} + board_id) % 2 <> 0) <> ({CHANGED}) then case when {CHANGED} then -1 - board_id % 4 else {HEAD} end else 0 end
  when (layer = 'th' and board_id % 2 = 0 and c >= {K} or layer = 'tv' and board_id % 2 = 1 and r >= {K} or layer = 'eh' and board_id % 2 = 0 or layer = 'ev' and board_id % 2 = 1) <> ({CHANGED}) then 1 else 0 end"""


def pencil_tables(t: Tables):
    """Boards and answers."""
    sized = boards.boards(t).select("board_id", *[F.expr(x).cast("int").alias(k) for k, x in zip("mn", PENCIL, strict=True)])
    drawn = answers.skeleton(sized, "pencils").withColumn("v", F.expr(LAYER_VALUE).cast("int"))
    return boards.cells(t, *[F.expr(x) for x in PENCIL], PENCIL_CELL), drawn


def layer_sql(layer: answers.Layer) -> str:
    return f"SELECT board_id, '{layer.name}' AS layer, r, c FROM cells WHERE r < {PENCIL[0]} + {layer.rows} AND c < {PENCIL[1]} + {layer.columns}"


PENCILS_SQL = f"""WITH RECURSIVE {cell_sql(*PENCIL, PENCIL_CELL)}, places AS ({' UNION ALL '.join(layer_sql(x) for x in answers.LAYERS['pencils'])}),
drawn AS (SELECT *, {LAYER_VALUE} AS v FROM places),
g AS (SELECT c.board_id, c.r, c.c, c.r * 1024 + c.c AS x, c.v, CASE WHEN c.v < 0 THEN c.v ELSE least(d.v, 0) END AS d FROM cells c JOIN drawn d ON d.board_id = c.board_id AND d.r = c.r AND d.c = c.c AND layer = 'hd'),
heads AS (SELECT board_id, x AS h, d, x + CASE d WHEN -1 THEN 1024 WHEN -2 THEN -1024 WHEN -3 THEN 1 ELSE -1 END AS base FROM g WHERE d < 0),
wall AS (SELECT board_id, r * 1024 + c AS x, r * 1024 + c + CASE layer WHEN 'eh' THEN 1024 ELSE 1 END AS y FROM drawn WHERE layer IN ('eh', 'ev') AND v = 1 UNION SELECT board_id, least(h, base), greatest(h, base) FROM heads),
door AS (SELECT a.board_id, a.x, b.x AS y FROM g a JOIN g b ON b.board_id = a.board_id AND abs(a.r - b.r) + abs(a.c - b.c) = 1 WHERE (a.board_id, least(a.x, b.x), greatest(a.x, b.x)) NOT IN (SELECT (board_id, x, y) FROM wall)),
body AS (SELECT h.board_id, h, g.x FROM heads h JOIN g ON g.board_id = h.board_id AND g.x = base UNION SELECT b.board_id, h, y FROM body b JOIN door USING (board_id, x)),
built AS (SELECT b.board_id, h, count(*) AS n, (max(g.r) - min(g.r) + 1) * (max(g.c) - min(g.c) + 1) AS area, count(*) FILTER (g.d < 0) AS heads, min(g.v) FILTER (g.v > 0) AS low, max(g.v) FILTER (g.v > 0) AS high FROM body b JOIN g USING (board_id, x) GROUP BY ALL),
one AS (SELECT board_id, r * 1024 + c AS x, r * 1024 + c + CASE layer WHEN 'th' THEN 1 ELSE 1024 END AS y, CASE layer WHEN 'th' THEN 1 ELSE 3 END AS way FROM drawn WHERE layer IN ('th', 'tv') AND v = 1),
link AS (SELECT * FROM one UNION ALL SELECT board_id, y, x, way - 1 FROM one),
-- A walk in each direction that a head has, by every way on; where there are two the trail branches.
walk AS (SELECT board_id, h, l.way, 0 AS n, y AS x, [h, y] AS seen FROM heads JOIN link l USING (board_id) WHERE l.x = h
  UNION ALL SELECT w.board_id, h, w.way, n + 1, y, list_append(seen, y) FROM walk w JOIN link l ON l.board_id = w.board_id AND l.x = w.x WHERE NOT list_contains(seen, y)),
way AS (SELECT board_id, h, way, max(k) AS most, list(x) AS xs, min(x) FILTER (n = 0) AS begin FROM (SELECT *, count(*) OVER (PARTITION BY board_id, h, way, n) AS k FROM walk) GROUP BY ALL),
kept AS (SELECT w.*, count(*) OVER (PARTITION BY w.board_id, w.h) AS links FROM way w),
taken AS (SELECT k.* FROM kept k WHERE NOT EXISTS (SELECT 1 FROM way o WHERE o.board_id = k.board_id AND o.h = k.h AND o.way < k.way AND list_contains(o.xs, k.begin))),
trail AS (SELECT board_id, h, max(links) AS links, max(most) AS most, list_distinct(flatten(list(xs))) AS xs FROM taken GROUP BY ALL),
bad AS (SELECT h.board_id FROM heads h LEFT JOIN built b USING (board_id, h) LEFT JOIN trail t USING (board_id, h)
  WHERE NOT coalesce(n = area AND b.heads = 0 AND links <= 2 AND most = 1 AND len(xs) = n AND coalesce(low, n) = n AND coalesce(high, n) = n, false)),
claim AS (SELECT board_id, h AS x FROM heads UNION ALL SELECT board_id, x FROM body UNION ALL SELECT board_id, unnest(xs) FROM trail),
odd AS (SELECT g.board_id FROM g LEFT JOIN claim q ON q.board_id = g.board_id AND q.x = g.x GROUP BY g.board_id, g.x HAVING count(q.x) <> 1)
SELECT p_partkey AS board_id, p_partkey NOT IN (SELECT board_id FROM bad) AND p_partkey NOT IN (SELECT board_id FROM odd) AS passed FROM part"""

QUERIES = {
    "audit_shakashaka": (lambda t: contours.audit_shakashaka(*[boards.cells(t, *[F.expr(x) for x in SHADED], v) for v in (SHADED_CELL, SHADED_STATE)]), SHAKASHAKA_SQL),
    "audit_pencils": (lambda t: trails.audit_pencils(*pencil_tables(t)), PENCILS_SQL),
}
