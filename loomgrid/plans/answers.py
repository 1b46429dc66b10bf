"""Queries of answers, graph operators and the progress that needs them: name to (function of Tables, SQL)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgrid.operators import answers, graph, grid
from loomgrid.operators.joins import looked_up
from loomgrid.plans.boards import RING, RING_CELLS, STATES, SUDOKU, cell_sql
from loomgrid.sources import boards
from loomgrid.sources.analog import Tables

#: What a player set at a place of layer number k; one row beyond the board is set, too.
GIVEN = "(r * 7 + c * 5 + board_id + k) % 3"
M, N = "4 + board_id % 5", "3 + board_id % 7"


def sized(t: Tables):
    return boards.boards(t).select("board_id", F.expr(f"cast({M} as int)").alias("m"), F.expr(f"cast({N} as int)").alias("n"))


def given(t: Tables, kind: str, value: str = GIVEN):
    """Sparse values of a kind of board, as maps."""
    wide = sized(t).withColumns({"m": F.col("m") + 1, "n": F.col("n") + 1})
    numbers = F.create_map(*[F.lit(x) for k, layer in enumerate(answers.LAYERS[kind]) for x in (layer.name, k)])
    rows = answers.skeleton(wide, kind).withColumn("k", F.element_at(numbers, F.col("layer")))
    return answers.values_map(rows.withColumn("v", F.expr(value).cast("int")).filter("v > 0"))


def extracted(kind: str):
    hints = (lambda t: boards.states(t, "(r * 3 + c + board_id) % 4 - 1")) if kind == "shakashaka" else (lambda t: None)
    return lambda t: answers.extract(sized(t), given(t, kind), kind, hints(t))


def layer_sql(kind: str, name: str = "places") -> str:
    parts = [
        f"""SELECT p_partkey AS board_id, '{x.name}' AS layer, {k} AS k, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c
  FROM part, range(20) a(r), range(20) b(c) WHERE r < {M.replace('board_id', 'p_partkey')} + {x.rows} AND c < {N.replace('board_id', 'p_partkey')} + {x.columns}"""
        for k, x in enumerate(answers.LAYERS[kind])
    ]
    return f"{name} AS ({' UNION ALL '.join(parts)})"


def extract_sql(kind: str) -> str:
    value = {"nonogram": f"CASE WHEN {GIVEN} = 1 THEN 1 ELSE 0 END", "shakashaka": f"CASE WHEN (r * 3 + c + board_id) % 4 - 1 >= 0 THEN 0 ELSE {GIVEN} END"}.get(kind, GIVEN)
    return f"WITH {layer_sql(kind)} SELECT board_id, layer, r, c, CAST({value} AS INTEGER) AS v FROM places"


def sudoku_size(t: Tables):
    return boards.boards(t).select("board_id", F.lit(9).alias("m"), F.lit(9).alias("n"))


def sudoku_values(t: Tables):
    return answers.values_map(boards.sudoku(t, boards.VALUE).filter("v > 0").withColumn("layer", F.lit("cell")))


def sudoku_answers(t: Tables):
    return answers.extract(sudoku_size(t), sudoku_values(t), "sudoku", boards.sudoku(t, boards.HINT))


def combo(t: Tables):
    """Two boards that overlap in one corner, hints as in the single one."""
    one = boards.sudoku(t, boards.HINT)
    parts = [one.select("board_id", F.lit(k).alias("sub_idx"), "r", "c", (F.col("r") + 6 * k).alias("gr"), (F.col("c") + 6 * k).alias("gc"), "v") for k in (0, 1)]
    return parts[0].unionByName(parts[1])


COMBO_GIVEN = "(r + 2 * c + board_id) % 5"
COMBO = f"""{cell_sql(*SUDOKU, boards.HINT)}, subcells AS (SELECT board_id, s AS sub_idx, r, c, r + 6 * s AS gr, c + 6 * s AS gc, v FROM cells, range(2) x(s))"""


def combo_values(t: Tables):
    return answers.values_map(boards.cells(t, 15, 15, COMBO_GIVEN).filter("v > 0").withColumn("layer", F.lit("cell")))


SAME = "(floor(r / 2.0) + floor(c / 2.0) * (1 + board_id % 2) + board_id) % 3"
#: Rooms of two cells, white left of gray; colour of (0, 0) flipped for some boards.
CHOCO_CELLS = "case when board_id % 3 = 1 and r = 0 and c = 0 then 1 else c % 2 end"
CHOCO = ("4 + board_id % 3", "4 + 2 * (board_id % 3)")


def choco_borders(t: Tables):
    every = boards.cells(t, F.expr(CHOCO[0]), F.expr(CHOCO[1]), "1").drop("v")
    h = every.select("board_id", F.lit("h").alias("layer"), "r", "c", F.lit(1).alias("v"))
    v = every.select("board_id", F.lit("v").alias("layer"), "r", "c", F.expr("case when board_id % 3 = 2 and r = 0 and c = 1 then 0 else c % 2 end").alias("v"))
    return h.unionByName(v)


def border(t: Tables):
    """Steps along the border of each ring board."""
    every = boards.cells(t, F.expr("4 + board_id % 4"), F.expr("4 + board_id % 5"), "0").drop("v").withColumns({"m": F.expr("4 + board_id % 4"), "n": F.expr("4 + board_id % 5")})
    flat = every.filter("(r = 0 or r = m - 1) and c < n - 1").select("board_id", "r", "c", F.col("r").alias("nr"), (F.col("c") + 1).alias("nc"))
    return flat.unionByName(every.filter("(c = 0 or c = n - 1) and r < m - 1").select("board_id", "r", "c", (F.col("r") + 1).alias("nr"), F.col("c").alias("nc")))


COMPONENTS = """links AS (SELECT a.board_id, a.r * 1024 + a.c AS x, b.r * 1024 + b.c AS y FROM cells a JOIN cells b ON a.board_id = b.board_id AND a.v = b.v AND abs(a.r - b.r) + abs(a.c - b.c) = 1),
reach AS (SELECT board_id, r * 1024 + c AS x, r * 1024 + c AS y FROM cells UNION SELECT k.board_id, k.x, l.y FROM reach k JOIN links l ON l.board_id = k.board_id AND l.x = k.y)"""


def gates(t: Tables):
    """One upright and one flat gate per board."""
    one = boards.boards(t).select("board_id", F.lit(0).alias("gate"), F.lit("v").alias("orientation"), F.lit(2).alias("line"), F.lit(0).alias("lo"), F.expr("cast(board_id % 3 as int)").alias("hi"), F.lit(2).alias("gate_count"))
    return one.unionByName(one.withColumns({"gate": F.lit(1), "orientation": F.lit("h"), "line": F.expr("cast(1 + board_id % 3 as int)"), "hi": F.lit(0)}))


#: Free places of a maze; the way goes from the first to the last of them.
FREE = "case when (r + 2 * c + board_id) % 5 = 0 then 1 else 0 end"


def maze_ends(t: Tables):
    free = boards.states(t, FREE).filter("v = 0").groupBy("board_id").agg(F.min(F.struct("r", "c")).alias("s"), F.max(F.struct("r", "c")).alias("g"))
    return free.select("board_id", "s.r", "s.c"), free.select("board_id", "g.r", "g.c")


QUERIES = {f"extract_{k.replace('-', '_')}": (extracted(k), extract_sql(k)) for k in answers.LAYERS if k != "sudoku"}
QUERIES |= {
    "extract_sudoku": (
        sudoku_answers,
        f"""WITH {cell_sql(*SUDOKU, boards.HINT, 'hints')}, {cell_sql(*SUDOKU, boards.VALUE)} SELECT board_id, 'cell' AS layer, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, CASE WHEN h.v > 0 THEN h.v ELSE x.v END AS v FROM hints h JOIN cells x USING (board_id, r, c)""",
    ),
    "extract_combo": (
        lambda t: answers.extract_combo(combo(t), combo_values(t)),
        f"WITH {COMBO} SELECT board_id, CAST(sub_idx AS INTEGER) AS sub_idx, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, CAST(CASE WHEN v > 0 THEN v ELSE (gr + 2 * gc + board_id) % 5 END AS INTEGER) AS v FROM subcells",
    ),
    "restore_values": (
        lambda t: answers.restore_values(sudoku_answers(t), boards.sudoku(t, boards.HINT)),
        f"WITH {cell_sql(*SUDOKU, boards.VALUE)} SELECT board_id, 'cell' AS layer, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, v FROM cells WHERE v > 0",
    ),
    "progress_combo": (
        lambda t: grid.progress_filled(
            looked_up(combo(t).groupBy("board_id", F.col("gr").alias("r"), F.col("gc").alias("c")).agg(F.max(F.col("v") == 0).alias("open")), boards.cells(t, 15, 15, COMBO_GIVEN), ["board_id", "r", "c"]), F.col("open"), F.col("v") > 0
        ),
        f"""WITH {COMBO}, o AS (SELECT board_id, gr, gc FROM subcells GROUP BY ALL HAVING min(v) = 0)
           SELECT board_id, count(*) FILTER ((gr + 2 * gc + board_id) % 5 > 0) / count(*) * 100 AS progress FROM o GROUP BY ALL""",
    ),
    "progress_pencils": (
        lambda t: answers.progress_pencils(boards.states(t, "case when (r + c + board_id) % 6 = 0 then -1 else 0 end"), answers.extract(sized(t), given(t, "pencils", "case when (r * 7 + c * 5 + board_id + k) % 11 = 0 then 1 else 0 end"), "pencils")),
        f"""WITH {cell_sql(*STATES, 'case when (r + c + board_id) % 6 = 0 then -1 else 0 end')}, {layer_sql('pencils')},
           x AS (SELECT * FROM places WHERE (r * 7 + c * 5 + board_id + k) % 11 = 0),
           touched AS (SELECT board_id, r, c FROM x UNION SELECT board_id, r, c + 1 FROM x WHERE layer IN ('th', 'ev') UNION SELECT board_id, r + 1, c FROM x WHERE layer IN ('tv', 'eh') UNION SELECT board_id, r, c FROM cells WHERE v < 0)
           SELECT c.board_id, count(t.r) / count(*) * 100 AS progress FROM cells c LEFT JOIN touched t USING (board_id, r, c) GROUP BY ALL""",
    ),
    "progress_slalom": (
        lambda t: answers.progress_slalom(gates(t), boards.ring(t)),
        f"""WITH {cell_sql(*RING_CELLS)}, {RING},
           hits AS (SELECT DISTINCT board_id, 0 AS gate FROM edges WHERE v = 1 AND layer = 'h' AND c IN (1, 2) AND r <= board_id % 3
             UNION SELECT DISTINCT board_id, 1 FROM edges WHERE v = 1 AND layer = 'v' AND c = 0 AND r IN (board_id % 3, 1 + board_id % 3))
           SELECT p_partkey AS board_id, count(h.gate) / 2 * 100 AS progress FROM part LEFT JOIN hits h ON h.board_id = p_partkey GROUP BY ALL""",
    ),
    "progress_double_choco": (
        lambda t: graph.progress_double_choco(boards.cells(t, F.expr(CHOCO[0]), F.expr(CHOCO[1]), CHOCO_CELLS), choco_borders(t)),
        f"""WITH RECURSIVE {cell_sql(*CHOCO, CHOCO_CELLS)}, ways AS (SELECT a.board_id, a.r, a.c, b.c AS d FROM cells a JOIN cells b ON b.board_id = a.board_id AND b.r = a.r AND abs(b.c - a.c) = 1
             WHERE least(a.c, b.c) % 2 = 0 OR a.board_id % 3 = 2 AND a.r = 0 AND least(a.c, b.c) = 1),
           reach AS (SELECT board_id, r, c, c AS d FROM cells UNION SELECT e.board_id, e.r, e.c, w.d FROM reach e JOIN ways w ON w.board_id = e.board_id AND w.r = e.r AND w.c = e.d),
           rooms AS (SELECT board_id, r, c, min(d) AS room FROM reach GROUP BY ALL), counts AS (SELECT board_id, r, room, count(*) FILTER (v = 0) AS white, count(*) FILTER (v = 1) AS gray FROM cells JOIN rooms USING (board_id, r, c) GROUP BY ALL)
           SELECT board_id, CAST(coalesce(sum(white + gray) FILTER (white = gray AND white > 0), 0) AS DOUBLE) / sum(white + gray) * 100 AS progress FROM counts GROUP BY board_id""",
    ),
    "progress_audit": (
        lambda t: answers.progress_audit(boards.boards(t).select("board_id", (F.col("board_id") % 10 / 10).alias("stored")), grid.progress_filled(boards.states(t), F.lit(True), F.col("v") != 0)),
        f"""WITH {cell_sql(*STATES, boards.STATE)}, n AS (SELECT board_id, count(*) FILTER (v <> 0) / count(*) AS recomputed FROM cells GROUP BY ALL)
           SELECT board_id, board_id % 10 / 10 AS stored, recomputed, recomputed - board_id % 10 / 10 AS delta FROM n""",
    ),
    "connected_components": (
        lambda t: graph.same_value(boards.states(t, SAME)),
        f"WITH RECURSIVE {cell_sql(*STATES, SAME)}, {COMPONENTS} SELECT board_id, CAST(x // 1024 AS INTEGER) AS r, CAST(x % 1024 AS INTEGER) AS c, CAST(min(y) AS INTEGER) AS component FROM reach GROUP BY ALL",
    ),
    "loop_order": (
        lambda t: graph.loop_order(border(t), boards.boards(t).select("board_id", F.lit(0).alias("r"), F.lit(0).alias("c"))),
        """SELECT p_partkey AS board_id, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c,
             CAST(CASE WHEN r = 0 THEN c WHEN c = n - 1 THEN c + r WHEN r = m - 1 THEN n - 1 + m - 1 + n - 1 - c ELSE 2 * (n - 1) + 2 * (m - 1) - r END AS INTEGER) AS position
           FROM (SELECT p_partkey, 4 + p_partkey % 4 AS m, 4 + p_partkey % 5 AS n FROM part), range(8) a(r), range(9) b(c)
           WHERE r < m AND c < n AND (r = 0 OR c = 0 OR r = m - 1 OR c = n - 1)""",
    ),
    "shortest_path": (
        lambda t: graph.shortest_path(boards.states(t, FREE).filter("v = 0"), maze_ends(t)[0]),
        f"""WITH RECURSIVE {cell_sql(*STATES, FREE)}, free AS (SELECT board_id, r, c FROM cells WHERE v = 0),
           walk AS (SELECT board_id, min(r * 1024 + c) AS x, 0 AS d FROM free GROUP BY ALL
             UNION SELECT w.board_id, f.r * 1024 + f.c, w.d + 1 FROM walk w JOIN free f ON f.board_id = w.board_id AND abs(f.r - w.x // 1024) + abs(f.c - w.x % 1024) = 1 WHERE w.d < 40)
           SELECT board_id, CAST(x // 1024 AS INTEGER) AS r, CAST(x % 1024 AS INTEGER) AS c, CAST(min(d) AS INTEGER) AS distance FROM walk GROUP BY board_id, x""",
    ),
    # Of all shortest ways that is taken whose turns, read as up, down, left and right from the start, come first.
    "shortest_path_steps": (
        lambda t: graph.path_steps(boards.states(t, FREE).filter("v = 0"), *maze_ends(t)),
        f"""WITH RECURSIVE {cell_sql(*STATES, FREE)}, free AS (SELECT board_id, r * 1024 + c AS x FROM cells WHERE v = 0),
           ends AS (SELECT board_id, min(x) AS s, max(x) AS g FROM free GROUP BY ALL),
           moves AS (SELECT a.board_id, a.x, b.x AS y, CASE b.x - a.x WHEN -1024 THEN '0' WHEN 1024 THEN '1' WHEN -1 THEN '2' ELSE '3' END AS way FROM free a JOIN free b ON b.board_id = a.board_id AND abs(a.x // 1024 - b.x // 1024) + abs(a.x % 1024 - b.x % 1024) = 1),
           far AS (SELECT board_id, s AS x, 0 AS d FROM ends UNION SELECT f.board_id, y, d + 1 FROM far f JOIN moves USING (board_id, x) WHERE d < 40),
           dist AS (SELECT board_id, x, min(d) AS d FROM far GROUP BY ALL),
           way AS (SELECT board_id, s AS x, 0 AS d, '' AS turns, [s] AS xs FROM ends
             UNION ALL SELECT w.board_id, m.y, w.d + 1, min(w.turns || m.way), arg_min(list_append(w.xs, m.y), w.turns || m.way) FROM way w JOIN moves m ON m.board_id = w.board_id AND m.x = w.x JOIN dist t ON t.board_id = m.board_id AND t.x = m.y AND t.d = w.d + 1 GROUP BY w.board_id, m.y, w.d + 1),
           won AS (SELECT e.board_id, xs FROM ends e JOIN way w ON w.board_id = e.board_id AND w.x = e.g)
           SELECT board_id, CAST(i - 1 AS INTEGER) AS step, CAST(xs[i] // 1024 AS INTEGER) AS r, CAST(xs[i] % 1024 AS INTEGER) AS c FROM (SELECT board_id, xs, unnest(range(1, len(xs) + 1)) AS i FROM won)""",
    ),
}
