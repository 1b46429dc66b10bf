"""Queries over boards: name to (function of Tables, SQL)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.operators import grid, quality
from loomgrid.operators.joins import long
from loomgrid.plans.relational import REACHED, unlocked
from loomgrid.sources import boards
from loomgrid.sources.analog import CTE, Tables


def cell_sql(rows: str, columns: str, value: str, name: str = "cells") -> str:
    return f"""{name} AS (SELECT board_id, r, c, CAST({value} AS INTEGER) AS v FROM (
  SELECT board_id, r, unnest(range(CAST({columns} AS BIGINT))) AS c FROM (
    SELECT p_partkey AS board_id, unnest(range(CAST({rows.replace('board_id', 'p_partkey')} AS BIGINT))) AS r FROM part)))"""


SUDOKU = ("9", "9")
NONOGRAM = ("5 + board_id % 6", "5 + board_id % 5")
STATES = ("4 + board_id % 5", "3 + board_id % 7")
BOX = "floor(r / 3.0) * 3 + floor(c / 3.0)"
RUNS = """both_axes AS (SELECT board_id, 'row' AS axis, r AS line, c AS pos, v FROM cells UNION ALL SELECT board_id, 'col', c, r, v FROM cells),
islands AS (SELECT board_id, axis, line, pos, pos - row_number() OVER (PARTITION BY board_id, axis, line ORDER BY pos) AS g FROM both_axes WHERE v = 1),
runs AS (SELECT board_id, axis, line, g, min(pos) AS begins, count(*) AS n FROM islands GROUP BY ALL),
lines AS (SELECT b.board_id, b.axis, b.line, coalesce(string_agg(n, ' ' ORDER BY begins), '0') AS runs
  FROM (SELECT DISTINCT board_id, axis, line FROM both_axes) b LEFT JOIN runs USING (board_id, axis, line) GROUP BY ALL)"""
RING = """grid AS (SELECT board_id, r, c, 4 + board_id % 4 AS m, 4 + board_id % 5 AS n FROM cells),
edges AS (SELECT board_id, 'h' AS layer, r, c, CASE WHEN (r = 0 OR r = m - 1) AND NOT (board_id % 3 = 0 AND r = 0 AND c = 0) THEN 1 ELSE 0 END AS v FROM grid WHERE c < n - 1
  UNION ALL SELECT board_id, 'v', r, c, CASE WHEN c = 0 OR c = n - 1 THEN 1 ELSE 0 END FROM grid WHERE r < m - 1)"""
RING_CELLS = ("4 + board_id % 4", "4 + board_id % 5", "0")

#: Bounds of the value that a generated document carries, and the field it is in.
BOUNDS = {
    "sudoku": ("hints", 0, 9), "nurimaze": ("cells", 0, 4), "slitherlink": ("cells", -1, 3), "nonogram": ("colClues", 0, 99), "masyu": ("cells", 0, 2),
    "pencils": ("cells", -4, 99), "nuritwin": ("cells", 0, 99), "slalom": ("cells", 0, 1), "shakashaka": ("cells", -1, 5),
}


def verdict_sql(kind: str) -> str:
    """Reasons by the variant that a board's key gives."""
    value = boards.VALUE_OF.replace("board_id", "p_partkey")
    if kind == "combo-sudoku":
        missing, bad, field, low, high = "missing:subboards", "shape:hints", "shape:hints", 0, 9
    elif kind == "double-choco":
        missing, bad, field, low, high = "missing:cells", "range:cells", "range:cells", 0, 99
    else:
        name, low, high = BOUNDS[kind]
        missing, bad, field = f"missing:{name}", f"type:{name}", f"range:{name}"
    return f"""SELECT p_partkey AS board_id, CASE p_partkey % 7 WHEN 2 THEN '{missing}' WHEN 4 THEN '{bad}' WHEN 5 THEN '{bad}'
  ELSE concat_ws(',', CASE WHEN p_partkey % 7 = 3 THEN 'extra:document' END, CASE WHEN {value} NOT BETWEEN {low} AND {high} THEN '{field}' END) END AS reasons FROM part"""


def validated(kind: str):
    return lambda t: boards.documents(t, kind).select("board_id", F.array_join(quality.validate(kind, F.col("canon")), ",").alias("reasons"))


def clues(t: Tables):
    return grid.line_runs(boards.nonogram(t, boards.FILL)).withColumnRenamed("runs", "clue")


def relation(t: Tables):
    """All foreign keys, against parents of which some are missing."""
    few = t.questions.filter("id % 50 <> 3")
    checks = (
        (t.attempts, "question", few, "attempt.question"), (t.questions, "src_collection", t.collections.filter("id <> 4"), "question.src_collection"), (t.attempts, "player", t.players.filter("id % 9 <> 2"), "attempt.player"),
        (t.questions, "puzzle_type", t.types.filter("id <> 3"), "question.puzzle_type"), (t.snapshots, "attempt", t.attempt_list, "snapshot.attempt"), (unlocked(t), "player", t.players.filter("id % 9 <> 2"), "achievement.player"),
    )
    return reduce(DataFrame.unionByName, [quality.fk_check(*x) for x in checks])


QUERIES = {f"validate_{k.replace('-', '_').replace('combo_sudoku', 'combo')}": (validated(k), verdict_sql(k)) for k in quality.KINDS.values()}
QUERIES |= {
    "validate_dispatch": (
        lambda t: boards.documents(t, "slitherlink").select("board_id", F.array_join(quality.validate_dispatch(F.when(F.col("board_id") % 2 == 0, 5).otherwise(77), F.col("canon")), ",").alias("reasons")),
        f"SELECT board_id, CASE WHEN board_id % 2 = 0 THEN reasons ELSE 'type:unknown' END AS reasons FROM ({verdict_sql('slitherlink')})",
    ),
    "validate_shape": (
        lambda t: boards.documents(t, "nurimaze")
        .select("board_id", F.from_json("canon", f"cells {quality.GRID}, grids struct<h:{quality.GRID},v:{quality.GRID}>").alias("d"))
        .select("board_id", F.array_join(quality.validate_shape(F.when(F.col("board_id") % 3 == 0, F.slice("d.cells", 1, 1)).otherwise(F.col("d.cells")), F.col("d.grids.h"), F.col("d.grids.v")), ",").alias("reasons")),
        "SELECT p_partkey AS board_id, CASE WHEN p_partkey % 7 IN (2, 4) THEN 'ragged,h,v' WHEN p_partkey % 3 = 0 THEN 'small,h,v' ELSE '' END AS reasons FROM part",
    ),
    "derive_dimensions": (
        lambda t: boards.documents(t, "combo-sudoku")
        .unionByName(boards.documents(t, "nonogram").withColumn("board_id", F.col("board_id") + 1_000_000_000))
        .select("board_id", quality.derive_dimensions(F.replace("canon", F.lit('"x":0'), F.concat(F.lit('"x":'), F.col("board_id") % 5))).alias("d")).select("board_id", "d.*"),
        """SELECT p_partkey AS board_id, CASE WHEN p_partkey % 7 <> 2 THEN CAST(p_partkey % 5 + 9 AS INTEGER) END AS width, CASE WHEN p_partkey % 7 <> 2 THEN 9 END AS height, CASE WHEN p_partkey % 7 <> 2 THEN CAST(3 * (p_partkey % 5) + 9 AS INTEGER) END AS width_cells FROM part
           UNION ALL SELECT p_partkey + 1000000000, CASE WHEN p_partkey % 7 NOT IN (2, 4) THEN 2 END, 2, CASE WHEN p_partkey % 7 NOT IN (2, 4) THEN 2 END FROM part""",
    ),
    "explode_board": (
        lambda t: grid.explode_cells(boards.documents(t, "sudoku").select("board_id", F.from_json("canon", f"hints {quality.GRID}")["hints"].alias("g")), "g"),
        f"""SELECT p_partkey AS board_id, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, CAST(CASE WHEN c < 8 THEN 0 WHEN p_partkey % 7 = 5 THEN 1.5 ELSE {boards.VALUE_OF.replace('board_id', 'p_partkey')} END AS DOUBLE) AS v
           FROM part, range(9) x(r), range(9) y(c) WHERE p_partkey % 7 NOT IN (2, 4)""",
    ),
    "rebuild_hints": (
        lambda t: grid.nest_cells(boards.sudoku(t, boards.HINT)).select("board_id", F.to_json("grid").alias("grid")),
        f"WITH {cell_sql(*SUDOKU, boards.HINT)} SELECT board_id, '[' || string_agg(row, ',' ORDER BY r) || ']' AS grid FROM (SELECT board_id, r, '[' || string_agg(v, ',' ORDER BY c) || ']' AS row FROM cells GROUP BY ALL) GROUP BY ALL",
    ),
    "fk_check": (
        relation,
        CTE + f", {REACHED} " + """SELECT 'attempt.question' AS relation, question AS key, count(*) AS n FROM attempts WHERE question NOT IN (SELECT id FROM questions WHERE id % 50 <> 3) GROUP BY ALL
           UNION ALL SELECT 'question.src_collection', src_collection, count(*) FROM questions WHERE src_collection NOT IN (SELECT id FROM collections WHERE id <> 4) GROUP BY ALL
           UNION ALL SELECT 'attempt.player', player, count(*) FROM attempts WHERE player NOT IN (SELECT id FROM players WHERE id % 9 <> 2) GROUP BY ALL
           UNION ALL SELECT 'question.puzzle_type', puzzle_type, count(*) FROM questions WHERE puzzle_type NOT IN (SELECT id FROM types WHERE id <> 3) GROUP BY ALL
           UNION ALL SELECT 'snapshot.attempt', attempt, count(*) FROM snapshots WHERE attempt NOT IN (SELECT id FROM attempt_list) GROUP BY ALL
           UNION ALL SELECT 'achievement.player', player, count(*) FROM reached WHERE player % 2 = 0 AND player NOT IN (SELECT id FROM players WHERE id % 9 <> 2) GROUP BY ALL""",
    ),
    "unique_check": (
        lambda t: quality.unique_check(t.attempts, ["player", "question"]),
        CTE + "SELECT player, question, count(*) AS n FROM attempts GROUP BY ALL HAVING count(*) > 1",
    ),
    # Every primary and unique key; attempts and snapshots come twice for some players and attempts.
    "unique_keys": (
        lambda t: quality.unique_keys([
            ("types", t.types, ["id"]), ("collections", t.collections, ["id"]), ("players", t.players, ["id"]), ("questions", t.questions, ["id"]),
            ("attempts", t.attempt_list.unionByName(t.attempt_list.filter("player % 11 = 1")), ["id"]), ("snapshots", t.snapshots.unionByName(t.snapshots.filter("attempt % 7 = 2")), ["id"]),
            ("achievements", unlocked(t).unionByName(unlocked(t).filter("player % 10 = 4")), ["player", "achievement_id"]), ("finishes", t.attempts, ["player", "question", "finished_at"]),
        ]),
        CTE + f""", {REACHED} SELECT 'attempts' AS relation, CAST(id AS VARCHAR) AS key, CAST(2 AS BIGINT) AS n FROM attempt_list WHERE player % 11 = 1
           UNION ALL SELECT 'snapshots', CAST(id AS VARCHAR), 2 FROM snapshots WHERE attempt % 7 = 2 UNION ALL SELECT 'achievements', player || ',' || achievement_id, 2 FROM reached WHERE player % 10 = 4
           UNION ALL SELECT 'finishes', player || ',' || question || ',' || coalesce(strftime(finished_at, '%Y-%m-%d %H:%M:%S'), '-'), count(*) FROM attempts GROUP BY player, question, finished_at HAVING count(*) > 1""",
    ),
    "schema_drift": (
        lambda t: boards.documents(t, "nurimaze").select("board_id", quality.key_diff(F.coalesce(F.json_object_keys("canon"), F.array().cast("array<string>")), F.array(F.lit("cells"), F.lit("grids"))).alias("d"))
        .select("board_id", F.array_join("d.only_a", ",").alias("only_a"), F.array_join("d.only_b", ",").alias("only_b")),
        "SELECT p_partkey AS board_id, CASE WHEN p_partkey % 7 = 3 THEN 'z' ELSE '' END AS only_a, CASE WHEN p_partkey % 7 = 2 THEN 'cells' ELSE '' END AS only_b FROM part",
    ),
    "sudoku_conflicts": (
        lambda t: grid.sudoku_conflicts(boards.sudoku(t)),
        f"""WITH {cell_sql(*SUDOKU, boards.SOLUTION)} SELECT board_id, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, v FROM cells WHERE v > 0
           QUALIFY count(*) OVER (PARTITION BY board_id, r, v) > 1 OR count(*) OVER (PARTITION BY board_id, c, v) > 1 OR count(*) OVER (PARTITION BY board_id, {BOX}, v) > 1""",
    ),
    "line_runs": (
        lambda t: grid.line_runs(boards.nonogram(t)).select("board_id", "axis", "line", F.array_join(F.transform("runs", lambda n: n.cast("string")), " ").alias("runs")),
        f"WITH {cell_sql(*NONOGRAM, boards.ANSWER)}, {RUNS} SELECT board_id, axis, CAST(line AS INTEGER) AS line, runs FROM lines",
    ),
    "merge_gate_runs": (
        lambda t: grid.merge_gate_runs(boards.states(t, boards.DASHED).filter("v = 1").select("board_id", F.col("c").alias("line"), F.col("r").alias("pos"))),
        f"""WITH {cell_sql(*STATES, boards.DASHED)}, x AS (SELECT board_id, c AS line, r AS pos, r - row_number() OVER (PARTITION BY board_id, c ORDER BY r) AS g FROM cells WHERE v = 1)
           SELECT board_id, CAST(line AS INTEGER) AS line, CAST(min(pos) AS INTEGER) AS lo, CAST(max(pos) AS INTEGER) AS hi FROM x GROUP BY board_id, line, g ORDER BY 1""",
    ),
    "covered_cells": (
        lambda t: grid.covered_cells(
            boards.sudoku(t, "0").select("board_id", F.explode(F.array(F.struct(F.col("r").alias("gr"), F.col("c").alias("gc")), F.struct((F.col("r") + 6).alias("gr"), (F.col("c") + 6).alias("gc")))).alias("g")).select("board_id", "g.*")
        ),
        f"WITH {cell_sql(*SUDOKU, '0')} SELECT board_id, CAST(r AS INTEGER) AS gr, CAST(c AS INTEGER) AS gc FROM cells UNION SELECT board_id, CAST(r + 6 AS INTEGER), CAST(c + 6 AS INTEGER) FROM cells",
    ),
    "neighbour_join": (
        lambda t: grid.neighbours(boards.states(t, "(r * r + c * c + board_id) % 3")).filter("v = nv").groupBy("board_id").agg(F.count("*").alias("n")),
        f"""WITH {cell_sql(*STATES, '(r * r + c * c + board_id) % 3')} SELECT a.board_id, count(*) AS n FROM cells a JOIN cells b ON a.board_id = b.board_id AND a.v = b.v
           AND (b.r = a.r + 1 AND b.c = a.c OR b.r = a.r AND b.c = a.c + 1) GROUP BY ALL""",
    ),
    "block_2x2": (
        lambda t: grid.block_2x2(boards.states(t, "case when (r * r + c + board_id) % 4 < 3 then 1 else 0 end"), 1),
        f"""WITH {cell_sql(*STATES, 'case when (r * r + c + board_id) % 4 < 3 then 1 else 0 end')}, x AS (
           SELECT board_id, r + d AS r, c + e AS c FROM cells, (VALUES (0), (-1)) p(d), (VALUES (0), (-1)) q(e) WHERE v = 1)
           SELECT board_id, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c FROM x GROUP BY ALL HAVING count(*) = 4""",
    ),
    "degree_check": (
        lambda t: grid.degree_check(boards.ring(t)),
        f"""WITH {cell_sql(*RING_CELLS)}, {RING}, nodes AS (SELECT board_id, r, c FROM edges WHERE v = 1 UNION ALL
           SELECT board_id, CASE layer WHEN 'v' THEN r + 1 ELSE r END, CASE layer WHEN 'h' THEN c + 1 ELSE c END FROM edges WHERE v = 1)
           SELECT board_id, bool_and(d = 2) AS ok FROM (SELECT board_id, r, c, count(*) AS d FROM nodes GROUP BY ALL) GROUP BY ALL""",
    ),
    "shape_key": (
        lambda t: boards.states(t, "case when r + c < 3 and (r + 2 * c + board_id) % 4 <> 0 then 1 else 0 end").filter("v = 1").groupBy("board_id").agg(F.collect_list(F.struct("r", "c")).alias("p")).select("board_id", grid.shape_key(F.col("p")).alias("shape")),
        f"""WITH {cell_sql(*STATES, 'case when r + c < 3 and (r + 2 * c + board_id) % 4 <> 0 then 1 else 0 end')}, v AS (
           SELECT board_id, s * 4 + x * 2 + y AS k, CASE s WHEN 0 THEN r ELSE c END * (1 - 2 * x) AS r, CASE s WHEN 0 THEN c ELSE r END * (1 - 2 * y) AS c
           FROM cells, range(2) a(s), range(2) b(x), range(2) d(y) WHERE v = 1),
           m AS (SELECT board_id, k, r - min(r) OVER w AS r, c - min(c) OVER w AS c FROM v WINDOW w AS (PARTITION BY board_id, k))
           SELECT board_id, min(shape) AS shape FROM (SELECT board_id, k, string_agg(r || ',' || c, ';' ORDER BY r, c) AS shape FROM m GROUP BY ALL) GROUP BY board_id""",
    ),
    "progress_sudoku": (
        lambda t: grid.progress_filled(boards.sudoku(t, boards.HINT).withColumnRenamed("v", "hint").join(long(boards.sudoku(t, boards.VALUE)), ["board_id", "r", "c"]), F.col("hint") == 0, F.col("v") > 0),
        f"""WITH {cell_sql(*SUDOKU, boards.HINT, 'hints')}, {cell_sql(*SUDOKU, boards.VALUE)}
           SELECT board_id, count(*) FILTER (h.v = 0 AND x.v > 0) / count(*) FILTER (h.v = 0) * 100 AS progress FROM hints h JOIN cells x USING (board_id, r, c) GROUP BY ALL""",
    ),
    **{
        f"progress_{k}": (
            lambda t, s=s: grid.progress_filled(boards.states(t, s), F.lit(True), F.col("v") != 0),
            f"WITH {cell_sql(*STATES, s)} SELECT board_id, count(*) FILTER (v <> 0) / count(*) * 100 AS progress FROM cells GROUP BY ALL",
        )
        for k, s in (("nurimaze", boards.STATE), ("nuritwin", "(r * 5 + c * 7 + board_id) % 4"), ("nonogram", "(r + c * c + board_id) % 2"))
    },
    "progress_masyu": (
        lambda t: grid.progress_filled(boards.states(t), F.lit(True), F.lit(False)),
        "SELECT p_partkey AS board_id, CAST(0 AS DOUBLE) AS progress FROM part",
    ),
    "progress_shakashaka": (
        lambda t: grid.progress_filled(boards.states(t, "(r * 3 + c + board_id) % 4 - 1").withColumn("s", F.expr("(r + c + board_id) % 5")), F.col("v") == -1, F.col("s") != 0),
        f"""WITH {cell_sql(*STATES, '(r * 3 + c + board_id) % 4 - 1')} SELECT board_id, CASE WHEN count(*) FILTER (v = -1) = 0 THEN 100 ELSE
           count(*) FILTER (v = -1 AND (r + c + board_id) % 5 <> 0) / count(*) FILTER (v = -1) * 100 END AS progress FROM cells GROUP BY ALL""",
    ),
    "progress_slitherlink": (
        lambda t: grid.progress_touched(boards.cells(t, F.expr("3 + board_id % 4"), F.expr("3 + board_id % 5"), "0"), grid.sides(boards.ring(t))),
        f"""WITH {cell_sql(*RING_CELLS)}, {RING}, beside AS (SELECT board_id, r, c FROM edges WHERE v <> 0 UNION
           SELECT board_id, CASE layer WHEN 'h' THEN r - 1 ELSE r END, CASE layer WHEN 'v' THEN c - 1 ELSE c END FROM edges WHERE v <> 0)
           SELECT g.board_id, count(b.r) / count(*) * 100 AS progress FROM (SELECT * FROM grid WHERE r < m - 1 AND c < n - 1) g LEFT JOIN beside b USING (board_id, r, c) GROUP BY ALL""",
    ),
    "audit_sudoku": (
        lambda t: grid.audit_sudoku(boards.sudoku(t)),
        f"""WITH {cell_sql(*SUDOKU, boards.SOLUTION)}, lines AS (SELECT board_id, 'r' || r AS line, v FROM cells UNION ALL SELECT board_id, 'c' || c, v FROM cells UNION ALL SELECT board_id, 'b' || ({BOX}), v FROM cells)
           SELECT board_id, bool_and(d = 9) AS passed FROM (SELECT board_id, line, count(DISTINCT v) AS d FROM lines GROUP BY ALL) GROUP BY ALL""",
    ),
    "audit_nonogram": (
        lambda t: grid.audit_nonogram(boards.nonogram(t), clues(t)),
        f"""WITH {cell_sql(*NONOGRAM, boards.ANSWER)}, {RUNS}, shown AS (SELECT board_id, axis, line, runs AS given FROM lines),
           told AS (WITH {cell_sql(*NONOGRAM, boards.FILL)}, {RUNS} SELECT board_id, axis, line, runs FROM lines) SELECT board_id, bool_and(runs = given) AS passed FROM told JOIN shown USING (board_id, axis, line) GROUP BY ALL""",
    ),
}
