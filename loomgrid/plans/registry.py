"""Queries over boards of all kinds in one table: name to (function of Tables, SQL)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.operators import answers, grid, quality, registry
from loomgrid.operators.joins import long
from loomgrid.plans import audits, contours, rooms
from loomgrid.plans.answers import CHOCO, CHOCO_CELLS, QUERIES as ANSWERS, choco_borders
from loomgrid.plans.audits import RINGS_SQL
from loomgrid.plans.boards import NONOGRAM, QUERIES as BOARDS, RING, RING_CELLS, cell_sql, clues
from loomgrid.sources import boards
from loomgrid.sources.analog import Tables

#: Kinds take turns by key: the remainder is the type, and 0 is of a type that isn't known.
TURNS = 12
SUDOKU_SET = f"case when board_id % 24 > 12 and (7 * r + 11 * c + board_id) % 5 = 0 then 0 else {boards.SOLUTION} end"


class OfKind(Tables):
    """The tables with the parts whose turn it is."""

    def __init__(self, t: Tables, kind: int):
        super().__init__(t.spark, t.sf_dir)
        self.kind = kind

    def read(self, name: str) -> DataFrame:
        rows = super().read(name)
        return rows.filter(F.col("p_partkey") % TURNS == self.kind) if name == "part" else rows


def nested(cells: DataFrame, name: str = "cells") -> DataFrame:
    return grid.nest_cells(cells).withColumnRenamed("grid", name)


def as_cells(cells: DataFrame) -> DataFrame:
    return cells.filter("v <> 0").select("board_id", F.lit("cell").alias("layer"), "r", "c", "v")


def one_room_each(cells: DataFrame) -> DataFrame:
    """Borders on all sides: (board_id, grids)."""
    size = cells.groupBy("board_id").agg((F.max("r") + 1).alias("m"), (F.max("c") + 1).alias("n"))
    return size.select("board_id", F.struct(F.array_repeat(F.array_repeat(F.lit(1), F.col("n")), F.col("m") - 1).alias("h"), F.array_repeat(F.array_repeat(F.lit(1), F.col("n") - 1), F.col("m")).alias("v")).alias("grids"))


def _sudoku(t: Tables):
    return nested(boards.sudoku(t, boards.HINT), "hints"), as_cells(boards.sudoku(t, SUDOKU_SET))


def _combo(t: Tables):
    empty = F.array_repeat(F.array_repeat(F.lit(0), 9), 9)
    parts = F.array(*[F.struct(F.lit(k).alias("x"), F.lit(k).alias("y"), empty.alias("hints")) for k in (0, 2)])
    set_ = audits.solved_combo(t).groupBy("board_id", F.col("gr").alias("r"), F.col("gc").alias("c")).agg(F.max("v").alias("v"))
    return boards.boards(t).select("board_id", parts.alias("subboards")), as_cells(set_)


def _nurimaze(t: Tables):
    every = boards.cells(t, 5, 5, rooms.MAZE)
    return nested(every).join(long(one_room_each(every)), "board_id"), as_cells(boards.cells(t, 5, 5, rooms.MAZE_STATE))


def _double_choco(t: Tables):
    pairs = boards.cells(t, *[F.expr(x) for x in CHOCO], CHOCO_CELLS).withColumn("v", F.array("v", F.expr(rooms.CHOCO_CLUE).cast("int")))
    return nested(pairs), choco_borders(t).filter("v <> 0")


def _slitherlink(t: Tables):
    return nested(audits.slitherlink_cells(t)), audits.rings(t).filter("v <> 0")


def _nonogram(t: Tables):
    lists = [clues(t).filter(F.col("axis") == axis).groupBy("board_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("line", "clue"))), lambda x: x["clue"]).alias(f"{axis}Clues")) for axis in ("row", "col")]
    return lists[0].join(long(lists[1]), "board_id"), as_cells(boards.nonogram(t))


def _masyu(t: Tables):
    return nested(boards.cells(t, F.expr("4 + board_id % 4"), F.expr("4 + board_id % 5"), audits.CIRCLES)), audits.rings(t).filter("v <> 0")


def _pencils(t: Tables):
    cells, layers = contours.pencil_tables(t)
    return nested(cells), layers.filter("v <> 0")


def _nuritwin(t: Tables):
    every = boards.cells(t, 5, 5, rooms.TWIN_CLUE)
    rows = [("h", "int(r = 2)", "r < 4"), ("v", "int(c = 1 and r <= 2)", "c < 4")]
    grids = [nested(every.filter(inside).select("board_id", "r", "c", F.expr(value).alias("v")), layer) for layer, value, inside in rows]
    both = grids[0].join(long(grids[1]), "board_id").select("board_id", F.struct("h", "v").alias("grids"))
    return nested(every).join(long(both), "board_id"), as_cells(boards.cells(t, 5, 5, rooms.TWIN_STATE))


def _slalom(t: Tables):
    cells, starts, gates, _ = rooms.slalom_tables(t)
    each = F.struct(F.col("orientation"), F.col("line"), F.col("lo").alias("from"), F.col("hi").alias("to"), F.col("number"))
    listed = gates.groupBy("board_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("gate", each.alias("g")))), lambda x: x["g"]).alias("gates"))
    start = starts.select("board_id", F.struct(F.col("r").alias("row"), F.col("c").alias("col")).alias("start"), F.lit(2).alias("gateCount"))
    return nested(cells).join(long(start), "board_id").join(long(listed), "board_id"), boards.ring(t).filter("v <> 0")


def _shakashaka(t: Tables):
    white = boards.cells(t, *[F.expr(x) for x in contours.SHADED], contours.SHADED_CELL)
    return nested(white), as_cells(boards.cells(t, *[F.expr(x) for x in contours.SHADED], contours.SHADED_STATE))


MADE = {1: _sudoku, 2: _combo, 3: _nurimaze, 4: _double_choco, 5: _slitherlink, 6: _nonogram, 7: _masyu, 8: _pencils, 9: _nuritwin, 10: _slalom, 11: _shakashaka}


def games(t: Tables, made: dict = MADE) -> DataFrame:
    """(board_id, puzzle_type, canon, values): the boards of the single audits, each as a document and a player's map; some have a field too many."""
    out = []
    for kind, make in made.items():
        canon, values = make(OfKind(t, kind))
        text = F.to_json(F.struct(*[c for c in canon.columns if c != "board_id"]), {"ignoreNullFields": "false"})
        odd = F.concat(F.expr(f"substring({'canon'}, 1, length(canon) - 1)"), F.lit(',"z":1}'))
        documents = canon.select("board_id", text.alias("canon")).withColumn("canon", F.when(F.col("board_id") % 29 == 3, odd).otherwise(F.col("canon")))
        out.append(documents.join(long(answers.values_map(values)), "board_id", "left").select("board_id", F.lit(kind).alias("puzzle_type"), "canon", F.coalesce("values", F.create_map().cast("map<string,int>")).alias("values")))
    unknown = boards.boards(OfKind(t, 0)).select("board_id", F.lit(77).alias("puzzle_type"), F.lit("{}").alias("canon"), F.create_map().cast("map<string,int>").alias("values"))
    return reduce(DataFrame.unionByName, [*out, unknown])


def shares(kind: int) -> str:
    """SQL for (board_id, progress) of the boards of one kind."""
    whole = "SELECT board_id, count(*) FILTER (v <> 0) / count(*) * 100 AS progress FROM cells GROUP BY ALL"
    if kind == 1:
        return f"""WITH {cell_sql('9', '9', boards.HINT, 'hints')}, {cell_sql('9', '9', SUDOKU_SET)}
          SELECT board_id, count(*) FILTER (h.v = 0 AND x.v > 0) / count(*) FILTER (h.v = 0) * 100 AS progress FROM hints h JOIN cells x USING (board_id, r, c) GROUP BY ALL"""
    if kind == 2:
        return "SELECT p_partkey AS board_id, CASE WHEN p_partkey % 4 = 1 THEN 152 / 153 ELSE 1 END * 100 AS progress FROM part"
    if kind == 4:
        return ANSWERS["progress_double_choco"][1]
    if kind == 5:
        return f"""WITH {cell_sql('4 + board_id % 4', '4 + board_id % 5', '0')}, n AS (SELECT board_id, r, c, 4 + board_id % 4 AS m, 4 + board_id % 5 AS n FROM cells),
          {RINGS_SQL}, beside AS (SELECT board_id, r, c FROM rings UNION SELECT board_id, CASE layer WHEN 'h' THEN r - 1 ELSE r END, CASE layer WHEN 'v' THEN c - 1 ELSE c END FROM rings)
          SELECT g.board_id, count(b.r) / count(*) * 100 AS progress FROM (SELECT * FROM n WHERE r < m - 1 AND c < n - 1) g LEFT JOIN beside b USING (board_id, r, c) GROUP BY ALL"""
    if kind == 7:
        return "SELECT p_partkey AS board_id, CAST(0 AS DOUBLE) AS progress FROM part"
    if kind == 8:
        return f"""WITH {cell_sql(*contours.PENCIL, contours.PENCIL_CELL)}, places AS ({' UNION ALL '.join(contours.layer_sql(x) for x in answers.LAYERS['pencils'])}),
          x AS (SELECT * FROM (SELECT *, {contours.LAYER_VALUE} AS v FROM places) WHERE v <> 0),
          touched AS (SELECT board_id, r, c FROM x UNION SELECT board_id, r, c + 1 FROM x WHERE layer IN ('th', 'ev') UNION SELECT board_id, r + 1, c FROM x WHERE layer IN ('tv', 'eh') UNION SELECT board_id, r, c FROM cells WHERE v < 0)
          SELECT c.board_id, count(t.r) / count(*) * 100 AS progress FROM cells c LEFT JOIN touched t USING (board_id, r, c) GROUP BY ALL"""
    if kind == 10:
        return "SELECT p_partkey AS board_id, CAST(100 AS DOUBLE) AS progress FROM part"  # both gates lie on the ring, off the edge that some lack
    if kind == 11:
        return f"""WITH {cell_sql(*contours.SHADED, contours.SHADED_CELL)}, {cell_sql(*contours.SHADED, contours.SHADED_STATE, 'states')}
          SELECT board_id, count(*) FILTER (s.v <> 0) / count(*) * 100 AS progress FROM cells c JOIN states s USING (board_id, r, c) WHERE c.v = -1 GROUP BY ALL"""
    return f"WITH {cell_sql(*{3: ('5', '5', rooms.MAZE_STATE), 6: (*NONOGRAM, boards.ANSWER), 9: ('5', '5', rooms.TWIN_STATE)}[kind])} {whole}"


#: The verdicts of the single audits; a sudoku's answer has its hints.
SOLVED = "case when (5 * r + 3 * c + board_id) % 3 = 0 then " + boards.DIGIT + f" else {SUDOKU_SET} end"
VERDICTS = {
    1: f"""WITH {cell_sql('9', '9', SOLVED)}, lines AS (SELECT board_id, 'r' || r AS line, v FROM cells UNION ALL SELECT board_id, 'c' || c, v FROM cells UNION ALL SELECT board_id, 'b' || (floor(r / 3.0) * 3 + floor(c / 3.0)), v FROM cells)
      SELECT board_id, bool_and(d = 9) AS passed FROM (SELECT board_id, line, count(DISTINCT v) FILTER (v > 0) AS d FROM lines GROUP BY ALL) GROUP BY ALL""",
    2: audits.QUERIES["audit_combo"][1],
    3: rooms.MAZE_VERDICT,
    4: rooms.QUERIES["audit_double_choco"][1],
    5: audits.QUERIES["audit_slitherlink"][1],
    6: BOARDS["audit_nonogram"][1],
    7: audits.QUERIES["audit_masyu"][1],
    8: contours.QUERIES["audit_pencils"][1],
    9: rooms.TWIN_VERDICT,
    10: rooms.QUERIES["audit_slalom"][1],
    11: contours.QUERIES["audit_shakashaka"][1],
}


def every_kind(columns: str, sql: dict[int, str]) -> str:
    return " UNION ALL ".join(f"SELECT {columns} FROM ({text}) WHERE board_id % {TURNS} = {k} AND board_id % 29 <> 3" for k, text in sql.items())


EVERY = f"SELECT p_partkey AS board_id, CASE WHEN p_partkey % {TURNS} = 0 THEN 77 ELSE CAST(p_partkey % {TURNS} AS INTEGER) END AS puzzle_type FROM part"
SHARES = every_kind("board_id, progress", {k: shares(k) for k in MADE})
REGISTRY_SQL = f"""SELECT e.board_id, puzzle_type, CASE WHEN puzzle_type = 77 THEN 'type:unknown' WHEN e.board_id % 29 = 3 THEN 'extra:document' ELSE '' END AS reasons, coalesce(progress, 0) AS progress, coalesce(passed, false) AS passed
FROM ({EVERY}) e LEFT JOIN ({SHARES}) p USING (board_id) LEFT JOIN ({every_kind('board_id, passed', VERDICTS)}) v USING (board_id)"""
STORED = "board_id % 10 / 10"


def _values(kind: int) -> str:
    """SQL for the values (board_id, layer, r, c, v) that the answers of one kind give back."""
    def cells(rows: str, columns: str, value: str) -> str:
        return f"WITH {cell_sql(rows, columns, value)} SELECT board_id, 'cell' AS layer, r, c, v FROM cells"

    if kind == 1:
        return cells("9", "9", f"case when (5 * r + 3 * c + board_id) % 3 = 0 then 0 else {SUDOKU_SET} end")
    if kind == 2:
        given = f"case when board_id % 4 = 0 and r = 0 and c = 0 then (1 + board_id) % 9 + 1 when board_id % 4 = 1 and r = 14 and c = 14 then 0 else {boards.DIGIT} end"
        return cells("15", "15", f"case when r < 9 and c < 9 or r > 5 and c > 5 then {given} else 0 end")
    if kind == 4:
        return f"""WITH {cell_sql(*CHOCO, '0')} SELECT board_id, 'h' AS layer, r, c, 1 AS v FROM cells WHERE r < {CHOCO[0]} - 1
          UNION ALL SELECT board_id, 'v', r, c, CASE WHEN board_id % 3 = 2 AND r = 0 AND c = 1 THEN 0 ELSE c % 2 END FROM cells WHERE c < {CHOCO[1]} - 1"""
    if kind in (5, 7):
        return f"WITH {cell_sql('4 + board_id % 4', '4 + board_id % 5', '0')}, n AS (SELECT board_id, r, c, 4 + board_id % 4 AS m, 4 + board_id % 5 AS n FROM cells), {RINGS_SQL} SELECT board_id, layer, r, c, 1 AS v FROM rings"
    if kind == 8:
        return f"WITH {cell_sql(*contours.PENCIL, contours.PENCIL_CELL)}, places AS ({' UNION ALL '.join(contours.layer_sql(x) for x in answers.LAYERS['pencils'])}) SELECT board_id, layer, r, c, {contours.LAYER_VALUE} AS v FROM places"
    if kind == 10:
        return f"WITH {cell_sql(*RING_CELLS)}, {RING} SELECT board_id, layer, r, c, v FROM edges"
    if kind == 11:
        return f"WITH {cell_sql(*contours.SHADED, contours.SHADED_CELL)}, {cell_sql(*contours.SHADED, contours.SHADED_STATE, 'states')} SELECT board_id, 'cell' AS layer, r, c, s.v AS v FROM cells c JOIN states s USING (board_id, r, c) WHERE c.v = -1"
    return cells(*{3: ("5", "5", rooms.MAZE_STATE), 6: (*NONOGRAM, boards.ANSWER), 9: ("5", "5", rooms.TWIN_STATE)}[kind])


RESTORED = " UNION ALL ".join(f"SELECT board_id, {k} AS puzzle_type, layer, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c, CAST(v AS INTEGER) AS v FROM ({_values(k)}) WHERE v <> 0 AND board_id % {TURNS} = {k} AND board_id % 29 <> 3" for k in MADE)


def visited(t: Tables) -> DataFrame:
    """Progress of masyu boards by the documented formula."""
    own = games(t, {7: _masyu})
    return registry.judged_by(registry.split(own), lambda _: lambda g: registry.progress_masyu(g, documented=True), "board_id long, progress double")


VISITED = f"""WITH {cell_sql('4 + board_id % 4', '4 + board_id % 5', '0')}, n AS (SELECT board_id, r, c, 4 + board_id % 4 AS m, 4 + board_id % 5 AS n FROM cells), {RINGS_SQL},
  ends AS (SELECT board_id, r, c FROM rings UNION SELECT board_id, CASE layer WHEN 'v' THEN r + 1 ELSE r END, CASE layer WHEN 'h' THEN c + 1 ELSE c END FROM rings)
  SELECT n.board_id, count(e.r) / count(*) * 100 AS progress FROM n LEFT JOIN ends e USING (board_id, r, c) WHERE n.board_id % {TURNS} = 7 AND n.board_id % 29 <> 3 GROUP BY ALL"""

QUERIES = {
    "restore_all_kinds": (lambda t: registry.restore(games(t)), RESTORED),
    "progress_masyu_documented": (visited, VISITED),
    "rule_registry": (lambda t: registry.evaluate(games(t)), REGISTRY_SQL),
    "progress_audit_summary": (
        lambda t: registry.progress_summary(games(t).withColumn("stored", F.expr(STORED))),
        f"""SELECT puzzle_type, count(*) AS n, count(*) FILTER (abs(d) > 0.005 AND puzzle_type <> 6) AS drifted, round(avg(d), 6) AS mean_delta, round(max(abs(d)), 6) AS max_delta
           FROM (SELECT puzzle_type, coalesce(progress, 0) / 100 - {STORED.replace('board_id', 'e.board_id')} AS d FROM ({EVERY}) e LEFT JOIN ({SHARES}) p USING (board_id)) GROUP BY ALL""",
    ),
}
