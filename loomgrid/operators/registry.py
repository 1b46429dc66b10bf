"""Boards of all kinds in one table: each is validated, scored and audited by the rules of its kind.

A game is a document and the values that a player has set.  The table is split
by kind once; a kind's documents become the long tables that its rules work on,
and every rule has the same signature: games of one kind in, a row per board out.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from functools import cached_property, reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.operators import answers, audit, contours, graph, grid, quality, rooms, trails
from loomgrid.operators.joins import long
from loomgrid.sources.tables import shared_folder

GRID = "array<array<double>>"
PLACE = ["board_id", "r", "c"]


class Games:
    """Valid games (board_id, canon, values) of one kind, as long tables."""

    def __init__(self, rows: DataFrame, kind: str):
        self.rows, self.kind = rows, kind

    def field(self, name: str, schema: str = GRID) -> DataFrame:
        """(board_id, x) of one field of the documents."""
        return self.rows.select("board_id", F.from_json("canon", f"`{name}` {schema}")[name].alias("x"))

    def matrix(self, name: str) -> DataFrame:
        return grid.explode_cells(self.field(name), "x").withColumn("v", F.col("v").cast("int"))

    @cached_property
    def cells(self) -> DataFrame:
        """(board_id, r, c, v) of the board; of two numbers the second is ``clue``."""
        if self.kind == "double-choco":
            pairs = grid.explode_cells(self.field("cells", f"array<{GRID}>"), "x")
            return pairs.select(*PLACE, F.get("v", F.lit(0)).cast("int").alias("v"), F.get("v", F.lit(1)).cast("int").alias("clue"))
        return self.matrix("hints" if self.kind == "sudoku" else "cells")

    @cached_property
    def size(self) -> DataFrame:
        """(board_id, m, n): rows and columns."""
        if self.kind == "nonogram":
            both = self.rows.select("board_id", F.from_json("canon", f"rowClues {GRID}, colClues {GRID}").alias("d"))
            return both.select("board_id", F.size("d.rowClues").alias("m"), F.size("d.colClues").alias("n"))
        name = "hints" if self.kind == "sudoku" else "cells"
        return self.field(name, "array<array<string>>").select("board_id", F.size("x").alias("m"), F.size(F.get("x", F.lit(0))).alias("n"))

    @cached_property
    def borders(self) -> DataFrame:
        """(board_id, layer, r, c, v) of the document's grids."""
        inner = self.field("grids", f"struct<h:{GRID},v:{GRID}>")
        layers = [grid.explode_cells(inner.select("board_id", F.col(f"x.{k}").alias("g")), "g").select("board_id", F.lit(k).alias("layer"), "r", "c", F.col("v").cast("int").alias("v")) for k in "hv"]
        return layers[0].unionByName(layers[1])

    @cached_property
    def parts(self) -> DataFrame:
        """(board_id, sub_idx, r, c, gr, gc, v) of combined boards."""
        each = self.field("subboards", f"array<struct<x:double,y:double,hints:{GRID}>>").select("board_id", F.posexplode("x").alias("sub_idx", "b"))
        rows = each.select("board_id", "sub_idx", F.col("b.x").cast("int").alias("bx"), F.col("b.y").cast("int").alias("by"), F.posexplode("b.hints").alias("r", "row"))
        cells = rows.select("board_id", "sub_idx", "bx", "by", "r", F.posexplode("row").alias("c", "v"))
        return cells.select("board_id", "sub_idx", "r", "c", (F.col("r") + 3 * F.col("by")).alias("gr"), (F.col("c") + 3 * F.col("bx")).alias("gc"), F.col("v").cast("int").alias("v"))

    @cached_property
    def clues(self) -> DataFrame:
        """(board_id, axis, line, clue) of both lists of clues."""
        lists = [self.field(f"{axis}Clues").select("board_id", F.lit(axis).alias("axis"), F.posexplode("x").alias("line", "clue")) for axis in ("row", "col")]
        return lists[0].unionByName(lists[1]).withColumn("clue", F.col("clue").cast("array<int>"))

    @cached_property
    def gates(self) -> DataFrame:
        """(board_id, gate, orientation, line, lo, hi, number, gate_count)."""
        doc = self.rows.select("board_id", F.from_json("canon", "gateCount double, gates array<struct<orientation:string,line:double,`from`:double,`to`:double,number:double>>").alias("d"))
        each = doc.select("board_id", F.col("d.gateCount").cast("int").alias("gate_count"), F.posexplode("d.gates").alias("gate", "g"))
        ends = [F.col(f"g.{k}").cast("int").alias(name) for k, name in (("line", "line"), ("`from`", "lo"), ("`to`", "hi"), ("number", "number"))]
        return each.select("board_id", "gate", F.col("g.orientation").alias("orientation"), *ends, "gate_count")

    @cached_property
    def starts(self) -> DataFrame:
        return self.field("start", "struct<row:double,col:double>").select("board_id", F.col("x.row").cast("int").alias("r"), F.col("x.col").cast("int").alias("c"))

    @property
    def values(self) -> DataFrame:
        return self.rows.select("board_id", "values")

    @cached_property
    def answer(self) -> DataFrame:
        """The answer that these values give: (board_id, layer, r, c, v)."""
        hints = self.cells if self.kind in ("sudoku", "shakashaka") else None
        return answers.extract(self.size, self.values, self.kind, hints)

    @cached_property
    def combined(self) -> DataFrame:
        return answers.extract_combo(self.parts, self.values)

    @cached_property
    def states(self) -> DataFrame:
        """Values of cells as they are set, crosses included."""
        return answers.extract(self.size, self.values, "nurimaze").select(*PLACE, "v")


def filled(g: Games, states: DataFrame, wanted=None) -> DataFrame:
    """Share of wanted cells of the board that are set."""
    both = states.join(long(g.cells.select(*PLACE, F.col("v").alias("given"))), PLACE)
    return grid.progress_filled(both, F.lit(True) if wanted is None else wanted, F.col("v") != 0)


def progress_combo(g: Games) -> DataFrame:
    given = answers.value_rows(g.values).filter("layer = 'cell'").select("board_id", F.col("r").alias("gr"), F.col("c").alias("gc"), F.col("v").alias("set"))
    open_ = g.parts.groupBy("board_id", "gr", "gc").agg(F.bool_or(F.col("v") == 0).alias("open")).join(long(given), ["board_id", "gr", "gc"], "left")
    return grid.progress_filled(open_, F.col("open"), F.coalesce(F.col("set") > 0, F.lit(False)))


def audit_combo(g: Games) -> DataFrame:
    return audit.audit_combo(g.combined)


def audit_slalom(g: Games) -> DataFrame:
    counts = g.gates.groupBy("board_id").agg(F.first("gate_count").alias("gate_count"))
    return rooms.audit_slalom(g.cells, g.starts, g.gates, counts, g.answer)


def progress_masyu(g: Games, documented: bool = False) -> DataFrame:
    """0 as it is stored; ``documented``: the share of cells that the loop visits."""
    touched = grid.edge_nodes(g.answer) if documented else g.cells.select(*PLACE).limit(0)
    return grid.progress_touched(g.cells, touched)


class Rules(NamedTuple):
    """What is known of a kind of board: games of it in, (board_id, progress) and (board_id, passed) out."""

    progress: Callable[[Games], DataFrame]
    audit: Callable[[Games], DataFrame]


RULES = {
    "sudoku": Rules(lambda g: filled(g, g.answer, F.col("given") == 0), lambda g: grid.audit_sudoku(g.answer)),
    "combo-sudoku": Rules(progress_combo, audit_combo),
    "nurimaze": Rules(lambda g: filled(g, g.states), lambda g: rooms.audit_nurimaze(g.cells, g.borders, g.states)),
    "double-choco": Rules(lambda g: graph.progress_double_choco(g.cells, g.answer), lambda g: rooms.audit_double_choco(g.cells, g.answer)),
    "slitherlink": Rules(lambda g: grid.progress_touched(g.cells, grid.sides(g.answer)), lambda g: audit.audit_slitherlink(g.cells, g.answer)),
    "nonogram": Rules(lambda g: grid.progress_filled(g.states, F.lit(True), F.col("v") != 0), lambda g: grid.audit_nonogram(g.answer, g.clues)),
    "masyu": Rules(progress_masyu, lambda g: audit.audit_masyu(g.cells, g.answer)),
    "pencils": Rules(lambda g: answers.progress_pencils(g.cells, g.answer), lambda g: trails.audit_pencils(g.cells, g.answer)),
    "nuritwin": Rules(lambda g: filled(g, g.states), lambda g: rooms.audit_nuritwin(g.cells, g.borders, g.states)),
    "slalom": Rules(lambda g: answers.progress_slalom(g.gates, g.answer), audit_slalom),
    "shakashaka": Rules(lambda g: filled(g, g.answer, F.col("given") == -1), lambda g: contours.audit_shakashaka(g.cells, g.answer)),
}


def split(games: DataFrame) -> dict[str, DataFrame]:
    """Games (board_id, puzzle_type, canon, values) with ``reasons`` by kind, written once; those of no kind or with reasons are under ''."""
    judged = games.withColumn("reasons", quality.validate_dispatch(F.col("puzzle_type"), F.col("canon")))
    name = F.coalesce(*[F.when(F.col("puzzle_type") == k, F.lit(kind)) for k, kind in quality.KINDS.items()], F.lit("none"))
    path = shared_folder(games.sparkSession, "games")
    judged.withColumn("kind", F.when(F.size("reasons") == 0, name).otherwise("none")).write.partitionBy("kind").parquet(path)
    every = games.sparkSession.read.parquet(path)
    kinds = sorted(r.kind for r in every.select("kind").distinct().collect())  # at most twelve
    return {"" if kind == "none" else kind: every.filter(F.col("kind") == kind).drop("kind") for kind in kinds}


def judged_by(parts: dict[str, DataFrame], what: Callable[[Rules], Callable[[Games], DataFrame]], empty: str) -> DataFrame:
    """The rows that one rule of every kind gives, in one table.

    Kinds are independent and many of their loops are short, so their jobs are submitted side by side.
    """
    spark = next(iter(parts.values())).sparkSession
    kinds = [kind for kind in parts if kind]
    with ThreadPoolExecutor(max(1, len(kinds))) as pool:
        made = list(pool.map(lambda kind: what(RULES[kind])(Games(parts[kind], kind)), kinds))
    return reduce(DataFrame.unionByName, made, spark.createDataFrame([], empty))


def evaluate(games: DataFrame) -> DataFrame:
    """(board_id, puzzle_type, reasons, progress, passed) of every game.

    Games of a type that isn't known and those whose document isn't valid have
    their reasons, progress 0 and don't pass.
    """
    parts = split(games)
    every = reduce(DataFrame.unionByName, parts.values())
    progress = judged_by(parts, lambda rules: rules.progress, "board_id long, progress double")
    passed = judged_by(parts, lambda rules: rules.audit, "board_id long, passed boolean")
    both = every.select("board_id", "puzzle_type", F.array_join("reasons", ",").alias("reasons")).join(long(progress), "board_id", "left").join(long(passed), "board_id", "left")
    return both.withColumns({"progress": F.coalesce("progress", F.lit(0.0)), "passed": F.coalesce("passed", F.lit(False))})


def progress_summary(games: DataFrame) -> DataFrame:
    """(puzzle_type, n, drifted, mean_delta, max_delta) of games with the fraction ``stored`` for them.

    Type 6 stores crosses that its answers drop, so it is exempt from ``drifted``.
    """
    parts = split(games)
    new = judged_by(parts, lambda rules: rules.progress, "board_id long, progress double").select("board_id", (F.col("progress") / 100).alias("recomputed"))
    every = reduce(DataFrame.unionByName, parts.values()).select("board_id", "puzzle_type", "stored").join(long(new), "board_id", "left")
    delta = F.coalesce("recomputed", F.lit(0.0)) - F.col("stored")
    return every.groupBy("puzzle_type").agg(
        F.count("*").alias("n"), F.count_if((F.abs(delta) > 0.005) & (F.col("puzzle_type") != 6)).alias("drifted"), F.round(F.avg(delta), 6).alias("mean_delta"), F.round(F.max(F.abs(delta)), 6).alias("max_delta")
    )


def restore(games: DataFrame) -> DataFrame:
    """(board_id, puzzle_type, layer, r, c, v): the values that the answers of valid games give back.

    Zeros and places of hints are left out, black cells of type 11, too.  Of all kinds but 6, whose answers
    drop crosses, these are the values that were set on the board.  Combined boards give each place once.
    """
    parts, out = split(games), []
    for kind, rows in parts.items():
        if not kind:
            continue
        g = Games(rows, kind)
        if kind == "combo-sudoku":
            own = g.combined.join(long(g.parts.select("board_id", "sub_idx", "r", "c", "gr", "gc", F.col("v").alias("hint"))), ["board_id", "sub_idx", "r", "c"]).filter("v <> 0 and hint = 0")
            back = own.groupBy("board_id", F.col("gr").alias("r"), F.col("gc").alias("c")).agg(F.max("v").alias("v")).select("board_id", F.lit("cell").alias("layer"), "r", "c", "v")
        else:
            back = answers.restore_values(g.answer, g.cells if kind == "sudoku" else None)
        number = next(k for k, name in quality.KINDS.items() if name == kind)
        out.append(back.select("board_id", F.lit(number).alias("puzzle_type"), "layer", "r", "c", "v"))
    return reduce(DataFrame.unionByName, out)
