"""Boards generated from the part table, one per part, in long and document form.

Values follow integer formulas of the part's key, so that SQL can state the
same boards; some keys get an invalid variant.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.sources.analog import Tables


#: Boards of a partition: one grows to some hundred rows.
BOARDS = 10_000


def boards(t: Tables) -> DataFrame:
    """(board_id, size), dealt out by board, so that what is grouped by board is where it has to be."""
    part = t.read("part")
    n = max(t.spark.sparkContext.defaultParallelism, -(-part.count() // BOARDS))
    return part.select(F.col("p_partkey").alias("board_id"), F.col("p_size").alias("size")).repartition(n, "board_id")


def cells(t: Tables, rows: Column | int, columns: Column | int, value: str) -> DataFrame:
    """(board_id, r, c, v) with ``value`` an expression of board_id, r and c."""
    rows, columns = (x if isinstance(x, Column) else F.lit(x) for x in (rows, columns))
    grown = boards(t).select("board_id", F.explode(F.sequence(F.lit(0), (rows - 1).cast("int"))).alias("r"), columns.alias("n"))
    return grown.select("board_id", "r", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("c")).withColumn("v", F.expr(value).cast("int"))


#: Expressions that Spark and DuckDB read alike.
DIGIT = "(3 * r + cast(floor(r / 3.0) as int) + c + board_id) % 9 + 1"
SOLUTION = f"case when board_id % 4 = 0 and r = 0 and c = 0 then (1 + board_id) % 9 + 1 else {DIGIT} end"
HINT = f"case when (5 * r + 3 * c + board_id) % 3 = 0 then {DIGIT} else 0 end"
VALUE = f"case when (5 * r + 3 * c + board_id) % 3 <> 0 and (7 * r + 11 * c + board_id) % 5 <> 0 then {DIGIT} else 0 end"
FILL = "case when (board_id + 3 * r * r + 5 * c + r * c) % 3 = 0 then 1 else 0 end"
#: The player's nonogram: one cell flipped for some boards.
ANSWER = f"case when board_id % 4 = 1 and r = 0 and c = 0 then 1 - ({FILL}) else {FILL} end"
STATE = "(r * 7 + c * 5 + board_id) % 3"
DASHED = "case when c % 4 = 2 and (r + board_id) % 3 <> 0 then 1 else 0 end"


def sudoku(t: Tables, value: str = SOLUTION) -> DataFrame:
    return cells(t, 9, 9, value)


def nonogram(t: Tables, value: str = ANSWER) -> DataFrame:
    return cells(t, F.expr("5 + board_id % 6"), F.expr("5 + board_id % 5"), value)


def states(t: Tables, value: str = STATE) -> DataFrame:
    return cells(t, F.expr("4 + board_id % 5"), F.expr("3 + board_id % 7"), value)


def ring(t: Tables) -> DataFrame:
    """(board_id, layer, r, c, v): edges of a ring on the border of an m x n grid of nodes.

    m = 4 + board_id % 4, n = 4 + board_id % 5; one edge missing where board_id % 3 = 0.
    """
    m, n = F.expr("4 + board_id % 4"), F.expr("4 + board_id % 5")
    grid = cells(t, m, n, "0").drop("v").withColumns({"m": m, "n": n})
    h = grid.filter("c < n - 1").select("board_id", F.lit("h").alias("layer"), "r", "c", F.expr("case when (r = 0 or r = m - 1) and not (board_id % 3 = 0 and r = 0 and c = 0) then 1 else 0 end").alias("v"))
    v = grid.filter("r < m - 1").select("board_id", F.lit("v").alias("layer"), "r", "c", F.expr("case when c = 0 or c = n - 1 then 1 else 0 end").alias("v"))
    return h.unionByName(v)


def documents(t: Tables, kind: str) -> DataFrame:
    """(board_id, canon): documents with a value taken from the part's size and seven variants.

    board_id % 7 = 2: the last field is missing; 3: an extra field; 4: a text for a
    number; 5: a fraction; 6: the value written with a decimal point.
    """
    v = F.expr(VALUE_OF)
    token = F.expr(f"case board_id % 7 when 4 then '\"a\"' when 5 then '1.5' when 6 then concat({VALUE_OF}, '.0') else cast({VALUE_OF} as string) end")
    nine = "[" + ",".join(["0"] * 8) + ",@]"
    grid = {"sudoku": "[" + ",".join([nine] * 9) + "]"}.get(kind, "[[0,@],[0,1]]")
    border = '"grids":{"h":[[0,1]],"v":[[0],[1]]}'
    body = {
        "sudoku": f'"hints":{grid}',
        "combo-sudoku": '"subboards":[{"x":0,"y":0,"hints":%s}]' % ("[" + ",".join([nine] * 9) + "]"),
        "nurimaze": f'{border},"cells":{grid}',
        "nuritwin": f'{border},"cells":{grid}',
        "double-choco": '"cells":[[[0,@],[1,0]]]',
        "nonogram": '"rowClues":[[1],[0]],"colClues":[[@],[0]]',
        "slalom": '"start":{"row":0,"col":0},"gateCount":1,"gates":[{"orientation":"h","line":0,"from":0,"to":1,"number":null}],"cells":[[0,@],[0,1]]',
    }.get(kind, f'"cells":{grid}')
    cut = body[: body.rindex(',"', 0, body.rindex('":[[') if kind != "combo-sudoku" else len(body))] if kind in ("nurimaze", "nuritwin", "nonogram", "slalom") else ""
    text = F.when(F.col("board_id") % 7 == 2, F.lit("{" + cut + "}")).when(F.col("board_id") % 7 == 3, F.concat(F.lit("{"), F.replace(F.lit(body), F.lit("@"), token), F.lit(',"z":1}')))
    return boards(t).select("board_id", v.alias("value"), text.otherwise(F.concat(F.lit("{"), F.replace(F.lit(body), F.lit("@"), token), F.lit("}"))).alias("canon"))


#: The value that a document carries.
VALUE_OF = "cast((board_id * 13) % 17 - 5 as int)"
