"""Operators that the registered queries don't reach: files, seeding, edge cases of documents."""

import pytest
from pyspark.sql import functions as F

from loomgrid.functions import scalars
from loomgrid.operators import audit, catalog, grid, ingest, quality
from loomgrid.sources import tables


def reasons(spark, kind, text):
    return spark.createDataFrame([(text,)], "t string").select(quality.validate(kind, F.col("t")).alias("r")).first().r


NINE = "[" + ",".join(["[" + ",".join(["0"] * 9) + "]"] * 9) + "]"


@pytest.mark.parametrize(
    "kind, text, want",
    [
        ("sudoku", '{"hints":%s}' % NINE, []),
        ("sudoku", '{"hints":%s}' % NINE.replace("0]", "10]", 1), ["range:hints"]),
        ("sudoku", '{"hints":[[1,2]]}', ["shape:hints"]),
        ("sudoku", '{"hints":null}', ["type:hints"]),
        ("sudoku", "[]", ["type:document"]),
        ("sudoku", None, ["type:document"]),
        ("nurimaze", '{"cells":[[0,4],[1,2]],"grids":{"h":[[0,1]],"v":[[0],[1]]}}', []),
        ("nurimaze", '{"cells":[[0,5],[1,2]],"grids":{"h":[[0,2]],"v":[[0],[1]]}}', ["range:cells", "range:h"]),
        ("nurimaze", '{"cells":[[0]],"grids":{"h":[],"v":[[]],"x":1}}', ["extra:grids"]),
        ("combo-sudoku", '{"subboards":[{"x":0,"y":1,"hints":%s}],"room_width":3}' % NINE, []),
        ("combo-sudoku", '{"subboards":[]}', ["shape:subboards"]),
        ("combo-sudoku", '{"subboards":[{"x":-1,"y":1,"hints":%s,"z":1}]}' % NINE, ["keys:subboards", "range:place"]),
        ("double-choco", '{"cells":[[[0,1],[1,0]]]}', []),
        ("double-choco", '{"cells":[[[0,1,2]]]}', ["range:cells"]),
        ("slitherlink", '{"cells":[[-1,3.0],[0,1]]}', []),
        ("slitherlink", '{"cells":[["NaN"]]}', ["type:cells"]),
        ("slitherlink", '{"cells":[[null]]}', ["type:cells"]),
        ("slalom", '{"cells":[[0,1]],"start":{"row":0,"col":0},"gateCount":1,"gates":[{"orientation":"h","line":0,"from":0,"to":1,"number":null}]}', []),
        ("slalom", '{"cells":[[0,1]],"start":{"row":0},"gateCount":0,"gates":[{"orientation":"x","line":0,"from":0,"to":1,"number":0}]}', ["missing:start.col", "range:start", "range:gateCount", "range:gates"]),
    ],
)
def test_documents(spark, kind, text, want):
    assert reasons(spark, kind, text) == want


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"cells":[[0]]}')
    assert [r.canon for r in tables.read_boards(spark, str(tmp_path / "*.json")).collect()] == ['{"cells":[[0]]}']
    assert tables.list_files(spark, str(tmp_path)).count() == 1
    types = spark.createDataFrame([(1, "Sudoku", "r")], "id int, name string, rule string")
    ingest.seed(spark, types, str(tmp_path))
    ingest.seed(spark, types, str(tmp_path))
    assert spark.read.parquet(f"{tmp_path}/puzzle_types").count() == 1
    assert "password" not in spark.read.parquet(f"{tmp_path}/player_account").columns


def test_limits_and_defaults(spark):
    rows = [(k, 1, None if k % 2 else 5, k) for k in range(6)]
    df = spark.createDataFrame(rows, "id int, puzzle_type int, src_collection int, created_at int")
    assert [r.id for r in catalog.list_puzzles(df, limit=2).collect()] == [5, 4]
    assert catalog.list_puzzles(df, limit=0).count() == 6 and catalog.list_puzzles(df, src_collection="none").count() == 3
    assert catalog.attempts_open_or_done(spark.createDataFrame([(1, None), (2, 3)], "id int, finished_at int")).count() == 1


def test_scalars(spark):
    row = spark.range(1).select(
        scalars.format_elapsed(F.lit(360_061)).alias("e"), scalars.difficulty_label(F.lit(9)).alias("d"), scalars.parse_clue_text(F.lit(" ")).alias("c"), scalars.parse_value_key(F.lit("th:2,3")).alias("k"), scalars.strip_fences(F.lit("```json\n[1]\n```")).alias("f")
    ).first()
    assert (row.e, row.d, row.c, tuple(row.k), row.f) == ("100:01:01", "9", [0], ("th", 2, 3), "[1]")


def test_shapes_and_loops(spark):
    mirrored = [[(0, 0), (1, 0), (1, 1), (2, 1)], [(5, 6), (6, 6), (6, 5), (7, 5)], [(0, 0), (0, 1), (0, 2), (0, 3)]]
    df = spark.createDataFrame([(k, m) for k, m in enumerate(mirrored)], "id int, p array<struct<r:int,c:int>>")
    keys = [r.k for r in df.orderBy("id").select(grid.shape_key(F.col("p")).alias("k")).collect()]
    assert keys[0] == keys[1] != keys[2]
    square = [(1, "h", 0, 0, 1), (1, "h", 1, 0, 1), (1, "v", 0, 0, 1), (1, "v", 0, 1, 1)]
    edges = spark.createDataFrame(square + [(2, *e[1:]) for e in square[:3]] + [(3, "h", 0, 0, 0)], "board_id long, layer string, r int, c int, v int")
    clues = spark.createDataFrame([(b, 0, 0, 4) for b in (1, 2, 3)], "board_id long, r int, c int, v int")
    assert {r.board_id: r.passed for r in audit.audit_slitherlink(clues, edges).collect()} == {1: True, 2: False, 3: False}
