"""Whole boards in batches, and plans that don't send cells through the driver."""

import random

import numpy as np
import pyarrow as pa
import pytest

from loomgrid import plans
from loomgrid.operators import boardwise, graph, grid, joins

CELLS = ["audit_combo", "audit_double_choco", "extract_combo", "extract_sudoku", "extract_pencils", "extract_nonogram", "restore_values", "progress_combo", "progress_sudoku", "progress_pencils", "audit_nonogram", "audit_slitherlink", "classified_cells"]


@pytest.mark.parametrize("name", CELLS)
def test_cells_are_not_broadcast(spark, name):
    plan = plans.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and "BroadcastHashJoin" not in plan


def test_components_of_whole_boards_need_no_join(spark):
    plan = plans.queries()["connected_components"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") == 1


def test_boards_are_whole_however_batches_fall(monkeypatch):
    monkeypatch.setattr(boardwise, "ROWS", 7)
    ids = np.repeat(np.arange(9), [1, 20, 2, 3, 1, 9, 4, 4, 1])
    batch = pa.record_batch({"board_id": ids, "k": np.arange(len(ids))})
    seen = []

    def work(table):
        seen.append(set(table["board_id"].to_pylist()))
        return table

    got = pa.Table.from_batches(boardwise.whole((batch.slice(k, 5) for k in range(0, len(ids), 5)), work))
    assert got["k"].to_pylist() == list(range(len(ids)))
    assert sum(map(len, seen)) == 9 and len(seen) > 3


def test_smallest_place_of_random_links():
    rng = random.Random(5)
    for _ in range(50):
        n = rng.randrange(1, 60)
        links = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randrange(0, 70))]
        low = list(range(n))
        for _ in range(n):
            for a, b in links:
                low[a] = low[b] = min(low[a], low[b])
        got = boardwise.smallest(n, np.array([a for a, _ in links], int), np.array([b for _, b in links], int))
        assert got.tolist() == low


def test_search_takes_the_first_of_equal_ways(spark):
    free = spark.createDataFrame([(1, r, c) for r in range(3) for c in range(3)] + [(2, 0, 0), (2, 0, 2)], "board_id long, r int, c int")
    ends = [spark.createDataFrame([(1, *p), (2, 0, q)], "board_id long, r int, c int") for p, q in (((0, 0), 0), ((2, 2), 2))]
    assert [tuple(x) for x in graph.path_steps(free, *ends).orderBy("step").collect()] == [(1, 0, 0, 0), (1, 1, 1, 0), (1, 2, 2, 0), (1, 3, 2, 1), (1, 4, 2, 2)]
    far = {tuple(x)[:3]: x.distance for x in graph.shortest_path(free, ends[0]).collect()}
    assert far == {(1, r, c): r + c for r in range(3) for c in range(3)} | {(2, 0, 0): 0}


def test_rows_keep_what_is_looked_up(spark):
    rows = spark.createDataFrame([(1, 0, 5), (1, 0, 6), (1, 1, 7), (2, 0, 8)], "board_id long, r int, v int")
    other = spark.createDataFrame([(1, 0, None), (2, 0, 3), (3, 0, 4)], "board_id long, r int, n int").withColumnRenamed("n", "w")
    got = sorted(map(tuple, joins.looked_up(rows, other, ["board_id", "r"]).collect()), key=str)
    assert got == [(1, 0, 5, None), (1, 0, 6, None), (1, 1, 7, None), (2, 0, 8, 3)]


def test_sudoku_audit_counts_every_cell_once(spark):
    good = [(r, c, (3 * r + r // 3 + c) % 9 + 1) for r in range(9) for c in range(9)]
    boards = {1: good, 2: [*good, (0, 0, 1)], 3: [*good, (9, 0, 1)], 4: good[1:], 5: [(0, 0, 2), *good[1:]], 6: [(r, c, 0) for r, c, _ in good]}
    cells = spark.createDataFrame([(k, *x) for k, rows in boards.items() for x in rows], "board_id long, r int, c int, v int")
    audited = grid.audit_sudoku(cells)
    assert {r.board_id: r.passed for r in audited.collect()} == {k: k == 1 for k in boards}
    assert "Generate" not in audited._jdf.queryExecution().executedPlan().toString()
