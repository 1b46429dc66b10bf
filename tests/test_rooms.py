"""Golden boards: for every rule of the room and gate audits one board that passes and one that fails."""

import pytest

from loomgrid.operators import lines, rooms

CELL, EDGE = "board_id long, r int, c int, v int", "board_id long, layer string, r int, c int, v int"


def rows(board, text, **numbers):
    return [(board, r, c, numbers.get(x, int(x) if x.isdigit() else 0)) for r, line in enumerate(text.split()) for c, x in enumerate(line)]


def borders(board, text):
    """Borders between unlike letters of a map of rooms."""
    lines = text.split()
    h = [(board, "h", r, c, int(lines[r][c] != lines[r + 1][c])) for r in range(len(lines) - 1) for c in range(len(lines[0]))]
    return h + [(board, "v", r, c, int(lines[r][c] != lines[r][c + 1])) for r in range(len(lines)) for c in range(len(lines[0]) - 1)]


def verdicts(df):
    return {r.board_id: r.passed for r in df.collect()}


def test_double_choco_rules(spark):
    boards = {
        1: ("011 001", "aaa aaa", 3, {}, True),  # a mirror image
        2: ("0011 0011", "aabb aabb", 0, {}, False),  # rooms of one colour
        3: ("0110", "aabb", 1, {}, True),
        4: ("0110", "aabb", 2, {}, False),  # clue
        5: ("0101", "aaaa", 0, {}, False),  # torn colours
        6: ("00011 00111", "aaaaa aaaaa", 0, {}, True),
        7: ("1000 1101", "aaaa aabb", 0, {}, False),  # straight against corner
        8: ("0001 0111", "aaaa aaaa", 0, {("v", 1, 1): 1}, False),  # a border inside a room
        9: ("01", "aa", 0, {}, False),  # no border at all
        10: ("01 01", "aa bb", 1, {}, True),
    }
    cells, edges = [], []
    for k, (colours, room, clue, more, _) in boards.items():
        cells += [(*x, clue if x[1:3] == (0, 0) else 0) for x in rows(k, colours)]
        edges += [(*x[:4], more.get(x[1:4], x[4])) for x in borders(k, room)]
        if k in (1, 6, 8):  # a second room, so that there is a border
            width, depth = len(colours.split()[0]), len(colours.split())
            cells += [(k, depth, c, c % 2, 0) for c in range(2)] + [(k, depth, c, c % 2, 0) for c in range(2, width - width % 2)]
            edges += [(k, "h", depth - 1, c, 1) for c in range(width)] + [(k, "v", depth, 1, 1)]
    got = verdicts(rooms.audit_double_choco(spark.createDataFrame(cells, CELL + ", clue int"), spark.createDataFrame(edges, EDGE)))
    assert got == {k: x[-1] for k, x in boards.items()}


NT = "11101 00101 11101 10111 11000".replace("0", "2")


@pytest.mark.parametrize(
    "name, states, clue, want",
    [
        ("solved", NT, 2, True),
        ("clue mismatch", NT, 3, False),
        ("unequal pair", NT[:-4] + "2222", 2, False),
        ("unset", NT.replace("22121", "02121"), 2, False),
        ("three pieces", NT[:24] + "11221", 2, False),
        ("nothing black", NT.replace("1", "2"), 2, False),
    ],
)
def test_nuritwin_rules(spark, name, states, clue, want):
    cells = [(1, r, c, clue if (r, c) == (0, 0) else 0) for r in range(5) for c in range(5)]
    df = rooms.audit_nuritwin(spark.createDataFrame(cells, CELL), spark.createDataFrame(borders(1, "aabbb aabbb aabbb ccccc ccccc"), EDGE), spark.createDataFrame(rows(1, states), CELL))
    assert verdicts(df) == {1: want}, name


def test_nurimaze_rules(spark):
    open_ = "22222 21212 21212 21212 21212"
    boards = {
        1: ("30010 00000 00000 00200 00004", open_, True),
        2: ("30010 00000 00000 00200 00004", open_.replace("21212", "01212", 1), False),  # an unset room
        3: ("30010 00000 00000 00200 00004", "22222 22212 21212 21212 21212", False),  # an open block
        4: ("30010 00000 00000 00200 00004", "22222 21112 21112 21212 21212", False),  # a black block
        5: ("30010 00000 00000 00200 00004", "22222 21212 21212 21112 21212", False),  # a split region
        6: ("30010 00000 00000 00100 00004", open_, False),  # a circle off the way
        7: ("30010 00002 00000 00000 00004", open_, False),  # a triangle on it
        8: ("30010 00000 00000 00000 00000", open_, False),  # no goal
        # Around a black cell two ways are as short: down goes before right, so that the circle has to be on the left.
        9: ("300 000 104", "222 212 222", True),
        10: ("301 000 004", "222 212 222", False),
        11: ("300 000 004", "122 212 222", True),  # the search leaves S though its room is black
        12: ("300 000 004", "222 212 221", False),  # the goal is black
    }
    cells, edges, states = [], [], []
    for k, (kind, state, _) in boards.items():
        cells += rows(k, kind)
        states += rows(k, state)
        edges += [(k, x, r, c, 1) for x in "hv" for r in range(5) for c in range(5)]
    got = verdicts(rooms.audit_nurimaze(spark.createDataFrame(cells, CELL), spark.createDataFrame(edges, EDGE), spark.createDataFrame(states, CELL)))
    assert got == {k: x[-1] for k, x in boards.items()}


def test_slalom_rules(spark):
    ring = [("h", 0, 0, 1), ("h", 0, 1, 1), ("h", 2, 0, 1), ("h", 2, 1, 1), ("v", 0, 0, 1), ("v", 1, 0, 1), ("v", 0, 2, 1), ("v", 1, 2, 1)]
    inner = [("v", 0, 0, 1), ("v", 1, 0, 1)]
    boards = {
        1: ("000 000 000", (0, 0), ring, (1, 2), 2, True),
        2: ("000 000 000", (0, 0), ring, (2, 1), 2, True),  # the reverse order
        3: ("000 000 000", (0, 0), ring, (2, None), 2, True),  # gate 1 is second, if it is taken backwards
        4: ("000 000 000", (0, 0), ring, (3, None), 2, False),
        5: ("010 000 000", (0, 0), ring, (1, 2), 2, False),  # through a wall
        6: ("000 000 000", (1, 1), ring, (1, 2), 2, False),  # start off the loop
        7: ("000 000 000", (0, 0), ring[1:], (1, 2), 2, False),  # no loop
        8: ("000 000 000", (0, 0), ring, (1, 2), 3, False),  # a gate that isn't crossed
        9: ("000 000 000", (0, 0), inner, (None, None), 2, False),
    }
    cells, starts, gates, counts, edges = [], [], [], [], []
    for k, (wall, start, drawn, numbers, count, _) in boards.items():
        cells += rows(k, wall)
        starts.append((k, *start))
        gates += [(k, 0, "v", 1, 0, 0, numbers[0]), (k, 1, "h", 1, 0, 0, numbers[1])]
        counts.append((k, count))
        edges += [(k, *x) for x in drawn]
    df = rooms.audit_slalom(
        spark.createDataFrame(cells, CELL), spark.createDataFrame(starts, "board_id long, r int, c int"), spark.createDataFrame(gates, "board_id long, gate int, orientation string, line int, lo int, hi int, number int"),
        spark.createDataFrame(counts, "board_id long, gate_count int"), spark.createDataFrame(edges, EDGE),
    )
    assert verdicts(df) == {k: x[-1] for k, x in boards.items()}


def test_every_kind_has_rules():
    from loomgrid.operators import quality, registry

    assert set(registry.RULES) == set(quality.KINDS.values())
    assert all(r.progress and r.audit for r in registry.RULES.values())


@pytest.mark.parametrize(
    "cells, clue, want",
    [
        ([1, 2, 1, 1], [1, 2], ("satisfied", 2, 0)),
        ([2, 2, 2], [0], ("satisfied", 1, 0)),
        ([2, 1, 2], [0], ("error", 0, 0)),
        ([1, 1, 2, 0, 0], [1, 1], ("error", 0, 0)),  # larger than any clue
        ([1, 2, 1, 2, 1, 2], [1, 1], ("error", 0, 0)),  # more sealed runs than clues
        ([1, 2, 0, 0, 0], [1, 2], ("normal", 1, 0)),
        ([0, 0, 0, 2, 1], [2, 1], ("normal", 0, 1)),
        ([0, 0, 2, 1, 2], [2, 1], ("normal", 0, 1)),
        ([2, 1, 2, 0, 0, 0], [2, 1], ("error", 0, 0)),  # not the first clue
        ([0, 1, 0, 0, 0], [2], ("normal", 0, 0)),
        ([1, 2, 0, 2, 1, 2, 1], [1, 1, 1], ("satisfied", 3, 0)),
        ([1, 2, 0, 1, 2, 0, 1], [1, 1, 1], ("satisfied", 3, 0)),
        ([0, 2, 1, 2, 0, 2, 1, 2, 0], [1], ("error", 0, 0)),
    ],
)
def test_line_status(spark, cells, clue, want):
    df = spark.createDataFrame([(cells, clue)], "cells array<int>, clue array<int>")
    row = lines.nonogram_line_status(df).first()
    assert (row.status, row.done_front, row.done_back) == want


def ring(board, m, n, r=0, c=0):
    """Edges of a rectangle of m x n places."""
    h = [(board, "h", r + x, c + k, 1) for x in (0, m - 1) for k in range(n - 1)]
    return h + [(board, "v", r + k, c + x, 1) for x in (0, n - 1) for k in range(m - 1)]


def test_masyu_rules(spark):
    from loomgrid.operators import audit

    boards = {
        1: (ring(1, 4, 5), [(0, 1, 1), (0, 0, 2)], True),
        2: (ring(2, 4, 5), [(0, 2, 1)], False),  # white without a turn beside it
        3: (ring(3, 4, 5), [(0, 0, 1)], False),  # white on a turn
        4: (ring(4, 4, 5), [(0, 1, 2)], False),  # black on a straight
        5: (ring(5, 2, 5), [(0, 0, 2)], False),  # black with a turning neighbour
        6: (ring(6, 4, 5), [(1, 1, 1)], False),  # off the loop
        7: (ring(7, 4, 5) + ring(7, 2, 2, 6, 6), [(0, 1, 1)], False),  # two loops
        8: (ring(8, 4, 5)[1:], [(3, 1, 1)], False),  # open
    }
    circles = [(k, *x) for k, (_, on, _) in boards.items() for x in on]
    edges = [e for drawn, _, _ in boards.values() for e in drawn]
    got = verdicts(audit.audit_masyu(spark.createDataFrame(circles, CELL), spark.createDataFrame(edges, EDGE)))
    assert got == {k: x[-1] for k, x in boards.items()}


def test_slitherlink_rules(spark):
    from loomgrid.operators import audit

    boards = {
        1: (ring(1, 2, 3), [(0, 0, 3), (0, 1, -1)], True),
        2: (ring(2, 2, 3), [(0, 0, 2), (0, 1, 3)], False),  # a wrong clue alone
        3: (ring(3, 2, 3), [(0, 0, 3), (1, 0, 0)], False),  # no side drawn of a cell that has one
        4: (ring(4, 2, 2) + ring(4, 2, 2, 3, 3), [(0, 0, -1)], False),
        5: (ring(5, 2, 2)[1:], [(0, 0, 3)], False),
    }
    clues = [(k, *x) for k, (_, on, _) in boards.items() for x in on]
    edges = [e for drawn, _, _ in boards.values() for e in drawn]
    got = verdicts(audit.audit_slitherlink(spark.createDataFrame(clues, CELL), spark.createDataFrame(edges, EDGE)))
    assert got == {k: x[-1] for k, x in boards.items()}
