"""Repair of overlapping parts against a sequential version, four parts on a diagonal and in a ring included."""

import random

from loomgrid.operators import audit

PLACES = {"diagonal": [(0, 0), (1, 1), (2, 2), (3, 3)], "ring": [(1, 0), (0, 1), (2, 2), (1, 3)], "apart": [(0, 0), (4, 4)], "backwards": [(2, 2), (0, 0), (1, 1)], "same": [(0, 0), (0, 0), (1, 2)]}


def one_by_one(places, grids):
    """Pair after pair, cell after cell, in place."""
    unlike = []
    for i, (ax, ay) in enumerate(places):
        for j in range(i + 1, len(places)):
            dx, dy = places[j][0] - ax, places[j][1] - ay
            if not (0 < dx < 3 and 0 < dy < 3):
                continue
            for r in range(9 - 3 * dy):
                for c in range(9 - 3 * dx):
                    a, b = grids[i][r + 3 * dy][c + 3 * dx], grids[j][r][c]
                    if a == 0:
                        grids[i][r + 3 * dy][c + 3 * dx] = b
                    elif b == 0:
                        grids[j][r][c] = a
                    elif a != b:
                        unlike.append((i, j, 3 * places[j][1] + r, 3 * places[j][0] + c, a, b))
    return unlike


def test_repairs_are_seen_by_later_pairs(spark):
    rng, rows, want, unlike, ambiguous = random.Random(2), [], [], [], set()
    for k, places in enumerate(list(PLACES.values()) * 4):
        grids = [[[rng.choice((0, 0, rng.randrange(1, 4))) for _ in range(9)] for _ in range(9)] for _ in places]
        at = lambda i, r, c: (k, i, r, c, 3 * places[i][1] + r, 3 * places[i][0] + c, grids[i][r][c])  # noqa: B023, E731
        every = [(i, r, c) for i in range(len(places)) for r in range(9) for c in range(9)]
        rows += [at(*x) for x in every]
        layers = {}
        for x in every:
            layers.setdefault(at(*x)[4:6], []).append(x)
        ambiguous |= {k} if any(len(v) > 2 for v in layers.values()) else set()
        unlike += [(k, *x) for x in one_by_one(places, grids)]
        want += [at(*x) for x in every]
    made, met, odd = audit.reconcile_overlaps(spark.createDataFrame(rows, "board_id long, sub_idx int, r int, c int, gr int, gc int, v int"))
    assert sorted(map(tuple, made.collect())) == sorted(want)
    assert sorted(map(tuple, met.collect())) == sorted(unlike) and unlike
    assert {r.board_id for r in odd.collect()} == ambiguous and 0 in ambiguous
