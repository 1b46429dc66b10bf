"""Graphs within boards: whole boards in Arrow batches, without a join or a round over the cluster.

A task gets its boards one after the other, so it holds some hundred thousand rows, or one board
(2^20 places at most).  What is done is done for all boards of a batch at once, in numpy.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows that are handed on together, unless one board has more.
ROWS = 100_000


def whole(batches: Iterator, work: Callable) -> Iterator:
    """Batches in order of board_id to tables of whole boards, and what ``work`` makes of these."""
    import numpy as np
    import pyarrow as pa

    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < ROWS:
            continue
        table = pa.Table.from_batches(held)
        boards = table["board_id"].to_numpy()
        cut = int(np.searchsorted(boards, boards[-1]))  # the last board may go on
        if cut:
            yield from work(table.slice(0, cut).combine_chunks()).to_batches()
        held, n = table.slice(cut).to_batches(), len(boards) - cut
    if n:
        yield from work(pa.Table.from_batches(held).combine_chunks()).to_batches()


def each(rows: DataFrame, work: Callable, schema) -> DataFrame:
    """``work`` (a table with board_id, a table of ``schema``) on the whole boards of ``rows``.

    The window only says that a board's rows belong together: it deals them out by board,
    unless they are so already, and puts them in order.
    """
    together = rows.withColumn("_rows", F.count(F.lit(1)).over(Window.partitionBy("board_id")))
    return together.mapInArrow(lambda batches: whole(batches, work), schema)


def smallest(n: int, i, j):
    """For each of n nodes the smallest one that links i - j lead to."""
    import numpy as np

    low = np.arange(n)
    while len(i):
        a, b = low[i], low[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(low, np.maximum(a, b), np.minimum(a, b))
        while (low[low] != low).any():
            low = low[low]
    return low


def index(nodes, x):
    """Where ``x`` is in the sorted ``nodes``, and whether it is there."""
    import numpy as np

    at = np.minimum(np.searchsorted(nodes, x), len(nodes) - 1)
    return at, (nodes[at] == x) if len(nodes) else np.zeros(len(x), bool)


def beside(nodes):
    """Links (i, j) of places to those to the right, and below."""
    import numpy as np

    out = []
    for step, inside in ((1, nodes & 1023 != 1023), (1024, (nodes >> 10) & 1023 != 1023)):
        j, there = index(nodes, nodes + step)
        i = np.flatnonzero(there & inside)
        out.append((i, j[i]))
    return out


def with_component(table, nodes, at, low):
    """The rows of a table of cells with the smallest place of their piece."""
    import pyarrow as pa

    return table.append_column("component", pa.array((nodes[low[at]] & ((1 << 20) - 1)).astype("int32")))


def same_value(table):
    """Cells (x, v and others) with their piece of one value; a null is like nothing."""
    import numpy as np

    nodes, at = np.unique(table["x"].to_numpy(), return_inverse=True)
    valued = ~table["v"].is_null().to_numpy()
    kinds, kind = np.unique(table["v"].fill_null(0).to_numpy(), return_inverse=True)
    has = np.unique(at[valued] * len(kinds) + kind[valued])  # more than one, if a place comes twice
    links = []
    for i, j in beside(nodes):
        to = np.full(len(nodes), -1)
        to[i] = j
        like = to[has // len(kinds)]
        met = (like >= 0) & index(has, like * len(kinds) + has % len(kinds))[1]
        links.append(((has // len(kinds))[met], like[met]))
    i, j = (np.concatenate(x) for x in zip(*links, strict=True))
    return with_component(table.drop_columns(["x", "_rows"]), nodes, at, smallest(len(nodes), i, j))


def rooms(table):
    """Cells (wall null) with their piece between walls (wall h below or v right of a place)."""
    import numpy as np
    import pyarrow.compute as pc

    cells = table.filter(table["wall"].is_null())
    nodes, at = np.unique(cells["x"].to_numpy(), return_inverse=True)
    links = []
    for wall, (i, j) in zip("vh", beside(nodes), strict=True):
        closed = np.unique(table.filter(pc.equal(table["wall"], wall))["x"].to_numpy())
        open_ = ~index(closed, nodes[i])[1]
        links.append((i[open_], j[open_]))
    i, j = (np.concatenate(x) for x in zip(*links, strict=True))
    return with_component(cells.drop_columns(["x", "wall", "_rows"]), nodes, at, smallest(len(nodes), i, j))


def linked(table):
    """(x, l): places (y null) with the smallest place that links x - y lead to."""
    import numpy as np
    import pyarrow as pa

    place = table["y"].is_null().to_numpy()
    x, y = table["x"].to_numpy(), table["y"].fill_null(0).to_numpy()
    nodes = np.unique(x[place])
    (i, has), (j, has2) = index(nodes, x[~place]), index(nodes, y[~place])
    both = has & has2
    low = smallest(len(nodes), i[both], j[both])
    return pa.table({"x": nodes, "l": nodes[low]})


def search(table):
    """Breadth-first search of every board; what ``graph.shortest_path`` says.

    Rows are places (what 0), starts (1) and goals (2).  Numbers of the places, and for each its parent's index, distance
    (-1 where it isn't reached) and whether it is a goal.
    """
    import numpy as np

    what, x = table["what"].to_numpy(), table["x"].to_numpy()
    nodes = np.unique(x)
    free = np.unique(index(nodes, x[what == 0])[0])
    links = [(free[i], free[j]) for i, j in beside(nodes[free])]
    src, dst = (np.concatenate(z) for z in zip(*links, *[(j, i) for i, j in links], strict=True))
    order = np.argsort(src, kind="stable")
    src, dst = src[order], dst[order]
    first = np.searchsorted(src, np.arange(len(nodes) + 1))
    rows = (nodes[dst] >> 10) - (nodes[src] >> 10)
    way = np.where(rows < 0, 0, np.where(rows > 0, 1, np.where(dst < src, 2, 3)))
    board = np.unique(nodes >> 20, return_inverse=True)[1]
    goal = np.zeros(len(nodes), bool)
    goal[index(nodes, x[what == 2])[0]] = True
    parent, far, rank = np.full(len(nodes), -1), np.full(len(nodes), -1), np.zeros(len(nodes), "int64")
    front, done, level = np.unique(index(nodes, x[what == 1])[0]), np.zeros(len(nodes), bool), 0
    far[front] = 0
    while len(front):
        done[board[front[goal[front]]]] = True
        front = front[~done[board[front]]]
        n = first[front + 1] - first[front]
        edge = np.repeat(first[front] - np.cumsum(n) + n, n) + np.arange(n.sum())
        edge = edge[far[dst[edge]] < 0]
        key = rank[src[edge]] * 4 + way[edge]
        order = np.lexsort((key, dst[edge]))
        edge, key = edge[order], key[order]
        one = np.flatnonzero(np.diff(dst[edge], prepend=-1))
        edge, key, level = edge[one], key[one], level + 1
        edge = edge[np.lexsort((key, board[dst[edge]]))]
        front = dst[edge]
        parent[front], far[front] = src[edge], level
        rank[front] = np.arange(len(front)) - np.searchsorted(board[front], board[front]) + 1
    return nodes, parent, far, goal


def distances(table):
    """(x, parent, distance) of the places that are reached."""
    import pyarrow as pa

    nodes, parent, far, _ = search(table)
    on = far >= 0
    return pa.table({"x": nodes[on], "parent": pa.array(nodes[parent[on]], mask=parent[on] < 0), "distance": far[on].astype("int32")})


def way_back(table):
    """(x, distance) of the places between each goal that is reached and its start."""
    import numpy as np
    import pyarrow as pa

    nodes, parent, far, goal = search(table)
    on, at = np.zeros(len(nodes), bool), np.flatnonzero(goal & (far >= 0))
    while len(at):
        on[at] = True
        at = parent[at]
        at = at[at >= 0]
        at = at[~on[at]]
    return pa.table({"x": nodes[on], "distance": far[on].astype("int32")})


def around(table):
    """(x, position) along the loop through each start (y null), by way of the smaller neighbour; links x - y.

    All loops are walked at once, so there are as many steps as the longest has places.
    """
    import numpy as np
    import pyarrow as pa

    begin = table["y"].is_null().to_numpy()
    x, y = table["x"].to_numpy(), table["y"].fill_null(0).to_numpy()
    nodes = np.unique(np.concatenate([x, y[~begin]]))
    i, j = index(nodes, x[~begin])[0], index(nodes, y[~begin])[0]
    pair = np.unique(np.concatenate([i * len(nodes) + j, j * len(nodes) + i]))
    src, dst = pair // len(nodes), pair % len(nodes)
    first = np.searchsorted(src, np.arange(len(nodes) + 1))
    two = np.flatnonzero(np.diff(first) == 2)
    near = np.full((len(nodes), 2), -1)
    near[two] = np.stack([dst[first[two]], dst[first[two] + 1]], axis=1)
    start = np.unique(index(nodes, x[begin])[0])
    start = start[near[start, 0] >= 0]
    before, at, loop, step = start, near[start, 0], np.arange(len(start)), 1
    walked, closed = [(loop, start, np.zeros(len(start), "int32"))], np.zeros(len(start), bool)
    while len(at):
        back = at == start[loop]
        closed[loop[back]] = True
        go = ~back & (near[at, 0] >= 0)
        before, at, loop = before[go], at[go], loop[go]
        walked.append((loop, at, np.full(len(at), step, "int32")))
        before, at = at, np.where(near[at, 0] == before, near[at, 1], near[at, 0])
        step += 1
    loop, at, position = (np.concatenate(z) for z in zip(*walked, strict=True))
    return pa.table({"x": nodes[at[closed[loop]]], "position": position[closed[loop]]})


def pieces(table):
    """(board_id, n): how many pieces links x - y of a board make."""
    import numpy as np
    import pyarrow as pa

    x, y = table["x"].to_numpy(), table["y"].to_numpy()
    nodes = np.unique(np.concatenate([x, y]))
    roots = np.unique(smallest(len(nodes), index(nodes, x)[0], index(nodes, y)[0]))
    board, n = np.unique(nodes[roots] >> 20, return_counts=True)
    return pa.table({"board_id": board, "n": n})


#: By half-filled kind, named by its right angle (1 top left, 2 top right, 3 bottom left, 4 bottom right): the step along which a contour turns, the kind that it turns to, the step along which it goes on.
STEPS = {1: ((0, 1), 2, (-1, 1)), 2: ((1, 0), 4, (1, 1)), 4: ((0, -1), 3, (1, -1)), 3: ((-1, 0), 1, (-1, -1))}
#: Turns of a contour that closes around one rectangle.
CORNERS = 4


def contours(table):
    """(x, first): places (x, k) on contours that close with four turns, and the smallest place of each.

    k = 0 for white and 1 to 4 for half-filled places.  Clockwise, a contour turns where the next kind stands beside
    it, and goes on diagonally past a white place.  No place follows two others, so contours are paths or rings.
    Pointers to the next place double; those of an open contour run into its end.
    """
    import numpy as np
    import pyarrow as pa

    nodes, at = np.unique(table["x"].to_numpy(), return_index=True)
    kind = table["k"].to_numpy()[at]
    end = len(nodes)
    after, turn = np.full(end + 1, end), np.zeros(end + 1, bool)
    for k, (side, wanted, on) in STEPS.items():
        half = np.flatnonzero(kind == k)
        met = []
        for dr, dc in (side, on):
            r, c = (nodes[half] >> 10 & 1023) + dr, (nodes[half] & 1023) + dc
            j, there = index(nodes, (nodes[half] >> 20 << 20) + r * 1024 + c)
            met.append((j, there & (r >= 0) & (r < 1024) & (c >= 0) & (c < 1024)))
        (j, there), (ahead, there2) = met
        turns = there & (kind[j] == wanted)
        goes = there & (kind[j] == 0) & there2 & (kind[ahead] == k)
        after[half], turn[half] = np.where(turns, j, np.where(goes, ahead, end)), turns
    first = np.arange(end + 1)
    for _ in range(int(end).bit_length()):
        first, after = np.minimum(first, first[after]), after[after]
    ring = np.flatnonzero(after[:end] < end)
    whole_ = np.bincount(first[ring], weights=turn[ring], minlength=end + 1)[first[ring]] == CORNERS
    return pa.table({"x": nodes[ring[whole_]], "first": nodes[first[ring[whole_]]]})
