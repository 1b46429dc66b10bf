"""Golden boards of half-filled cells and of pencils: for every rule one that passes and one that fails."""

from loomgrid.operators import contours, trails

CELL, EDGE = "board_id long, r int, c int, v int", "board_id long, layer string, r int, c int, v int"
VALUE = {"#": (5, 0), ".": (-1, 0), "x": (-1, 5), "1": (-1, 1), "2": (-1, 2), "3": (-1, 3), "4": (-1, 4), "a": (0, 0), "b": (1, 0), "c": (2, 0), "d": (3, 0), "e": (4, 0)}

SHAKASHAKA = {
    1: ("12 34", True),
    2: ("12# 34b ###", True),  # no clue beside the 2 but b, right of a 4
    3: ("12# 34c ###", False),  # clue mismatch
    4: ("... #.#", False),  # a white piece that is no rectangle
    5: ("..# ..#", True),
    6: ("#12# 1xx2 3..4 #34#", True),  # a diamond around white
    7: ("#12# 1..2 3..3 #34#", False),  # a broken contour
    8: ("#12# 1#.2 3..4 #34#", False),  # the contour leans on a black place
    9: (".12. 1..2 3..4 .34.", True),  # lone white corners
    10: ("12. 34. ...", True),  # a bent white piece that touches a contour that begins before it: followed as the game does
    11: ("... .12 .34", False),  # the same that begins before the contour
    12: ("2# ##", False),  # a half-filled place alone
    13: ("1# ##", False),
    14: ("#12## 1..2# 3...2 #3..4 ##34#", True),  # longer than wide
    15: ("1234 ####", False),
    16: ("###", True),
    17: ("a.. ...", False),
}


def verdicts(df):
    return {r.board_id: r.passed for r in df.collect()}


def test_shakashaka_rules(spark):
    cells, states = [], []
    for k, (text, _) in SHAKASHAKA.items():
        for r, line in enumerate(text.split()):
            for c, x in enumerate(line):
                cells.append((k, r, c, VALUE[x][0]))
                states.append((k, r, c, VALUE[x][1]))
    got = verdicts(contours.audit_shakashaka(spark.createDataFrame(cells, CELL), spark.createDataFrame([s for s in states if s[3]], CELL)))
    assert got == {k: want for k, (_, want) in SHAKASHAKA.items()}


def game_shakashaka(cells, states):
    """The rules place by place, in reading order, as a player's board is judged."""
    rows, cols = len(cells), len(cells[0])
    inside = lambda r, c: 0 <= r < rows and 0 <= c < cols and cells[r][c] == -1
    white = lambda r, c: inside(r, c) and states[r][c] in (0, 5)
    around = ((-1, 0), (1, 0), (0, -1), (0, 1))
    for r in range(rows):
        for c in range(cols):
            if 0 <= cells[r][c] <= 4 and cells[r][c] != sum(0 <= r + a < rows and 0 <= c + b < cols and 1 <= states[r + a][c + b] <= 4 for a, b in around):
                return False
    seen = set()

    def flood(start):
        piece, stack = {start}, [start]
        while stack:
            r, c = stack.pop()
            for a, b in around:
                p = (r + a, c + b)
                if white(*p) and p not in seen and p not in piece:
                    piece.add(p)
                    stack.append(p)
        seen.update(piece)
        return piece

    for r in range(rows):
        for c in range(cols):
            if (r, c) in seen or cells[r][c] != -1:
                continue
            if white(r, c):
                piece = flood((r, c))
                if len(piece) != (max(p[0] for p in piece) - min(p[0] for p in piece) + 1) * (max(p[1] for p in piece) - min(p[1] for p in piece) + 1):
                    return False
                continue
            if states[r][c] != 1:
                return False
            at, way, turns = (r, c), [(r, c)], 0
            while True:
                k = states[at[0]][at[1]]
                side, after, on = contours.STEPS[k]
                s, t = (at[0] + side[0], at[1] + side[1]), (at[0] + on[0], at[1] + on[1])
                if inside(*s) and states[s[0]][s[1]] == after and turns < 4:
                    at, turns = s, turns + 1
                elif white(*s) and inside(*t) and states[t[0]][t[1]] == k:
                    at = t
                else:
                    return False
                if at == (r, c):
                    break
                way.append(at)
            if turns != 4:
                return False
            seen.update(way)
            for x, y in way:
                for a, b in around:
                    if white(x + a, y + b) and (x + a, y + b) not in seen:
                        flood((x + a, y + b))
    return True


def test_shakashaka_as_the_game_judges(spark):
    """Diamonds at random places with random changes: the set-based verdict is that of a walk in reading order."""
    import random

    rng, boards = random.Random(3), {}
    for k in range(300):
        m, n = rng.randrange(4, 8), rng.randrange(4, 9)
        cells, states = [[rng.choice((5, 5, 5, -1)) for _ in range(n)] for _ in range(m)], [[0] * n for _ in range(m)]
        for _ in range(rng.randrange(1, 4)):
            text = rng.choice(["12 34", "#12# 1xx2 3..4 #34#", ".12. 1..2 3..4 .34.", "..", ". ."]).split()
            if len(text) > m or len(text[0]) > n:
                continue
            r0, c0 = rng.randrange(m - len(text) + 1), rng.randrange(n - len(text[0]) + 1)
            for r, line in enumerate(text):
                for c, x in enumerate(line):
                    cells[r0 + r][c0 + c], states[r0 + r][c0 + c] = VALUE[x]
        if rng.random() < 0.3:
            states[rng.randrange(m)][rng.randrange(n)] = rng.randrange(6)
        states = [[s if v == -1 else 0 for s, v in zip(x, y, strict=True)] for x, y in zip(states, cells, strict=True)]
        boards[k] = (cells, states)
    flat = lambda which: [(k, r, c, v) for k, b in boards.items() for r, line in enumerate(b[which]) for c, v in enumerate(line)]
    got = verdicts(contours.audit_shakashaka(spark.createDataFrame(flat(0), CELL), spark.createDataFrame(flat(1), CELL)))
    want = {k: game_shakashaka(*b) for k, b in boards.items()}
    assert got == want
    assert 20 < sum(want.values()) < 280


def layers(k, cells, trails_, heads=(), edges=()):
    """Trails as pairs of neighbours, heads as (r, c, d), edges as (layer, r, c)."""
    out = [(k, "hd", r, c, d) for r, c, d in heads] + [(k, "e" + x, r, c, 1) for x, r, c in edges]
    for (r, c), (nr, nc) in trails_:
        out.append((k, "th" if r == nr else "tv", min(r, nr), min(c, nc), 1))
    return out


def path(*places):
    return list(zip(places, places[1:], strict=False))


#: Boards as rows of numbers, trails, heads, edges, verdict.
PENCILS = {
    1: ([[0, -4, 0]], path((0, 1), (0, 2)), (), (), True),
    2: ([[2, 0, -4, 0, 0]], path((0, 2), (0, 3), (0, 4)), (), (), True),
    3: ([[1, 0, -4, 0, 0]], path((0, 2), (0, 3), (0, 4)), (), (), False),  # clue
    4: ([[0, 0, -4, 0]], path((0, 2), (0, 3)), (), (), False),  # a trail too short
    5: ([[0, 0, 0]], path((0, 1), (0, 2)), ((0, 1, -4),), (), True),  # the player's head
    6: ([[-4, 0, 0]], path((0, 0), (0, 1), (0, 2)), (), (), False),  # nothing behind the head
    7: ([[0, -4, 0], [0, -4, 0]], path((0, 1), (0, 2)) + path((1, 1), (1, 2)), (), (("h", 0, 0),), True),
    8: ([[0, -4, 0], [0, -4, 0]], path((0, 1), (0, 2)) + path((1, 1), (1, 2)), (), (), False),  # one body for both
    9: ([[0, -4, 0], [0, 0, 0]], path((0, 1), (0, 2), (1, 2), (1, 1)), (), (("h", 0, 0),), False),  # (1, 0) uncovered, body too short
    10: ([[0, 0], [0, 0], [-2, 0]], [], (), (), False),  # no trail
    # A body of 2 x 2, the head below it, the trail around.
    11: ([[0, 0, 0], [0, 0, 0], [-2, 0, 0]], path((2, 0), (2, 1), (2, 2), (1, 2), (0, 2)), (), (("v", 0, 1), ("v", 1, 1), ("h", 1, 1)), True),
    12: ([[0, 0, 0], [0, 0, 0], [-2, 0, 0]], path((2, 0), (2, 1), (2, 2), (1, 2), (0, 2)), (), (("v", 0, 1), ("v", 1, 1)), False),  # the body leaks
    # A body like an L.
    13: ([[0, 0, 0], [0, -3, 0], [0, 0, 0]], path((1, 1), (1, 0), (0, 0), (0, 1)) + path((1, 1), (2, 1)), (), (("v", 0, 1), ("v", 2, 1)), False),
    14: ([[0, 0, 0], [0, -3, 0], [0, 0, 0]], path((1, 1), (1, 0), (0, 0)) + path((1, 1), (0, 1)), (), (("v", 0, 1), ("v", 2, 1)), False),  # the last row uncovered
    15: ([[0, 0, 0, 0], [0, -4, 0, 0]], path((1, 1), (1, 2), (0, 2)) + path((1, 2), (1, 3)), (), (), False),  # a branching trail
    # A head in the middle of its trail.
    16: ([[0, 0, 0], [0, -1, 0], [0, 0, 0]], path((1, 0), (1, 1), (1, 2)), (), (("h", 1, 0), ("h", 1, 2)), False),  # the first row uncovered
    17: ([[0, -1, 0], [0, 0, 9]], path((0, 0), (0, 1), (0, 2)), (), (("h", 0, 0), ("h", 0, 2), ("v", 1, 1)), False),
    18: ([[0, -1, 0], [5, 0, 0]], path((0, 0), (0, 1), (0, 2)), (), (("h", 0, 0), ("h", 0, 2)), False),
    19: ([[0, -1, 0, 0], [0, 0, 0, 0]], path((0, 2), (0, 1), (0, 0), (1, 0)) + path((0, 2), (0, 3)), (), (("h", 0, 2), ("h", 0, 3), ("v", 1, 0)), False),  # four places for three
    20: ([[0, -1, 0], [0, 0, 0], [0, 0, 0]], path((0, 1), (0, 0), (1, 0), (2, 0)) + path((0, 1), (0, 2)), (), (("v", 1, 0), ("v", 2, 0), ("h", 0, 2)), True),
    21: ([[-4, 0], [0, 0]], [], (), (), False),
    22: ([[0]], [], (), (), False),  # no pencil
    # A trail that comes back to its head, and one with a tail beyond: both are followed from the left or right neighbour first.
    23: ([[-2, 0, 0], [0, 0, 0], [0, 0, 0]], [], (), (), False),
    24: ([[0, 0, 0], [-2, 0, 1], [0, 0, 1]], path((1, 0), (1, 1), (2, 1), (2, 0), (1, 0)), (), (("v", 0, 2), ("h", 0, 1), ("h", 0, 2), ("v", 1, 1), ("v", 2, 1)), False),  # the last column uncovered
    25: ([[0, 0, 0], [-2, 0, 0], [0, 0, 0]], path((1, 0), (1, 1), (2, 1), (2, 0), (1, 0)), (), (("h", 0, 1), ("h", 0, 2)), False),
    26: ([[0, 0, 0], [-2, 0, -2], [0, 0, 0]], path((1, 0), (1, 1), (1, 2)), (), (), False),  # heads that meet
    27: ([[0, 0, 0], [-2, 0, 0]], path((1, 0), (1, 1), (1, 2)), (), (), False),
    28: ([[0, 0, 0], [-2, 0, 0], [0, 0, 0], [0, 0, 0]], path((1, 0), (1, 1), (2, 1), (2, 0), (1, 0)) + path((2, 0), (3, 0)), (), (), False),
}


def game_pencils(cells, layer_rows):
    """The rules head by head, by walks and floods."""
    rows, cols = len(cells), len(cells[0])
    drawn = {(x, r, c): v for _, x, r, c, v in layer_rows}
    head = {(r, c): d for r in range(rows) for c in range(cols) if (d := cells[r][c] if cells[r][c] < 0 else drawn.get(("hd", r, c), 0)) < 0}
    wall = {(x[1], r, c) for (x, r, c), v in drawn.items() if x in ("eh", "ev") and v == 1}
    wall |= {(trails.HEADS[d][1], r + trails.HEADS[d][2][0], c + trails.HEADS[d][2][1]) for (r, c), d in head.items()}

    def linked(p):
        r, c = p
        out = [(r, c - 1)] * (drawn.get(("th", r, c - 1)) == 1) + [(r, c + 1)] * (drawn.get(("th", r, c)) == 1)
        return out + [(r - 1, c)] * (drawn.get(("tv", r - 1, c)) == 1) + [(r + 1, c)] * (drawn.get(("tv", r, c)) == 1)

    claimed = set()
    for (r, c), d in sorted(head.items()):
        base = (r + trails.HEADS[d][0][0], c + trails.HEADS[d][0][1])
        if not (0 <= base[0] < rows and 0 <= base[1] < cols):
            return False
        body, stack = {base}, [base]
        while stack:
            x, y = stack.pop()
            for p, w in (((x - 1, y), ("h", x - 1, y)), ((x + 1, y), ("h", x, y)), ((x, y - 1), ("v", x, y - 1)), ((x, y + 1), ("v", x, y))):
                if 0 <= p[0] < rows and 0 <= p[1] < cols and w not in wall and p not in body:
                    body.add(p)
                    stack.append(p)
        xs, ys = [p[0] for p in body], [p[1] for p in body]
        if len(body) != (max(xs) - min(xs) + 1) * (max(ys) - min(ys) + 1) or body & head.keys():
            return False
        if not 1 <= len(linked((r, c))) <= 2:
            return False
        trail = {(r, c)}
        for cur in linked((r, c)):
            seen = {(r, c)}
            while cur not in trail or cur == (r, c):
                seen.add(cur)
                trail.add(cur)
                onward = [p for p in linked(cur) if p not in seen]
                if len(onward) > 1:
                    return False
                if not onward:
                    break
                cur = onward[0]
        if len(trail) - 1 != len(body) or any(cells[x][y] > 0 and cells[x][y] != len(body) for x, y in body):
            return False
        if trail & body or (trail | body) & claimed:
            return False
        claimed |= trail | body
    return len(claimed) == rows * cols


def test_pencils_rules(spark):
    cells = [(k, r, c, v) for k, b in PENCILS.items() for r, line in enumerate(b[0]) for c, v in enumerate(line)]
    drawn = [x for k, b in PENCILS.items() for x in layers(k, *b[:4])]
    got = verdicts(trails.audit_pencils(spark.createDataFrame(cells, CELL), spark.createDataFrame(drawn, EDGE)))
    assert {k: game_pencils(b[0], layers(k, *b[:4])) for k, b in PENCILS.items()} == {k: b[-1] for k, b in PENCILS.items()}
    assert got == {k: b[-1] for k, b in PENCILS.items()}


def test_pencils_as_the_game_judges(spark):
    """Random small boards, random trails and edges: verdicts of walks; and solved rows with random changes."""
    import random

    rng, boards = random.Random(11), {}
    for k in range(400):
        if k % 2:
            size = rng.randrange(1, 4)
            cells = [[0] * size + [-4] + [0] * size for _ in range(rng.randrange(1, 4))]
            pairs = [((r, c), (r, c + 1)) for r in range(len(cells)) for c in range(size, 2 * size)]
            edges = [("h", r, c) for r in range(len(cells) - 1) for c in range(2 * size + 1)]
            if rng.random() < 0.6:
                rng.choice(cells)[rng.randrange(2 * size + 1)] = rng.randrange(-4, 4)
            if rng.random() < 0.4:
                pairs += [((r, c), (r + 1, c)) for r, c in [(rng.randrange(len(cells)), rng.randrange(2 * size + 1))] if r + 1 < len(cells)]
            boards[k] = (cells, pairs, (), edges)
        else:
            m, n = rng.randrange(1, 4), rng.randrange(2, 4)
            cells = [[rng.choice((0, 0, 0, 0, 1, 2, -1, -2, -3, -4)) for _ in range(n)] for _ in range(m)]
            pairs = [((r, c), (r, c + 1)) for r in range(m) for c in range(n - 1) if rng.random() < 0.5] + [((r, c), (r + 1, c)) for r in range(m - 1) for c in range(n) if rng.random() < 0.5]
            edges = [("h", r, c) for r in range(m - 1) for c in range(n) if rng.random() < 0.6] + [("v", r, c) for r in range(m) for c in range(n - 1) if rng.random() < 0.6]
            boards[k] = (cells, pairs, (), edges)
    cells = [(k, r, c, v) for k, b in boards.items() for r, line in enumerate(b[0]) for c, v in enumerate(line)]
    drawn = [x for k, b in boards.items() for x in layers(k, *b)]
    got = verdicts(trails.audit_pencils(spark.createDataFrame(cells, CELL), spark.createDataFrame(drawn, EDGE)))
    want = {k: game_pencils(b[0], layers(k, *b)) for k, b in boards.items()}
    assert got == want
    assert 20 < sum(want.values()) < 380
