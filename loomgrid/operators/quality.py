"""Checks of nested board documents and of keys between tables, as column expressions.

A document is JSON text.  Numbers are parsed as doubles, since a document may
write an integer as 1.0; a field of the wrong type parses to null, and object
keys tell a missing field from a null one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRID = "array<array<double>>"


def whole(v: Column, low: int | None = None, high: int | None = None) -> Column:
    """An integer within bounds; null and NaN are none."""
    ok = v.isNotNull() & ~F.isnan(v) & (v == F.floor(v))
    if low is not None:
        ok = ok & (v >= low)
    if high is not None:
        ok = ok & (v <= high)
    return F.coalesce(ok, F.lit(False))


def every(items: Column, test: Callable[[Column], Column]) -> Column:
    return F.coalesce(F.forall(items, test), F.lit(False))


class Grid(NamedTuple):
    """A required matrix of integers."""

    name: str
    low: int | None = None
    high: int | None = None
    rows: tuple[int, int | None] = (0, None)
    columns: tuple[int, int | None] = (0, None)

    def reasons(self, grid: Column) -> list[Column]:
        def within(n: Column, bounds: tuple[int, int | None]) -> Column:
            return (n >= bounds[0]) & (n <= bounds[1] if bounds[1] is not None else F.lit(True))

        typed = every(grid, lambda row: every(row, lambda v: whole(v)))
        shape = within(F.size(grid), self.rows) & every(grid, lambda row: within(F.size(row), self.columns))
        inside = every(grid, lambda row: every(row, lambda v: whole(v, self.low, self.high)))
        return [
            F.when(~typed, F.lit(f"type:{self.name}")),
            F.when(typed & ~shape, F.lit(f"shape:{self.name}")),
            F.when(typed & ~inside, F.lit(f"range:{self.name}")),
        ]


NINE = {"rows": (9, 9), "columns": (9, 9)}
#: Matrices of each document kind by its name (fixed values of the published schemas).
GRIDS: dict[str, tuple[Grid, ...]] = {
    "sudoku": (Grid("hints", 0, 9, **NINE),),
    "nurimaze": (Grid("cells", 0, 4, (1, None)),),
    "slitherlink": (Grid("cells", -1, 3, (1, None), (1, None)),),
    "nonogram": (Grid("rowClues", 0, None, (1, None), (1, None)), Grid("colClues", 0, None, (1, None), (1, None))),
    "masyu": (Grid("cells", 0, 2, (1, None), (1, None)),),
    "pencils": (Grid("cells", -4, None, (1, None), (1, None)),),
    "nuritwin": (Grid("cells", 0, None, (1, None)),),
    "slalom": (Grid("cells", 0, 1, (1, None), (1, None)),),
    "shakashaka": (Grid("cells", -1, 5, (1, None)),),
}
#: Type ids of the kinds (fixed values).
KINDS = {1: "sudoku", 2: "combo-sudoku", 3: "nurimaze", 4: "double-choco", 5: "slitherlink", 6: "nonogram", 7: "masyu", 8: "pencils", 9: "nuritwin", 10: "slalom", 11: "shakashaka"}


def _keys(text: Column, required: Sequence[str], optional: Sequence[str] = (), at: str = "") -> list[Column]:
    """Reasons for missing and extra keys of an object; what isn't an object is of the wrong type."""
    have = F.json_object_keys(text)
    known = F.array(*[F.lit(k) for k in (*required, *optional)])
    return [
        F.when(have.isNull(), F.lit(f"type:{at.rstrip('.') or 'document'}")),
        *[F.when(~F.array_contains(have, k), F.lit(f"missing:{at}{k}")) for k in required],
        F.when(F.size(F.array_except(have, known)) > 0, F.lit(f"extra:{at.rstrip('.') or 'document'}")),
    ]


def _collect(*reasons: Column) -> Column:
    return F.array_compact(F.array(*reasons))


def _grids(text: Column, grids: Sequence[Grid]) -> list[Column]:
    parsed = F.from_json(text, ", ".join(f"`{g.name}` {GRID}" for g in grids))
    have = F.json_object_keys(text)
    return [F.when(F.array_contains(have, g.name), r) for g in grids for r in g.reasons(parsed[g.name])]


def _borders(text: Column) -> list[Column]:
    inner = F.get_json_object(text, "$.grids")
    return [*[F.when(inner.isNotNull(), r) for r in _keys(inner, ("h", "v"), at="grids.")], *[F.when(inner.isNotNull(), r) for r in _grids(inner, (Grid("h", 0, 1), Grid("v", 0, 1)))]]


def _combo(text: Column) -> Column:
    parsed = F.from_json(text, f"room_width double, room_height double, subboards array<struct<x:double,y:double,hints:{GRID}>>")
    parts = F.from_json(text, "subboards array<string>")["subboards"]
    names = F.array(F.lit("x"), F.lit("y"), F.lit("hints"))
    have = F.json_object_keys(text)
    exact = every(parts, lambda p: F.coalesce((F.size(F.array_except(F.json_object_keys(p), names)) == 0) & (F.size(F.json_object_keys(p)) == 3), F.lit(False)))
    hints = every(parsed["subboards"], lambda b: every(b["hints"], lambda row: (F.size(row) == 9) & every(row, lambda v: whole(v, 0, 9))) & (F.size(b["hints"]) == 9))
    places = every(parsed["subboards"], lambda b: whole(b["x"], 0) & whole(b["y"], 0))
    rooms = [F.when(F.array_contains(have, k) & ~whole(parsed[k], 1), F.lit(f"range:{k}")) for k in ("room_width", "room_height")]
    return _collect(
        *_keys(text, ("subboards",), ("room_width", "room_height")),
        *rooms,
        F.when(F.array_contains(have, "subboards") & ~(F.coalesce(F.size(parts), F.lit(0)) >= 1), F.lit("shape:subboards")),
        F.when(F.size(parts) >= 1, F.when(~exact, F.lit("keys:subboards"))),
        F.when(F.size(parts) >= 1, F.when(~places, F.lit("range:place"))),
        F.when(F.size(parts) >= 1, F.when(~hints, F.lit("shape:hints"))),
    )


def _double_choco(text: Column) -> Column:
    cells = F.from_json(text, "cells array<array<array<double>>>")["cells"]
    have = F.json_object_keys(text)
    pairs = every(cells, lambda row: (F.size(row) >= 1) & every(row, lambda p: (F.size(p) == 2) & every(p, lambda v: whole(v, 0)))) & (F.size(cells) >= 1)
    return _collect(*_keys(text, ("cells",)), F.when(F.array_contains(have, "cells") & ~F.coalesce(pairs, F.lit(False)), F.lit("range:cells")))


def _slalom(text: Column) -> Column:
    parsed = F.from_json(text, "start struct<row:double,col:double>, gateCount double, gates array<struct<orientation:string,line:double,`from`:double,`to`:double,number:double>>")
    parts, have = F.from_json(text, "gates array<string>")["gates"], F.json_object_keys(text)
    start = F.get_json_object(text, "$.start")
    names = ("orientation", "line", "from", "to", "number")
    known = F.array(*[F.lit(n) for n in names])
    exact = every(parts, lambda p: F.coalesce((F.size(F.array_except(F.json_object_keys(p), known)) == 0) & (F.size(F.json_object_keys(p)) == len(names)), F.lit(False)))
    good = every(
        parsed["gates"],
        lambda g: F.coalesce(g["orientation"].isin("h", "v"), F.lit(False)) & whole(g["line"], 0) & whole(g["from"], 0) & whole(g["to"], 0) & (g["number"].isNull() | whole(g["number"], 1)),
    )
    return _collect(
        *_keys(text, ("cells", "start", "gateCount", "gates")),
        *_grids(text, GRIDS["slalom"]),
        *[F.when(start.isNotNull(), r) for r in _keys(start, ("row", "col"), at="start.")],
        F.when(start.isNotNull() & ~(whole(parsed["start"]["row"], 0) & whole(parsed["start"]["col"], 0)), F.lit("range:start")),
        F.when(F.array_contains(have, "gateCount") & ~whole(parsed["gateCount"], 1), F.lit("range:gateCount")),
        F.when(F.array_contains(have, "gates") & ~(F.coalesce(F.size(parts), F.lit(0)) >= 1), F.lit("shape:gates")),
        F.when(F.size(parts) >= 1, F.when(~(exact & good), F.lit("range:gates"))),
    )


def validate(kind: str, text: Column) -> Column:
    """Reasons for which a document of ``kind`` is invalid; none if it is valid.

    Null and malformed texts are of the wrong type.
    """
    if kind == "combo-sudoku":
        return _combo(text)
    if kind == "double-choco":
        return _double_choco(text)
    if kind == "slalom":
        return _slalom(text)
    grids = GRIDS[kind]
    bordered = kind in ("nurimaze", "nuritwin")
    required = (*[g.name for g in grids], *(("grids",) if bordered else ()))
    return _collect(*_keys(text, required), *_grids(text, grids), *(_borders(text) if bordered else ()))


def validate_dispatch(kind_id: Column, text: Column) -> Column:
    """Reasons by the rule set of the type; a type that isn't known is a reason."""
    out = F.array(F.lit("type:unknown"))
    for number, kind in KINDS.items():
        out = F.when(kind_id == number, validate(kind, text)).otherwise(out)
    return out


def rectangular(grid: Column) -> Column:
    return F.coalesce(F.size(F.array_distinct(F.transform(grid, lambda row: F.size(row)))) <= 1, F.lit(False))


def validate_shape(cells: Column, h: Column, v: Column) -> Column:
    """Second tier: rows of one length, at least 2 x 2, borders of the sizes that the cells ask for."""
    m, n = F.size(cells), F.size(F.get(cells, F.lit(0)))

    def sized(grid: Column, rows: Column, columns: Column) -> Column:
        return (F.size(grid) == rows) & every(grid, lambda row: F.size(row) == columns)

    return _collect(
        F.when(~rectangular(cells), F.lit("ragged")), F.when((m < 2) | (n < 2), F.lit("small")), F.when(~sized(h, m - 1, n), F.lit("h")), F.when(~sized(v, m, n - 1), F.lit("v"))
    )


def _second(kind: str, text: Column) -> list[Column]:
    """Reasons of the second tier for one kind."""

    def told(wrong: Column, name: str) -> Column:
        return F.when(F.coalesce(wrong, F.lit(False)), F.lit(name))

    def outside(grid: Column, low: int, high: int | None = None) -> Column:
        return ~every(grid, lambda row: every(row, lambda v: whole(v, low, high)))

    def sized(grid: Column, rows: Column, columns: Column) -> Column:
        return (F.size(grid) == rows) & every(grid, lambda row: F.size(row) == columns)

    nine = lambda grid: ~sized(grid, F.lit(9), F.lit(9))
    if kind == "sudoku":
        hints = F.from_json(text, f"hints {GRID}")["hints"]
        return [told(hints.isNull(), "unreadable"), told(nine(hints), "shape"), told(outside(hints, 0, 9), "range")]
    if kind == "combo-sudoku":
        parts = F.from_json(text, f"subboards array<struct<hints:{GRID}>>")["subboards"]
        return [told(parts.isNull(), "unreadable"), told(F.exists(parts, lambda b: nine(b["hints"])), "shape"), told(F.exists(parts, lambda b: outside(b["hints"], 0, 9)), "range")]
    if kind == "nonogram":
        doc = F.from_json(text, f"rowClues {GRID}, colClues {GRID}")
        lines = F.concat(doc["rowClues"], doc["colClues"])
        return [told(lines.isNull(), "unreadable"), told(F.exists(lines, lambda x: F.size(x) == 0), "shape"), told(outside(lines, 0), "range")]
    if kind == "double-choco":
        cells = F.from_json(text, f"cells array<{GRID}>")["cells"]
        pair = lambda p: (F.size(p) == 2) & F.get(p, F.lit(0)).isin(0, 1) & whole(F.get(p, F.lit(1)), 0)
        wrong = ~every(cells, lambda row: every(row, lambda p: F.coalesce(pair(p), F.lit(False))))
    else:
        cells = F.from_json(text, f"cells {GRID}")["cells"]
        low, high = next((g.low, g.high) for g in GRIDS[kind] if g.name == "cells")
        wrong = outside(cells, low, high)
    base = [told(cells.isNull(), "unreadable")]
    if kind in ("masyu", "pencils", "slitherlink"):
        return [*base, told(wrong, "range")]
    m, n = F.size(cells), F.size(F.get(cells, F.lit(0)))
    least = 1 if kind == "shakashaka" else 2
    base += [told(~rectangular(cells), "ragged"), told((m < least) | (n < least), "small"), told(wrong, "range")]
    if kind in ("nurimaze", "nuritwin"):
        grids = F.from_json(text, f"grids struct<h:{GRID},v:{GRID}>")["grids"]
        for name, rows, columns in (("h", m - 1, n), ("v", m, n - 1)):
            base.append(told(~sized(grids[name], rows, columns) | outside(grids[name], 0, 1), name))
    if kind == "slalom":
        doc = F.from_json(text, "start struct<row:double,col:double>, gateCount double, gates array<struct<orientation:string,`from`:double,`to`:double,number:double>>")
        start, gate = doc["start"], lambda g: g["orientation"].isin("h", "v") & (g["from"] <= g["to"]) & (g["number"].isNull() | (g["number"] >= 1))
        inside = (start["row"] >= 0) & (start["row"] < m) & (start["col"] >= 0) & (start["col"] < n)
        base += [told(~F.coalesce(inside, F.lit(False)), "start"), told(~F.coalesce(doc["gateCount"] >= 1, F.lit(False)), "gateCount"), told(~every(doc["gates"], lambda g: F.coalesce(gate(g), F.lit(False))), "gates")]
    return base


def validate_second(kind_id: Column, text: Column) -> Column:
    """Second tier by type: rows of one length and of the least size, grids of the sizes that the cells ask for, a start on the board, gates that go forwards.

    A document that can't be read has this one reason; a type that isn't known has one, too.
    """
    out = F.array(F.lit("unknown"))
    for number, kind in KINDS.items():
        reasons = _second(kind, text)
        out = F.when(kind_id == number, F.when(reasons[0].isNotNull(), F.array(reasons[0])).otherwise(_collect(*reasons[1:]))).otherwise(out)
    return out


def derive_dimensions(text: Column) -> Column:
    """(width, height, width_cells) by the keys present: hints, subboards, cells, rowClues.

    ``width`` of combined boards is as it is stored, ``width_cells`` counts cells.
    """
    doc = F.from_json(text, f"hints {GRID}, subboards array<struct<x:double,y:double>>, cells array<array<string>>, rowClues {GRID}, colClues {GRID}")
    have = F.json_object_keys(text)

    def size(width: Column, height: Column, cells: Column | None = None) -> Column:
        return F.struct(width.cast("int").alias("width"), height.cast("int").alias("height"), (width if cells is None else cells).cast("int").alias("width_cells"))

    x, y = F.array_max(doc["subboards"]["x"]), F.array_max(doc["subboards"]["y"])
    return (
        F.when(F.array_contains(have, "hints"), size(F.size(F.get(doc["hints"], F.lit(0))), F.size(doc["hints"])))
        .when(F.array_contains(have, "subboards"), size(x + 9, y + 9, 3 * x + 9))
        .when(F.array_contains(have, "cells"), size(F.size(F.get(doc["cells"], F.lit(0))), F.size(doc["cells"])))
        .when(F.array_contains(have, "rowClues"), size(F.size(doc["colClues"]), F.size(doc["rowClues"])))
    )


def fk_check(child: DataFrame, column: str, parent: DataFrame, name: str) -> DataFrame:
    """(relation, key, n): keys of ``child`` that ``parent`` (id) lacks; null keys are allowed."""
    orphans = child.filter(F.col(column).isNotNull()).join(parent.select(F.col("id").alias(column)), column, "left_anti")
    return orphans.groupBy(F.col(column).cast("long").alias("key")).agg(F.count("*").alias("n")).select(F.lit(name).alias("relation"), "key", "n")


def unique_keys(keys: Sequence[tuple[str, DataFrame, Sequence[str]]]) -> DataFrame:
    """(relation, key, n): keys of several tables (name, rows, columns) that occur more than once, as text."""
    found = []
    for name, rows, columns in keys:
        key = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns])
        found.append(unique_check(rows, columns).select(F.lit(name).alias("relation"), key.alias("key"), "n"))
    return reduce(DataFrame.unionByName, found)


def unique_check(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with how often."""
    return df.groupBy(*columns).agg(F.count("*").alias("n")).filter("n > 1")


def key_diff(a: Column, b: Column) -> Column:
    """Keys that only one of two schemas has."""
    return F.struct(F.array_sort(F.array_except(a, b)).alias("only_a"), F.array_sort(F.array_except(b, a)).alias("only_b"))
