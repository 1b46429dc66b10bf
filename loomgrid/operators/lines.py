"""Status of nonogram lines while a board is being played."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Steps of the status, each from those before it; cells are 0 unset, 1 filled, 2 crossed.
_STEPS = {
    "n": "size(cells)",
    "m": "size(clue)",
    "starts": "if(n = 0, array(), filter(sequence(0, greatest(n, 1) - 1), i -> get(cells, i) = 1 and (i = 0 or get(cells, i - 1) <> 1)))",
    "ends": "if(n = 0, array(), filter(sequence(1, greatest(n, 1)), i -> get(cells, i - 1) = 1 and (i = n or get(cells, i) <> 1)))",
    "k": "size(starts)",
    "sizes": "zip_with(starts, ends, (s, e) -> e - s)",
    "sealed": "zip_with(starts, ends, (s, e) -> (s = 0 or get(cells, s - 1) = 2) and (e = n or get(cells, e) = 2))",
    # No unset cell between a run and the one before or after it, or the line's end.
    "before": "transform(starts, (s, i) -> not exists(slice(cells, if(i = 0, 0, get(ends, i - 1)) + 1, s - if(i = 0, 0, get(ends, i - 1))), x -> x = 0))",
    "after": "transform(ends, (e, i) -> not exists(slice(cells, e + 1, if(i = k - 1, n, get(starts, i + 1)) - e), x -> x = 0))",
    "front": "cast(least(m, coalesce(nullif(array_position(zip_with(sealed, before, (a, b) -> a and b), false), 0) - 1, k)) as int)",
    "back": "cast(least(m - front, coalesce(nullif(array_position(reverse(zip_with(sealed, after, (a, b) -> a and b)), false), 0) - 1, k)) as int)",
    "wrong": "slice(sizes, 1, front) <> slice(clue, 1, front) or slice(reverse(sizes), 1, back) <> slice(reverse(clue), 1, back)",
    "between": "size(filter(arrays_zip(starts, ends, sealed), g -> g.sealed and g.starts >= if(front > 0, get(ends, front - 1), 0) and g.ends <= if(back > 0, get(starts, k - back), n)))",
    "status": """case when sizes = clue then 'satisfied'
        when size(filter(sealed, x -> x)) > m then 'error'
        when m = 1 and get(clue, 0) = 0 then if(k > 0, 'error', 'satisfied')
        when exists(zip_with(sizes, sealed, (s, x) -> x and s > array_max(clue)), x -> x) then 'error'
        when wrong or between > m - front - back then 'error'
        when front + back = m then 'satisfied' else 'normal' end""",
}


def nonogram_line_status(lines: DataFrame) -> DataFrame:
    """``lines`` (cells, clue: arrays of int) with ``status`` (satisfied, error or normal) and the clues done from both ends.

    A run is sealed between crossed cells or the line's ends.  Sealed runs that
    follow one another from an end, without unset cells before them, have to be
    that end's clues; one larger than every clue, or more of them than clues are
    left, is an error.
    """
    made = lines
    for name, step in _STEPS.items():
        made = made.withColumn(name, F.expr(step))
    all_ = F.col("status") == "satisfied"
    front = F.when(all_, F.col("m")).when(F.col("status") == "normal", F.col("front")).otherwise(0)
    back = F.when(F.col("status") == "normal", F.col("back")).otherwise(0)
    return made.select(*lines.columns, "status", front.alias("done_front"), back.alias("done_back"))
