"""Players' sparse values to full answers, and back, for whole snapshot tables."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.functions.scalars import parse_value_key
from loomgrid.operators.joins import long, looked_up


class Layer(NamedTuple):
    """A matrix of an answer: ``rows`` and ``columns`` more or fewer than the board has."""

    name: str
    rows: int = 0
    columns: int = 0


CELLS = (Layer("cell"),)
#: Layers of each kind's answer.
LAYERS: dict[str, tuple[Layer, ...]] = {
    "sudoku": CELLS,
    "nurimaze": CELLS,
    "double-choco": (Layer("h", -1, 0), Layer("v", 0, -1)),
    "slitherlink": (Layer("h", 1, 0), Layer("v", 0, 1)),
    "nonogram": CELLS,
    "masyu": (Layer("h", 0, -1), Layer("v", -1, 0)),
    "pencils": (Layer("th", 0, -1), Layer("tv", -1, 0), Layer("hd"), Layer("eh", -1, 0), Layer("ev", 0, -1)),
    "nuritwin": CELLS,
    "slalom": (Layer("h", 0, -1), Layer("v", -1, 0)),
    "shakashaka": CELLS,
}


def value_rows(values: DataFrame) -> DataFrame:
    """(board_id, layer, r, c, v) of a map column ``values`` keyed by place; unreadable keys go."""
    each = values.select("board_id", F.explode("values").alias("key", "v"))
    return each.select("board_id", parse_value_key(F.col("key")).alias("k"), "v").filter("k is not null").select("board_id", "k.layer", "k.r", "k.c", "v")


def skeleton(boards: DataFrame, kind: str) -> DataFrame:
    """(board_id, layer, r, c): every place of an answer to boards (board_id, m, n)."""
    layers = F.array(*[F.struct(F.lit(x.name).alias("layer"), (F.col("m") + x.rows).alias("rows"), (F.col("n") + x.columns).alias("columns")) for x in LAYERS[kind]])
    each = boards.select("board_id", F.explode(layers).alias("x")).select("board_id", "x.*").filter("rows > 0 and columns > 0")
    rows = each.select("board_id", "layer", "columns", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("r"))
    return rows.select("board_id", "layer", "r", F.explode(F.sequence(F.lit(0), F.col("columns") - 1)).alias("c"))


def extract(boards: DataFrame, values: DataFrame, kind: str, hints: DataFrame | None = None) -> DataFrame:
    """(board_id, layer, r, c, v): full answers; a place without a value is 0, places outside the board go.

    ``hints`` (board_id, r, c, v): a sudoku's hint wins over a value, and a black
    cell of shakashaka (0 and more) is always 0.
    """
    place = ["board_id", "layer", "r", "c"]
    # All that is known of a place side by side, so that rows that are dealt out by board stay where they are.
    told = {"there": skeleton(boards, kind).withColumn("there", F.lit(True)), "v": value_rows(values).select(*place, "v")}
    if hints is not None:
        told["hint"] = hints.select("board_id", F.lit("cell").alias("layer"), "r", "c", F.col("v").alias("hint"))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), told.values())
    full = rows.groupBy(*place).agg(*[F.max(x).alias(x) for x in told]).filter("there")
    v: Column = F.coalesce("v", F.lit(0))
    if kind == "nonogram":
        v = F.when(v == 1, 1).otherwise(0)
    if hints is not None:
        v = F.when(F.col("hint") >= 0, 0).otherwise(v) if kind == "shakashaka" else F.when(F.col("hint") > 0, F.col("hint")).otherwise(v)
    return full.select(*place, v.alias("v"))


def extract_combo(subcells: DataFrame, values: DataFrame) -> DataFrame:
    """(board_id, sub_idx, r, c, v): answers of combined boards, read at global places."""
    given = value_rows(values).filter("layer = 'cell'").select("board_id", F.col("r").alias("gr"), F.col("c").alias("gc"), F.col("v").alias("given"))
    given = given.groupBy("board_id", "gr", "gc").agg(F.max("given").alias("given"))
    return looked_up(subcells, given, ["board_id", "gr", "gc"]).select("board_id", "sub_idx", "r", "c", F.when(F.col("v") > 0, F.col("v")).otherwise(F.coalesce("given", F.lit(0))).alias("v"))


def nest(answers: DataFrame) -> DataFrame:
    """(board_id, answer): a map of layer to matrix."""
    rows = answers.groupBy("board_id", "layer", "r").agg(F.sort_array(F.collect_list(F.struct("c", "v"))).alias("row"))
    grids = rows.groupBy("board_id", "layer").agg(F.sort_array(F.collect_list(F.struct("r", "row"))).alias("rows"))
    matrix = F.transform("rows", lambda x: F.transform(x["row"], lambda y: y["v"]))
    return grids.select("board_id", "layer", matrix.alias("grid")).groupBy("board_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("layer", "grid")))).alias("answer"))


def restore_values(answers: DataFrame, hints: DataFrame | None = None) -> DataFrame:
    """(board_id, layer, r, c, v): the values a player set; zeros and places with a hint are left out."""
    set_ = answers.filter("v <> 0")
    if hints is None:
        return set_
    given = hints.filter("v > 0").select("board_id", "r", "c", F.lit(True).alias("given"))
    return looked_up(set_, given, ["board_id", "r", "c"]).filter("given is null").select(*set_.columns)


def values_map(rows: DataFrame) -> DataFrame:
    """(board_id, values): long rows as the sparse map, the inverse of ``value_rows``."""
    key = F.when(F.col("layer") == "cell", F.concat_ws(",", "c", "r")).otherwise(F.concat(F.col("layer"), F.lit(":"), F.concat_ws(",", "r", "c")))
    return rows.groupBy("board_id").agg(F.map_from_entries(F.collect_list(F.struct(key.alias("k"), "v"))).alias("values"))


def progress_pencils(cells: DataFrame, values: DataFrame) -> DataFrame:
    """(board_id, progress): cells that a head, trail or edge touches, in percent."""
    below = F.struct((F.col("r") + 1).alias("r"), F.col("c").alias("c"))
    right = F.struct(F.col("r").alias("r"), (F.col("c") + 1).alias("c"))
    own = F.struct(F.col("r").alias("r"), F.col("c").alias("c"))
    ends = F.when(F.col("layer").isin("th", "ev"), F.array(own, right)).when(F.col("layer").isin("tv", "eh"), F.array(own, below)).otherwise(F.array(own))
    touched = values.filter("v <> 0").select("board_id", F.explode(ends).alias("p")).select("board_id", "p.r", "p.c").unionByName(cells.filter("v < 0").select("board_id", "r", "c"))
    from loomgrid.operators.grid import progress_touched

    return progress_touched(cells, touched)


def progress_slalom(gates: DataFrame, trail: DataFrame) -> DataFrame:
    """(board_id, progress): gates (board_id, gate, orientation, line, lo, hi, gate_count) that a trail crosses at a right angle."""
    span = gates.select("board_id", "gate", "orientation", "line", F.explode(F.sequence("lo", "hi")).alias("k"))
    upright = F.col("orientation") == "v"
    at = F.array(F.col("line"), F.col("line") - 1)
    edges = span.select("board_id", "gate", "k", "orientation", F.explode(at).alias("p")).select(
        "board_id", "gate", F.when(upright, "h").otherwise("v").alias("layer"), F.when(upright, F.col("k")).otherwise(F.col("p")).alias("r"), F.when(upright, F.col("p")).otherwise(F.col("k")).alias("c")
    )
    hit = edges.join(long(trail.filter("v = 1")), ["board_id", "layer", "r", "c"], "left_semi").select("board_id", "gate").distinct().groupBy("board_id").agg(F.count("*").alias("n"))
    whole = gates.groupBy("board_id").agg(F.first("gate_count").alias("gate_count"))
    return whole.join(long(hit), "board_id", "left").select("board_id", F.when(F.col("gate_count") == 0, 0.0).otherwise(F.coalesce("n", F.lit(0)) / F.col("gate_count") * 100).alias("progress"))


def progress_audit(stored: DataFrame, computed: DataFrame) -> DataFrame:
    """(board_id, stored, recomputed, delta): fractions as they are stored against percentages anew."""
    new = computed.select("board_id", (F.col("progress") / 100).alias("recomputed"))
    return stored.join(long(new), "board_id", "left").withColumn("delta", F.col("recomputed") - F.col("stored"))
