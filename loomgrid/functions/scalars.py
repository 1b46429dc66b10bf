"""Column functions of the catalogue, all built from Spark's own."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Difficulty labels (fixed values).
DIFFICULTY = {1: "Very easy", 2: "Easy", 3: "Normal", 4: "Hard", 5: "Super hard"}


def format_elapsed(seconds: Column) -> Column:
    """HH:MM:SS; hours are not bounded."""
    s = seconds.cast("long")
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def difficulty_label(level: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in DIFFICULTY.items() for x in pair])
    return F.coalesce(F.element_at(names, level), level.cast("string"))


def star_bar(level: Column, of: int = 5) -> Column:
    n = F.greatest(F.lit(0), F.least(level, F.lit(of)))
    return F.concat(F.repeat(F.lit("★"), n), F.repeat(F.lit("☆"), F.lit(of) - n))


def percent_round(fraction: Column) -> Column:
    """Whole percent, halves up."""
    return F.floor(fraction * 100 + 0.5)


def percent_text(percent: Column) -> Column:
    """A percentage with one decimal, halves up."""
    tenths = F.floor(percent * 10 + 0.5).cast("long")
    return F.concat(F.expr("''"), F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit(" %"))


def board_area(width: Column, height: Column) -> Column:
    return F.coalesce(width, F.lit(0)) * F.coalesce(height, F.lit(0))


def parse_value_key(key: Column) -> Column:
    """``layer:row,col`` or ``col,row`` to a struct (layer, r, c); null if it is neither."""
    whole = key.rlike(r"^([a-z]+:)?-?\d+,-?\d+$")
    place = F.substring_index(key, ":", -1)
    one, two = F.substring_index(place, ",", 1).try_cast("int"), F.substring_index(place, ",", -1).try_cast("int")
    named = F.contains(key, F.lit(":"))
    return F.when(whole, F.struct(F.when(named, F.substring_index(key, ":", 1)).otherwise("cell").alias("layer"), F.when(named, one).otherwise(two).alias("r"), F.when(named, two).otherwise(one).alias("c")))


def strip_fences(text: Column) -> Column:
    """A model's reply without its code fence."""
    bare = F.regexp_replace(F.trim(text), r"^```[A-Za-z]*\s*", "")
    return F.trim(F.regexp_replace(bare, r"\s*```$", ""))


def slug(name: Column) -> Column:
    return F.translate(name, "_", "-")


def file_parts(path: Column) -> Column:
    """(name, extension): last part of a path, and its lower-case extension."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.struct(name.alias("name"), F.lower(F.when(F.contains(name, F.lit(".")), F.element_at(F.split(name, r"\."), -1)).otherwise("")).alias("extension"))


def parse_clue_text(text: Column) -> Column:
    """``"3, 1 2"`` to [3, 1, 2]: integers from 0 up, nothing else; empty is [0]."""
    numbers = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"[,\s]+"), lambda x: x.try_cast("int")), lambda n: n.isNotNull() & (n >= 0))
    return F.when(F.size(numbers) == 0, F.array(F.lit(0))).otherwise(numbers)
