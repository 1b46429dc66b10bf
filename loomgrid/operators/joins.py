"""Joins of tables that are longer than Spark takes them for, and tables that are read several times."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.sources.tables import shared_folder


def long(rows: DataFrame) -> DataFrame:
    """``rows`` for a join by sorting and merging, whatever size is estimated.

    Cells come from exploded boards, and a board's bytes are all that an estimate
    knows of them: it is too low by a factor of the cells, and a checkpoint keeps
    it.  Joined by the estimate, cells of a whole table would be broadcast, and go
    through the driver's memory.
    """
    return rows.hint("merge")


def looked_up(rows: DataFrame, other: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` with the columns of ``other``, null where it has none; it has one row at most for each ``on``, of which none is null.

    A left join that leaves rows where they are, if both sides are dealt out by the same part of ``on``: a
    join would deal them out anew by all of it.
    """
    more = [c for c in other.columns if c not in on]
    both = rows.withColumn("_own", F.lit(True)).unionByName(other.select(*on, F.struct(*more).alias("_other")), allowMissingColumns=True)
    told = both.withColumn("_other", F.max("_other").over(Window.partitionBy(*on))).filter("_own")
    return told.select(*rows.columns, *[F.col(f"_other.{c}").alias(c) for c in more])


def kept(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` as they are written and read again."""
    path = shared_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
