"""Numbers and pairs of whole tables without a task that has them all."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.sources.tables import shared_folder

#: Rows of a table that are broadcast to pair them with every row of another.
PAIRED = 100_000


def numbered(rows: DataFrame, order: list[str], name: str = "k") -> DataFrame:
    """``rows`` with their number in ``order``, from 0 without gaps.

    Rows are range-partitioned and sorted, and written so that their places are fixed; a partition's rows count on from those of
    the partitions before it.  Only a count per partition reaches the driver.  Rows that are equal in ``order``
    are numbered in any order, which stays as it is written.
    """
    spark, path = rows.sparkSession, shared_folder(rows.sparkSession, "numbered")
    rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_seq": F.monotonically_increasing_id()}).write.parquet(path)
    placed = spark.read.parquet(path)
    parts = sorted(map(tuple, placed.groupBy("_part").agg(F.min("_seq"), F.count("*")).collect()))
    starts = [0, *accumulate(n for _, _, n in parts)]
    shift = spark.createDataFrame([(p, start - first) for (p, first, _), start in zip(parts, starts, strict=False)], "_part int, _shift long")
    return placed.join(F.broadcast(shift), "_part").withColumn(name, F.col("_seq") + F.col("_shift")).drop("_part", "_seq", "_shift")


def every_pair(many: DataFrame, few: DataFrame, limit: int = PAIRED) -> DataFrame:
    """Each row of ``many`` with each of ``few``: as many rows as the result has.

    ``few`` is broadcast if it has at most ``limit`` rows, which is counted; else it is cut into blocks of about so many, and
    both sides meet block by block in an equi-join.
    """
    n = few.count()
    if n <= limit:
        return many.crossJoin(F.broadcast(few))
    blocks = -(-n // limit)
    cut = few.withColumn("_block", F.pmod(F.xxhash64(*few.columns), F.lit(blocks)).cast("int"))
    return many.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(cut, "_block").drop("_block")
