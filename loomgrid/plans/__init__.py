"""Registry of the queries over catalogue, play data and boards, with their SQL."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from loomgrid.plans import answers, audits, boards, contours, documents, registry, relational, rooms, writes
from loomgrid.sources.analog import CTE, Tables

#: Queries whose SQL names the boards' formulas itself, without the catalogue's tables.
PLAIN = boards.QUERIES | answers.QUERIES | audits.QUERIES | rooms.QUERIES | contours.QUERIES | documents.QUERIES | registry.QUERIES | writes.QUERIES


def _run(build, spark: SparkSession, sf_dir: str) -> DataFrame:
    return build(Tables(spark, sf_dir))


def queries() -> dict:
    return {name: partial(_run, build) for name, (build, _) in (relational.QUERIES | PLAIN).items()}


def oracle_sql() -> dict[str, str]:
    return {name: CTE + sql for name, (_, sql) in relational.QUERIES.items()} | {name: sql for name, (_, sql) in PLAIN.items()}
