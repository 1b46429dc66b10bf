"""Catalogue and play tables derived from the star-schema test data.

``Tables(spark, sf_dir)`` has one lazily built DataFrame per table; ``CTE`` has
the same definitions as SQL common table expressions for the oracle queries.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def types(self) -> DataFrame:
        names = self.read("part").select(F.col("p_type").alias("name")).distinct()
        ids = F.row_number().over(Window.orderBy("name"))  # a handful of types
        return names.select(ids.cast("int").alias("id"), "name", F.concat(F.lit("Rules of "), F.lower("name")).alias("rule"))

    @cached_property
    def collections(self) -> DataFrame:
        ids = self.read("part").select(F.col("p_brand").alias("name")).distinct().withColumn("id", F.regexp_extract("name", r"([0-9]+)$", 1).cast("int"))
        return ids.select(
            "id",
            "name",
            F.when(F.col("id") % 4 != 0, F.concat(F.lit("Publisher "), F.col("id") % 4)).alias("publisher"),
            F.when(F.col("id") % 3 != 0, F.concat(F.lit("covers/"), "id", F.lit(".png"))).alias("cover_src"),
            F.when(F.col("id") % 5 != 0, F.date_add(F.lit("2000-01-01").cast("date"), F.col("id") * 17)).alias("publish_at"),
        )

    @cached_property
    def players(self) -> DataFrame:
        return self.read("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))

    @cached_property
    def questions(self) -> DataFrame:
        part = self.read("part").join(self.types.select(F.col("id").alias("puzzle_type"), F.col("name").alias("p_type")), "p_type")
        key = F.col("p_partkey")
        return part.select(
            key.alias("id"),
            "puzzle_type",
            F.when(key % 11 != 0, F.col("p_name")).alias("title"),
            F.when(key % 3 != 0, F.concat(F.lit("Author "), key % 17)).alias("author"),
            (F.col("p_size") % 5 + 1).cast("int").alias("difficulty"),
            F.col("p_size").cast("int").alias("width"),
            (F.col("p_size") % 12 + 5).cast("int").alias("height"),
            F.when(key % 7 != 0, F.regexp_extract("p_brand", r"([0-9]+)$", 1).cast("int")).alias("src_collection"),
            F.timestamp_add("MINUTE", key.cast("int"), F.lit("2024-01-01").cast("timestamp_ntz")).alias("created_at"),
        )

    @cached_property
    def attempts(self) -> DataFrame:
        lines = self.read("lineitem").select("l_orderkey", "l_partkey", "l_linestatus", "l_shipdate")
        orders = self.read("orders").select("o_orderkey", "o_custkey", "o_orderdate")
        return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
            F.col("o_custkey").alias("player"), F.col("l_partkey").alias("question"), F.col("o_orderdate").alias("created_at"), F.when(F.col("l_linestatus") == "F", F.col("l_shipdate")).alias("finished_at")
        )

    @cached_property
    def attempt_list(self) -> DataFrame:
        return self.read("orders").select(
            F.col("o_orderkey").alias("id"),
            F.col("o_custkey").alias("player"),
            F.col("o_orderdate").alias("created_at"),
            F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("finished_at"),
        )

    @cached_property
    def snapshots(self) -> DataFrame:
        return self.read("events").select(
            F.col("event_id").alias("id"),
            F.col("user_id").alias("attempt"),
            F.col("props").alias("current_answer"),
            F.least(F.col("value") / 500, F.lit(1.0)).alias("progress"),
            F.floor(F.col("value") * 60).cast("int").alias("elapsed_seconds"),
            (F.col("event_type") == "purchase").alias("finished"),
            F.col("ts").alias("created_at"),
        )


#: The same tables for the oracle, to be put before a SELECT.
CTE = """
WITH types AS (
  SELECT CAST(row_number() OVER (ORDER BY name) AS INTEGER) AS id, name, 'Rules of ' || lower(name) AS rule
  FROM (SELECT DISTINCT p_type AS name FROM part)),
collections AS (
  SELECT id, name, CASE WHEN id % 4 <> 0 THEN 'Publisher ' || (id % 4) END AS publisher,
         CASE WHEN id % 3 <> 0 THEN 'covers/' || id || '.png' END AS cover_src,
         CASE WHEN id % 5 <> 0 THEN DATE '2000-01-01' + id * 17 END AS publish_at
  FROM (SELECT DISTINCT CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INTEGER) AS id, p_brand AS name FROM part)),
players AS (SELECT c_custkey AS id, c_name AS name FROM customer),
questions AS (
  SELECT p_partkey AS id, t.id AS puzzle_type, CASE WHEN p_partkey % 11 <> 0 THEN p_name END AS title,
         CASE WHEN p_partkey % 3 <> 0 THEN 'Author ' || (p_partkey % 17) END AS author,
         CAST(p_size % 5 + 1 AS INTEGER) AS difficulty, CAST(p_size AS INTEGER) AS width, CAST(p_size % 12 + 5 AS INTEGER) AS height,
         CASE WHEN p_partkey % 7 <> 0 THEN CAST(regexp_extract(p_brand, '([0-9]+)$', 1) AS INTEGER) END AS src_collection,
         TIMESTAMP '2024-01-01' + to_minutes(p_partkey) AS created_at
  FROM part JOIN types t ON t.name = p_type),
attempts AS (
  SELECT o_custkey AS player, l_partkey AS question, o_orderdate AS created_at,
         CASE WHEN l_linestatus = 'F' THEN l_shipdate END AS finished_at
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
attempt_list AS (
  SELECT o_orderkey AS id, o_custkey AS player, o_orderdate AS created_at,
         CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS finished_at FROM orders),
snapshots AS (
  SELECT event_id AS id, user_id AS attempt, props AS current_answer, least(value / 500, 1.0) AS progress,
         CAST(floor(value * 60) AS INTEGER) AS elapsed_seconds, event_type = 'purchase' AS finished, ts AS created_at
  FROM events)
"""
