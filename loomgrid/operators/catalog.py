"""Catalogue reads: views, filters, lookups, orders and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NONE = "none"


def join_type(questions: DataFrame, types: DataFrame) -> DataFrame:
    """Questions with their type's name; the few types are broadcast."""
    return questions.join(types.select(F.col("id").alias("puzzle_type"), F.col("name").alias("type_name")), "puzzle_type")


def join_collection_left(questions: DataFrame, collections: DataFrame) -> DataFrame:
    """Questions with their collection's name and cover; those without one stay."""
    side = collections.select(F.col("id").alias("src_collection"), F.col("name").alias("collection_name"), "cover_src")
    return questions.join(side, "src_collection", "left")


def puzzle_view(questions: DataFrame, types: DataFrame, collections: DataFrame) -> DataFrame:
    """Enriched question rows."""
    return join_collection_left(join_type(questions, types), collections)


def camel_columns(df: DataFrame) -> DataFrame:
    """Columns renamed from snake_case to camelCase."""

    def camel(name: str) -> str:
        first, *rest = name.split("_")
        return first + "".join(w[:1].upper() + w[1:] for w in rest)

    return df.toDF(*[camel(c) for c in df.columns])


def uncollected(questions: DataFrame) -> DataFrame:
    return questions.filter(F.col("src_collection").isNull())


def list_puzzles(view: DataFrame, puzzle_type: int | None = None, src_collection: int | str | None = None, limit: int | None = None) -> DataFrame:
    """Newest first; a limit counts only if it is positive."""
    if puzzle_type is not None:
        view = view.filter(F.col("puzzle_type") == puzzle_type)
    if src_collection == NONE:
        view = uncollected(view)
    elif src_collection is not None:
        view = view.filter(F.col("src_collection") == int(src_collection))
    view = view.orderBy(F.desc("created_at"), F.desc("id"))
    return view.limit(limit) if limit and limit > 0 else view


def by_id(df: DataFrame, key) -> DataFrame:
    """Point lookup; the predicate reaches the scan."""
    return df.filter(F.col("id") == F.lit(key))


def attempts_open_or_done(attempts: DataFrame, finished: bool = False) -> DataFrame:
    """Unfinished attempts unless finished ones are asked for."""
    return attempts.filter(F.col("finished_at").isNotNull() if finished else F.col("finished_at").isNull())


def snapshot_listing(snapshots: DataFrame) -> DataFrame:
    """Snapshots without their answers, newest first per attempt."""
    return snapshots.select("id", "attempt", "progress", "elapsed_seconds", "finished", "created_at").orderBy("attempt", F.desc("created_at"), F.desc("id"))


def required_fields(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    """Rows with ``reason``: the first required field that is null or blank, else null."""
    reason = F.coalesce(*[F.when(F.col(n).isNull() | (F.col(n).cast("string") == ""), F.lit(f"{n} is required")) for n in names])
    return rows.withColumn("reason", reason)


def blank_to_null(column: Column) -> Column:
    return F.nullif(column, F.lit(""))


def zero_to_null(column: Column) -> Column:
    return F.nullif(column, F.lit(0))


def display_defaults(view: DataFrame) -> DataFrame:
    """Texts shown where values are missing."""
    return view.select(
        "id",
        F.coalesce("title", F.lit("Untitled")).alias("title"),
        F.coalesce("author", F.lit("N/A")).alias("author"),
        F.coalesce("collection_name", F.lit("(none)")).alias("collection_name"),
        F.coalesce("type_name", F.concat(F.lit("Type "), "puzzle_type")).alias("type_name"),
        F.coalesce("width", F.lit(0)).alias("width"),
    )


def name_lookup(rows: DataFrame, names: DataFrame, key: str, fallback: str) -> DataFrame:
    """``rows`` with ``label``: the name of ``key``, or the fallback text before the key."""
    side = names.select(F.col("id").alias(key), F.col("name").alias("found"))
    return rows.join(side, key, "left").withColumn("label", F.coalesce("found", F.concat(F.lit(fallback), F.col(key)))).drop("found")


def sort_key(by: str) -> Column:
    """Missing texts sort as blank, missing sizes as 0; texts compare by code point."""
    if by == "size":
        return F.coalesce("width", F.lit(0)) * F.coalesce("height", F.lit(0))
    return F.coalesce(by, F.lit("")) if by in ("title", "author") else F.col(by)


def sort_puzzles(view: DataFrame, by: str = "title", descending: bool = False) -> DataFrame:
    key = sort_key(by)
    return view.orderBy(key.desc() if descending else key.asc(), "id")


def collections_by_date(collections: DataFrame) -> DataFrame:
    """Latest publication first, undated ones last."""
    return collections.orderBy(F.desc_nulls_last("publish_at"), "id")


def solved_subset(attempts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(player, question) that are finished and whose question is in ``wanted`` (question)."""
    return attempts.filter(F.col("finished_at").isNotNull()).select("player", "question").join(wanted, "question", "left_semi").distinct()
