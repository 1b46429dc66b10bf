"""Writes as set-based jobs: what is accepted, what is rejected and why."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.operators.catalog import blank_to_null, zero_to_null
from loomgrid.operators.numbering import numbered
from loomgrid.operators.quality import derive_dimensions, validate_dispatch


def bulk_create(candidates: DataFrame) -> DataFrame:
    """Candidates (puzzle_type, title, author, difficulty, src_collection, canon) with size, ``reason`` and ``status``.

    Rows of status ``created`` are to be appended.
    """
    missing = F.coalesce(*[F.when(F.col(c).isNull(), F.lit(f"{c} is required")) for c in ("puzzle_type", "canon", "difficulty")])
    faults = F.array_join(validate_dispatch(F.col("puzzle_type"), F.col("canon")), ",")
    checked = candidates.withColumn("reason", F.coalesce(missing, F.nullif(faults, F.lit(""))))
    size = derive_dimensions(F.col("canon"))
    return checked.withColumns(
        {
            "title": blank_to_null(F.col("title")),
            "author": blank_to_null(F.col("author")),
            "src_collection": zero_to_null(F.col("src_collection")),
            "width": F.when(F.col("reason").isNull(), size["width"]),
            "height": F.when(F.col("reason").isNull(), size["height"]),
            "status": F.when(F.col("reason").isNull(), "created").otherwise("failed"),
        }
    )


def status_counts(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count_if(F.col("status") == "created").alias("created"), F.count_if(F.col("status") == "failed").alias("failed"))


def batch_counts(items: DataFrame) -> DataFrame:
    """Counts of a batch's items (status pending, parsing, success or error; checked), and of those that are created or fail.

    Created are the checked items that were parsed; their ``create_status`` is that of ``bulk_create``.
    """
    sent = (F.col("status") == "success") & F.col("checked")
    states = {s: F.col("status") == s for s in ("success", "error", "parsing", "pending")} | {"checked": F.col("checked")}
    made = {s: sent & (F.col("create_status") == s) for s in ("created", "failed")}
    return items.agg(*[F.count_if(test).alias(name) for name, test in (states | made).items()])


def bulk_patch(questions: DataFrame, patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``questions`` after sparse updates (id, patch as JSON text), refused (id, reason)).

    An absent field keeps its value, a blank one clears title, author or collection.  A new ``canonRepr`` is
    validated by the question's type and replaces ``canon_repr`` and the size; if it is invalid nothing of its
    patch is applied.  Patches without a field and those of unknown questions are refused, too.
    """
    fields = {"title": "string", "author": "string", "difficulty": "int", "src_collection": "int"}
    have = F.json_object_keys("patch")
    parsed = patches.select("id", "patch", have.alias("have"), F.from_json("patch", ", ".join(f"{k} {v}" for k, v in fields.items())).alias("new"), F.get_json_object("patch", "$.canonRepr").alias("new_canon"))
    joined = questions.join(parsed, "id", "left")
    known = F.array(*[F.lit(k) for k in (*fields, "canonRepr")])
    faults = F.array_join(validate_dispatch(F.col("puzzle_type"), F.col("new_canon")), ",")
    reason = F.when(F.coalesce(F.size(F.array_intersect("have", known)), F.lit(0)) == 0, "no fields to update").when(F.array_contains("have", "canonRepr"), F.nullif(faults, F.lit("")))
    judged = joined.withColumn("reason", F.when(F.col("patch").isNotNull(), reason))
    applied = F.col("patch").isNotNull() & F.col("reason").isNull()

    def value(name: str):
        new = F.col(f"new.{name}")
        if name in ("title", "author"):
            new = blank_to_null(new)
        elif name == "src_collection":
            new = zero_to_null(new)
        return F.when(applied & F.array_contains("have", name), new).otherwise(F.col(name))

    redrawn, size = applied & F.array_contains("have", "canonRepr"), derive_dimensions(F.col("new_canon"))
    board = {k: F.when(redrawn, F.coalesce(size[k], F.col(k))).otherwise(F.col(k)) for k in ("width", "height")}
    board |= {"canon_repr": F.when(redrawn, F.col("new_canon")).otherwise(F.col("canon_repr"))} if "canon_repr" in questions.columns else {}
    refused = judged.filter("reason is not null").select("id", "reason")
    unknown = patches.join(questions, "id", "left_anti").select("id", F.lit("puzzle not found").alias("reason"))
    return judged.withColumns({name: value(name) for name in fields} | board).select(*questions.columns), refused.unionByName(unknown)


def bulk_delete(questions: DataFrame, ids: DataFrame, attempts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(questions that stay, ids that attempts refer to and that are refused)."""
    blocked = ids.join(attempts.select(F.col("question").alias("id")), "id", "left_semi")
    return questions.join(ids.join(blocked, "id", "left_anti"), "id", "left_anti"), blocked


def append_collections(existing: DataFrame, rows: DataFrame) -> DataFrame:
    """New collections (name, publisher, cover_src, publish_at) with the next ids; a name is required."""
    top = existing.agg(F.max("id")).first()[0] or 0
    named = numbered(rows.filter(F.coalesce("name", F.lit("")) != ""), ["name", *[c for c in rows.columns if c != "name"]])
    return named.select((F.col("k") + top + 1).cast("int").alias("id"), "name", blank_to_null(F.col("publisher")).alias("publisher"), blank_to_null(F.col("cover_src")).alias("cover_src"), "publish_at")


def start_attempts(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(attempts, first snapshots) of requests (id, player, question, answer, at)."""
    attempts = requests.select("id", "player", "question", F.col("at").alias("created_at"), F.lit(None).cast("timestamp_ntz").alias("finished_at"))
    first = requests.select(
        F.col("id").alias("attempt"), F.coalesce("answer", F.lit("{}")).alias("current_answer"), F.lit(0.0).alias("progress"), F.lit(0).alias("elapsed_seconds"), F.lit(False).alias("finished"), F.col("at").alias("created_at")
    )
    return attempts, first


def apply_snapshots(attempts: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Attempts with ``finished_at`` of their last finishing snapshot; incomplete snapshots count for nothing."""
    whole = snapshots.filter("progress is not null and elapsed_seconds is not null and finished")
    ends = whole.groupBy(F.col("attempt").alias("id")).agg(F.max("created_at").alias("end"))
    return attempts.join(ends, "id", "left").withColumn("finished_at", F.coalesce("end", "finished_at")).drop("end")


def unlock_append(existing: DataFrame, reached: DataFrame) -> DataFrame:
    """New (player, achievement_id) pairs, each once."""
    return reached.dropDuplicates(["player", "achievement_id"]).join(existing.select("player", "achievement_id"), ["player", "achievement_id"], "left_anti")


def started(requests: DataFrame) -> DataFrame:
    """``requests`` with an id of their own each, and the time of the statement."""
    return requests.withColumns({"id": F.uuid(), "created_at": F.current_timestamp()})


def reset_and_seed(tables: dict[str, DataFrame], folder: str) -> dict[str, DataFrame]:
    """Drop what is below ``folder`` under the tables' names, write them anew in their order, and read them back."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{folder}/{name}")
    return {name: rows.sparkSession.read.schema(rows.schema).parquet(f"{folder}/{name}") for name, rows in tables.items()}


def seed(spark: SparkSession, types: DataFrame, folder: str) -> None:
    """The dimension tables anew: types and the first account."""
    account = spark.createDataFrame([(1, "player", "admin")], "id int, name string, role string")
    reset_and_seed({"puzzle_types": types, "player_account": account}, folder)
