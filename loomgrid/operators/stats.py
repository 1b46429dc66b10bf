"""Play statistics and achievements of all players at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgrid.operators.numbering import every_pair

#: Achievement definitions as they are awarded (fixed values).
STATIC_DEFINITIONS = [
    ("total_solved_1", "First Steps", "Solve your first puzzle", "total", "total", None, 1),
    ("total_solved_5", "Getting Started", "Solve 5 puzzles", "total", "total", None, 5),
    ("total_solved_20", "Dedicated", "Solve 20 puzzles", "total", "total", None, 20),
    ("total_solved_50", "Puzzle Master", "Solve 50 puzzles", "total", "total", None, 50),
    ("total_solved_100", "Century", "Solve 100 puzzles", "total", "total", None, 100),
    ("type_diversity_3", "Explorer", "Solve puzzles of 3 different types", "diversity", "types", None, 3),
    ("type_diversity_5", "Polymath", "Solve puzzles of 5 different types", "diversity", "types", None, 5),
    ("difficulty_hard_1", "Challenger", "Solve a Hard+ puzzle", "difficulty", "hard", None, 1),
    ("difficulty_superhard_1", "Fearless", "Solve a Super-Hard puzzle", "difficulty", "superhard", None, 1),
    ("collection_complete_1", "Completionist", "Complete a collection (10+ puzzles)", "collection", "collections", None, 1),
    ("collection_complete_3", "Collector", "Complete 3 collections (10+ puzzles)", "collection", "collections", None, 3),
]
MILESTONES = [1, 3, 10, 30, 50, 100, 200, 500]
DEFINITION = "id string, name string, description string, category string, metric string, key int, threshold int"
#: Joined rows that a completed collection needs (counted before distinct).
COLLECTION_ROWS = 10


def question_flags(attempts: DataFrame) -> DataFrame:
    """(player, question, done): one row per pair, so later counts need no distinct."""
    return attempts.groupBy("player", "question").agg(F.max(F.col("finished_at").isNotNull()).alias("done"))


def question_stats(players: DataFrame, types: DataFrame, questions: DataFrame, attempts: DataFrame) -> DataFrame:
    """Questions, solved and tried ones per player and type, also where nothing was attempted."""
    kind = questions.select(F.col("id").alias("question"), "puzzle_type")
    totals = kind.groupBy("puzzle_type").agg(F.count("*").alias("total"))
    facts = question_flags(attempts).join(kind, "question").groupBy("player", "puzzle_type").agg(F.count_if("done").alias("solved"), F.count_if(~F.col("done")).alias("tried"))
    # Dimensions only: as many rows as the result has.
    grid = every_pair(players.select(F.col("id").alias("player")), types.select(F.col("id").alias("puzzle_type"), F.col("name").alias("type_name")))
    zero = F.lit(0).cast("long")
    return (
        grid.join(totals, "puzzle_type", "left")
        .join(facts, ["player", "puzzle_type"], "left")
        .select("player", F.col("puzzle_type").alias("type_id"), "type_name", *[F.coalesce(c, zero).alias(c) for c in ("total", "solved", "tried")])
        .orderBy("player", "type_name")
    )


def collection_stats(players: DataFrame, types: DataFrame, collections: DataFrame, questions: DataFrame, attempts: DataFrame) -> DataFrame:
    """Questions and solved ones per player, collection and type, also where nothing was solved."""
    inside = questions.filter("src_collection is not null").select(F.col("id").alias("question"), "src_collection", "puzzle_type")
    names = collections.select(F.col("id").alias("src_collection"), F.col("name").alias("collection_name"))
    kinds = types.select(F.col("id").alias("puzzle_type"), F.col("name").alias("type_name"))
    totals = inside.groupBy("src_collection", "puzzle_type").agg(F.count("*").alias("total")).join(names, "src_collection").join(kinds, "puzzle_type")
    solved = question_flags(attempts).filter("done").join(inside, "question").groupBy("player", "src_collection", "puzzle_type").agg(F.count("*").alias("solved"))
    return (
        every_pair(players.select(F.col("id").alias("player")), totals)
        .join(solved, ["player", "src_collection", "puzzle_type"], "left")
        .select("player", F.col("src_collection").alias("collection_id"), "collection_name", F.col("puzzle_type").alias("type_id"), "type_name", "total", F.coalesce("solved", F.lit(0).cast("long")).alias("solved"))
    )


def collection_groups(stats: DataFrame) -> DataFrame:
    """One row per player and collection with totals and the list of types."""
    each = F.struct("type_name", "total", "solved")
    return stats.groupBy("player", "collection_id", "collection_name").agg(F.sum("total").alias("total"), F.sum("solved").alias("solved"), F.sort_array(F.collect_list(each)).alias("types"))


def collection_counts(collections: DataFrame, questions: DataFrame) -> DataFrame:
    """Collections with the number of their questions, none counted as 0."""
    n = questions.groupBy(F.col("src_collection").alias("id")).agg(F.count("*").alias("puzzle_count"))
    return collections.join(n, "id", "left").withColumn("puzzle_count", F.coalesce("puzzle_count", F.lit(0).cast("long"))).orderBy("id")


def group_by_type(questions: DataFrame, types: DataFrame) -> DataFrame:
    """Questions per collection and type."""
    n = questions.groupBy("src_collection", "puzzle_type").agg(F.count("*").alias("n"))
    return n.join(types.select(F.col("id").alias("puzzle_type"), F.col("name").alias("type_name")), "puzzle_type").select("src_collection", "puzzle_type", "type_name", "n")


def solved_by_type_difficulty(questions: DataFrame, attempts: DataFrame) -> DataFrame:
    kind = questions.select(F.col("id").alias("question"), "puzzle_type", "difficulty")
    return question_flags(attempts).filter("done").join(kind, "question").groupBy("player", "puzzle_type", "difficulty").agg(F.count("*").alias("solved"))


def player_stats(solved: DataFrame) -> DataFrame:
    """Totals and maps by type and difficulty; a question has one of each, so sums are exact."""

    def by(column: str) -> DataFrame:
        each = solved.groupBy("player", column).agg(F.sum("solved").alias("n"))
        entries = F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(column), F.col("n")))))
        return each.groupBy("player").agg(entries.alias(f"by_{column}"), F.sum("n").alias("total"), F.count("*").alias("kinds"))

    types = by("puzzle_type").select("player", F.col("total").alias("total_solved"), F.col("by_puzzle_type").alias("solved_by_type"), F.col("kinds").alias("types_with_solves"))
    return types.join(by("difficulty").select("player", F.col("by_difficulty").alias("solved_by_difficulty")), "player")


def player_stats_flat(solved: DataFrame) -> DataFrame:
    """The same as rows, by grouping sets."""
    sets = [["player"], ["player", "puzzle_type"], ["player", "difficulty"]]
    return solved.groupingSets(sets, "player", "puzzle_type", "difficulty").agg(F.sum("solved").alias("solved"))


def completed_collections(membership: DataFrame, attempts: DataFrame, min_rows: int = COLLECTION_ROWS, strict: bool = False) -> DataFrame:
    """(player, collection) with all questions of ``membership`` (question, collection) solved.

    ``min_rows`` counts rows after the join to finished attempts; ``strict`` counts questions.
    """
    size = membership.groupBy("collection").agg(F.count("*").alias("size"))
    finished = attempts.filter("finished_at is not null").groupBy("player", "question").agg(F.count("*").alias("n"))
    got = finished.join(membership, "question").groupBy("player", "collection").agg(F.sum("n").alias("rows"), F.count("*").alias("solved")).join(size, "collection")
    enough = F.col("size") >= min_rows if strict else F.col("rows") >= min_rows
    return got.filter((F.col("solved") == F.col("size")) & enough).select("player", "collection", "rows", "solved")


def plural(n: Column) -> Column:
    return F.when(n > 1, "s").otherwise("")


def achievement_definitions(spark: SparkSession, types: DataFrame) -> DataFrame:
    """Static definitions and one per type and milestone."""
    fixed = spark.createDataFrame(STATIC_DEFINITIONS, DEFINITION)
    n = spark.createDataFrame([(m,) for m in MILESTONES], "n int")
    each = types.crossJoin(F.broadcast(n)).select(
        F.concat(F.lit("type_"), F.col("id"), F.lit("_solved_"), "n").alias("id"),
        F.concat("name", F.lit(" x"), "n").alias("name"),
        F.concat(F.lit("Solve "), "n", F.lit(" "), "name", F.lit(" puzzle"), plural(F.col("n"))).alias("description"),
        F.lit("type").alias("category"),
        F.lit("type").alias("metric"),
        F.col("id").alias("key"),
        F.col("n").alias("threshold"),
    )
    return fixed.unionByName(each)


def metrics(solved: DataFrame, completed: DataFrame) -> DataFrame:
    """(player, metric, key, value): all statistics that definitions test, as rows."""
    none = F.lit(None).cast("int")
    by_type = solved.groupBy("player", "puzzle_type").agg(F.sum("solved").alias("value"))
    long = by_type.select("player", F.lit("type").alias("metric"), F.col("puzzle_type").alias("key"), "value")
    wide = solved.groupBy("player").agg(
        F.sum("solved").alias("total"),
        F.count_distinct("puzzle_type").alias("types"),
        F.sum(F.when(F.col("difficulty") >= 4, F.col("solved")).otherwise(0)).alias("hard"),
        F.sum(F.when(F.col("difficulty") == 5, F.col("solved")).otherwise(0)).alias("superhard"),
    )
    rows = wide.unpivot(["player"], ["total", "types", "hard", "superhard"], "metric", "value").select("player", "metric", none.alias("key"), "value")
    whole = completed.groupBy("player").agg(F.count("*").alias("value")).select("player", F.lit("collections").alias("metric"), none.alias("key"), "value")
    return long.unionByName(rows).unionByName(whole)


def evaluate_achievements(values: DataFrame, definitions: DataFrame) -> DataFrame:
    """(player, achievement_id) for every definition whose threshold is reached."""
    wanted = definitions.select(F.col("id").alias("achievement_id"), "metric", F.coalesce("key", F.lit(-1)).alias("key"), "threshold")
    return values.withColumn("key", F.coalesce("key", F.lit(-1))).join(wanted, ["metric", "key"]).filter("value >= threshold").select("player", "achievement_id")


def not_yet_unlocked(reached: DataFrame, existing: DataFrame) -> DataFrame:
    return reached.join(existing.select("player", "achievement_id"), ["player", "achievement_id"], "left_anti")


def player_x_definition(players: DataFrame, definitions: DataFrame, unlocked: DataFrame) -> DataFrame:
    """Every player against every definition; the result itself has that many rows."""
    grid = every_pair(players.select(F.col("id").alias("player")), definitions.select(F.col("id").alias("achievement_id"), "category"))
    have = unlocked.select("player", "achievement_id").withColumn("unlocked", F.lit(True))
    return grid.join(have, ["player", "achievement_id"], "left").withColumn("unlocked", F.coalesce("unlocked", F.lit(False)))


def achievement_progress(grid: DataFrame) -> DataFrame:
    return grid.groupBy("player").agg(F.count_if("unlocked").alias("unlocked"), F.count("*").alias("total"))


def latest_snapshot(snapshots: DataFrame) -> DataFrame:
    """The newest snapshot of every attempt; equal times by the larger id.

    An aggregate, not a window: it combines before the shuffle, whatever an
    attempt's number of snapshots.
    """
    rest = [c for c in snapshots.columns if c != "attempt"]
    newest = F.max_by(F.struct(*rest), F.struct("created_at", "id")).alias("s")
    return snapshots.groupBy("attempt").agg(newest).select("attempt", "s.*")


def attempts_with_latest(attempts: DataFrame, snapshots: DataFrame) -> DataFrame:
    """Attempts with progress and time of their newest snapshot, newest first."""
    last = latest_snapshot(snapshots).select(F.col("attempt").alias("id"), "progress", "elapsed_seconds", F.col("created_at").alias("snapshot_at"))
    return attempts.join(last, "id", "left").orderBy(F.desc("created_at"), F.desc("id"))
