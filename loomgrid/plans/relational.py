"""Queries over catalogue and play tables: name to (function of Tables, SQL after the common tables)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.functions import scalars as fn
from loomgrid.operators import catalog as cat
from loomgrid.operators import stats
from loomgrid.sources.analog import Tables


def view(t: Tables) -> DataFrame:
    return cat.puzzle_view(t.questions, t.types, t.collections)


VIEW = """SELECT q.id, q.puzzle_type, q.title, q.author, q.difficulty, q.width, q.height, q.src_collection, q.created_at,
  t.name AS type_name, c.name AS collection_name, c.cover_src
FROM questions q JOIN types t ON t.id = q.puzzle_type LEFT JOIN collections c ON c.id = q.src_collection"""
SOLVED = """SELECT player, puzzle_type, difficulty, count(DISTINCT question) AS solved
FROM attempts a JOIN questions q ON q.id = a.question WHERE finished_at IS NOT NULL GROUP BY ALL"""
#: Membership of the completion analog: groups of six questions, players folded to ten.
FOLDED = """folded AS (SELECT player % 10 AS player, question, finished_at FROM attempts),
membership AS (SELECT id AS question, id // 6 AS collection FROM questions)"""
COMPLETED = """SELECT s.player, s.collection, s.rows, s.solved FROM (
  SELECT player, collection, count(*) AS rows, count(DISTINCT question) AS solved
  FROM folded JOIN membership USING (question) WHERE finished_at IS NOT NULL GROUP BY ALL) s
JOIN (SELECT collection, count(*) AS size FROM membership GROUP BY ALL) z USING (collection)
WHERE solved = size AND rows >= 10"""
DEFINITIONS = (
    "SELECT * FROM (VALUES "
    + ", ".join("(" + ", ".join("CAST(NULL AS INTEGER)" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in d) + ")" for d in stats.STATIC_DEFINITIONS)
    + ") v(id, name, description, category, metric, key, threshold) UNION ALL SELECT 'type_' || id || '_solved_' || n, name || ' x' || n,"
    + " 'Solve ' || n || ' ' || name || ' puzzle' || CASE WHEN n > 1 THEN 's' ELSE '' END, 'type', 'type', id, n"
    + f" FROM types, (SELECT unnest({stats.MILESTONES}) AS n)"
)
REACHED = f"""solved AS ({SOLVED}), {FOLDED}, completed AS ({COMPLETED}), definitions AS ({DEFINITIONS}),
vals AS (
  SELECT player, 'type' AS metric, puzzle_type AS key, sum(solved) AS value FROM solved GROUP BY ALL
  UNION ALL SELECT player, 'total', -1, sum(solved) FROM solved GROUP BY ALL
  UNION ALL SELECT player, 'types', -1, count(DISTINCT puzzle_type) FROM solved GROUP BY ALL
  UNION ALL SELECT player, 'hard', -1, sum(solved) FILTER (difficulty >= 4) FROM solved GROUP BY ALL
  UNION ALL SELECT player, 'superhard', -1, sum(solved) FILTER (difficulty = 5) FROM solved GROUP BY ALL
  UNION ALL SELECT player, 'collections', -1, count(*) FROM completed GROUP BY ALL),
reached AS (SELECT player, d.id AS achievement_id FROM vals v JOIN definitions d ON d.metric = v.metric AND coalesce(d.key, -1) = v.key WHERE value >= threshold)"""


def folded(t: Tables) -> DataFrame:
    return t.attempts.withColumn("player", F.col("player") % 10)


def membership(t: Tables) -> DataFrame:
    return t.questions.select(F.col("id").alias("question"), F.expr("id div 6").alias("collection"))


def solved(t: Tables) -> DataFrame:
    return stats.solved_by_type_difficulty(t.questions, t.attempts)


def definitions(t: Tables) -> DataFrame:
    return stats.achievement_definitions(t.spark, t.types)


def reached(t: Tables) -> DataFrame:
    whole = stats.completed_collections(membership(t), folded(t))
    return stats.evaluate_achievements(stats.metrics(solved(t), whole), definitions(t))


def unlocked(t: Tables) -> DataFrame:
    """Players with an even id have had theirs; odd ones are still to be unlocked."""
    return reached(t).filter("player % 2 = 0")


def odd_questions(t: Tables) -> DataFrame:
    return t.questions.filter("difficulty >= 4").select(F.col("id").alias("question"))


SCANNED = ("types", "collections", "players", "questions", "attempts", "attempt_list", "snapshots", "player_achievement")

QUERIES = {
    "scan_tables": (
        lambda t: reduce(DataFrame.unionByName, [(unlocked(t) if n == "player_achievement" else getattr(t, n)).select(F.lit(n).alias("name")).groupBy("name").count().withColumnRenamed("count", "n") for n in SCANNED]),
        f", {REACHED}, player_achievement AS (SELECT * FROM reached WHERE player % 2 = 0) " + " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in SCANNED),
    ),
    "puzzle_view": (view, VIEW),
    "camel_columns": (
        lambda t: cat.camel_columns(view(t).select("id", "puzzle_type", "type_name", "src_collection", "cover_src")),
        f'SELECT id, puzzle_type AS "puzzleType", type_name AS "typeName", src_collection AS "srcCollection", cover_src AS "coverSrc" FROM ({VIEW})',
    ),
    "list_puzzles": (lambda t: cat.list_puzzles(view(t), puzzle_type=2, src_collection=7), f"SELECT * FROM ({VIEW}) WHERE puzzle_type = 2 AND src_collection = 7"),
    "uncollected": (lambda t: cat.list_puzzles(view(t), src_collection=cat.NONE), f"SELECT * FROM ({VIEW}) WHERE src_collection IS NULL"),
    "get_puzzle": (lambda t: cat.by_id(view(t), 42), f"SELECT * FROM ({VIEW}) WHERE id = 42"),
    "attempts_open_or_done": (
        lambda t: cat.attempts_open_or_done(t.attempt_list).withColumn("state", F.lit("open")).unionByName(cat.attempts_open_or_done(t.attempt_list, True).withColumn("state", F.lit("done"))),
        "SELECT *, CASE WHEN finished_at IS NULL THEN 'open' ELSE 'done' END AS state FROM attempt_list",
    ),
    "snapshot_by_id": (lambda t: cat.by_id(t.snapshots, 77), "SELECT * FROM snapshots WHERE id = 77"),
    "attempt_history": (lambda t: cat.snapshot_listing(t.snapshots), "SELECT id, attempt, progress, elapsed_seconds, finished, created_at FROM snapshots"),
    "list_types": (lambda t: t.types.orderBy("id"), "SELECT * FROM types"),
    "required_fields": (
        lambda t: cat.required_fields(t.questions.select("id", "title", "author"), ["id", "title", "author"]),
        "SELECT id, title, author, CASE WHEN title IS NULL THEN 'title is required' WHEN author IS NULL THEN 'author is required' END AS reason FROM questions",
    ),
    "blank_to_null": (
        lambda t: t.questions.select("id", cat.blank_to_null(F.coalesce("title", F.lit(""))).alias("title"), cat.zero_to_null(F.coalesce("src_collection", F.lit(0))).alias("src_collection")),
        "SELECT id, title, src_collection FROM questions",
    ),
    "display_defaults": (
        lambda t: cat.display_defaults(view(t)),
        f"SELECT id, coalesce(title, 'Untitled') AS title, coalesce(author, 'N/A') AS author, coalesce(collection_name, '(none)') AS collection_name, type_name, coalesce(width, 0) AS width FROM ({VIEW})",
    ),
    "join_type": (lambda t: cat.join_type(t.questions, t.types).select("id", "type_name"), "SELECT q.id, t.name AS type_name FROM questions q JOIN types t ON t.id = q.puzzle_type"),
    "join_collection_left": (
        lambda t: cat.join_collection_left(t.questions, t.collections).select("id", "collection_name", "cover_src"),
        "SELECT q.id, c.name AS collection_name, c.cover_src FROM questions q LEFT JOIN collections c ON c.id = q.src_collection",
    ),
    "left_join_on_filtered": (
        lambda t: t.questions.select("id").join(t.attempts.filter("finished_at is not null").select(F.col("question").alias("id"), "player"), "id", "left"),
        "SELECT q.id, a.player FROM questions q LEFT JOIN attempts a ON a.question = q.id AND a.finished_at IS NOT NULL",
    ),
    "solved_exists": (
        lambda t: stats.question_flags(t.attempts).groupBy("player").agg(F.count_if("done").alias("solved")),
        "SELECT p.player, count(DISTINCT CASE WHEN EXISTS (SELECT 1 FROM attempts a WHERE a.question = p.question AND a.player = p.player AND a.finished_at IS NOT NULL) THEN p.question END) AS solved FROM attempts p GROUP BY p.player",
    ),
    "tried_not_exists": (
        lambda t: stats.question_flags(t.attempts).filter("not done").select("player", "question"),
        "SELECT DISTINCT player, question FROM attempts p WHERE NOT EXISTS (SELECT 1 FROM attempts a WHERE a.question = p.question AND a.player = p.player AND a.finished_at IS NOT NULL)",
    ),
    "attempts_with_latest": (
        lambda t: stats.attempts_with_latest(t.attempt_list, t.snapshots),
        """SELECT a.*, s.progress, s.elapsed_seconds, s.created_at AS snapshot_at FROM attempt_list a LEFT JOIN (
           SELECT * FROM snapshots QUALIFY row_number() OVER (PARTITION BY attempt ORDER BY created_at DESC, id DESC) = 1) s ON s.attempt = a.id""",
    ),
    "latest_snapshot": (
        lambda t: stats.latest_snapshot(t.snapshots),
        "SELECT * FROM snapshots QUALIFY row_number() OVER (PARTITION BY attempt ORDER BY created_at DESC, id DESC) = 1",
    ),
    "name_lookup": (
        lambda t: cat.name_lookup(t.questions.select("id", "puzzle_type"), t.types.filter("id <> 3"), "puzzle_type", "Type "),
        "SELECT q.id, q.puzzle_type, coalesce(t.name, 'Type ' || q.puzzle_type) AS label FROM questions q LEFT JOIN types t ON t.id = q.puzzle_type AND t.id <> 3",
    ),
    "player_x_type": (
        lambda t: stats.question_stats(t.players, t.types, t.questions, t.attempts).select("player", "type_id", "solved"),
        """SELECT p.id AS player, t.id AS type_id, count(DISTINCT a.question) AS solved FROM players p CROSS JOIN types t
           LEFT JOIN (SELECT player, question, puzzle_type FROM attempts JOIN questions q ON q.id = question WHERE finished_at IS NOT NULL) a ON a.player = p.id AND a.puzzle_type = t.id GROUP BY ALL""",
    ),
    "question_stats": (
        lambda t: stats.question_stats(t.players, t.types, t.questions, t.attempts),
        """, flags AS (SELECT player, question, bool_or(finished_at IS NOT NULL) AS done FROM attempts GROUP BY ALL)
           SELECT p.id AS player, t.id AS type_id, t.name AS type_name, n.total, count(DISTINCT f.question) FILTER (done) AS solved, count(DISTINCT f.question) FILTER (NOT done) AS tried
           FROM players p CROSS JOIN types t JOIN (SELECT puzzle_type, count(*) AS total FROM questions GROUP BY ALL) n ON n.puzzle_type = t.id
           LEFT JOIN (SELECT f.*, puzzle_type FROM flags f JOIN questions q ON q.id = f.question) f ON f.player = p.id AND f.puzzle_type = t.id GROUP BY ALL""",
    ),
    "collection_stats": (
        lambda t: stats.collection_stats(t.players, t.types, t.collections, t.questions, t.attempts),
        """, done AS (SELECT DISTINCT player, question, src_collection, puzzle_type FROM attempts a JOIN questions q ON q.id = a.question WHERE finished_at IS NOT NULL AND src_collection IS NOT NULL)
           SELECT p.id AS player, c.id AS collection_id, c.name AS collection_name, t.id AS type_id, t.name AS type_name, n.total, count(d.question) AS solved
           FROM players p CROSS JOIN (SELECT src_collection, puzzle_type, count(*) AS total FROM questions GROUP BY ALL) n
           JOIN collections c ON c.id = n.src_collection JOIN types t ON t.id = n.puzzle_type
           LEFT JOIN done d ON d.player = p.id AND d.src_collection = n.src_collection AND d.puzzle_type = n.puzzle_type GROUP BY ALL""",
    ),
    "collection_groups": (
        lambda t: stats.collection_groups(stats.collection_stats(t.players, t.types, t.collections, t.questions, t.attempts)).withColumn("types", F.array_join(F.transform("types", lambda x: F.concat_ws(":", x["type_name"], x["total"], x["solved"])), ",")),
        """, done AS (SELECT DISTINCT player, question, src_collection, puzzle_type FROM attempts a JOIN questions q ON q.id = a.question WHERE finished_at IS NOT NULL AND src_collection IS NOT NULL),
           each AS (SELECT p.id AS player, c.id AS collection_id, c.name AS collection_name, t.name AS type_name, n.total, count(d.question) AS solved
           FROM players p CROSS JOIN (SELECT src_collection, puzzle_type, count(*) AS total FROM questions GROUP BY ALL) n
           JOIN collections c ON c.id = n.src_collection JOIN types t ON t.id = n.puzzle_type
           LEFT JOIN done d ON d.player = p.id AND d.src_collection = n.src_collection AND d.puzzle_type = n.puzzle_type GROUP BY ALL)
           SELECT player, collection_id, collection_name, CAST(sum(total) AS BIGINT) AS total, CAST(sum(solved) AS BIGINT) AS solved, string_agg(type_name || ':' || total || ':' || solved, ',' ORDER BY type_name) AS types FROM each GROUP BY ALL""",
    ),
    "collection_counts": (
        lambda t: stats.collection_counts(t.collections, t.questions),
        "SELECT c.*, count(q.id) AS puzzle_count FROM collections c LEFT JOIN questions q ON q.src_collection = c.id GROUP BY ALL",
    ),
    "group_by_type": (
        lambda t: stats.group_by_type(t.questions, t.types),
        "SELECT src_collection, puzzle_type, t.name AS type_name, count(*) AS n FROM questions q JOIN types t ON t.id = q.puzzle_type GROUP BY ALL",
    ),
    "solved_by_type_difficulty": (solved, SOLVED),
    "player_stats": (
        lambda t: stats.player_stats(solved(t)).withColumns({c: F.to_json(c) for c in ("solved_by_type", "solved_by_difficulty")}),
        f""", solved AS ({SOLVED}),
           a AS (SELECT player, CAST(sum(n) AS BIGINT) AS total_solved, '{{' || string_agg('"' || k || '":' || n, ',' ORDER BY k) || '}}' AS solved_by_type, count(*) AS types_with_solves
                 FROM (SELECT player, puzzle_type AS k, CAST(sum(solved) AS BIGINT) AS n FROM solved GROUP BY ALL) GROUP BY ALL),
           b AS (SELECT player, '{{' || string_agg('"' || k || '":' || n, ',' ORDER BY k) || '}}' AS solved_by_difficulty
                 FROM (SELECT player, difficulty AS k, CAST(sum(solved) AS BIGINT) AS n FROM solved GROUP BY ALL) GROUP BY ALL)
           SELECT * FROM a JOIN b USING (player)""",
    ),
    "player_stats_flat": (
        lambda t: stats.player_stats_flat(solved(t)),
        f", solved AS ({SOLVED}) SELECT player, puzzle_type, difficulty, CAST(sum(solved) AS BIGINT) AS solved FROM solved GROUP BY GROUPING SETS ((player), (player, puzzle_type), (player, difficulty))",
    ),
    "completed_collections": (lambda t: stats.completed_collections(membership(t), folded(t)), f", {FOLDED} {COMPLETED}"),
    "achievement_definitions": (definitions, DEFINITIONS),
    "evaluate_achievements": (reached, f", {REACHED} SELECT * FROM reached"),
    "not_yet_unlocked": (lambda t: stats.not_yet_unlocked(reached(t), unlocked(t)), f", {REACHED} SELECT * FROM reached WHERE player % 2 <> 0"),
    "player_x_definition": (
        lambda t: stats.player_x_definition(t.players, definitions(t), unlocked(t)),
        f""", {REACHED} SELECT p.id AS player, d.id AS achievement_id, d.category, r.player IS NOT NULL AS unlocked FROM players p CROSS JOIN definitions d
            LEFT JOIN (SELECT * FROM reached WHERE player % 2 = 0) r ON r.player = p.id AND r.achievement_id = d.id""",
    ),
    "achievement_progress": (
        lambda t: stats.achievement_progress(stats.player_x_definition(t.players, definitions(t), unlocked(t))),
        f""", {REACHED} SELECT p.id AS player, count(r.player) AS unlocked, (SELECT count(*) FROM definitions) AS total FROM players p
            LEFT JOIN (SELECT * FROM reached WHERE player % 2 = 0) r ON r.player = p.id GROUP BY ALL""",
    ),
    "recent_puzzles": (lambda t: cat.list_puzzles(view(t), limit=10), f"SELECT * FROM ({VIEW}) ORDER BY created_at DESC, id DESC LIMIT 10"),
    "sort_puzzles": (
        lambda t: cat.sort_puzzles(t.questions, "size", True).select("id", "title", cat.sort_key("size").alias("size")),
        "SELECT id, title, coalesce(width, 0) * coalesce(height, 0) AS size FROM questions ORDER BY size DESC, id",
    ),
    "collections_by_date": (lambda t: cat.collections_by_date(t.collections), "SELECT * FROM collections ORDER BY publish_at DESC NULLS LAST, id"),
    "stats_order": (
        lambda t: stats.collection_stats(t.players, t.types, t.collections, t.questions, t.attempts).orderBy("player", "collection_name", "type_name").select("player", "collection_name", "type_name"),
        """SELECT p.id AS player, c.name AS collection_name, t.name AS type_name FROM players p CROSS JOIN (SELECT DISTINCT src_collection, puzzle_type FROM questions) q
           JOIN collections c ON c.id = q.src_collection JOIN types t ON t.id = q.puzzle_type ORDER BY 1, 2, 3""",
    ),
    "solved_subset": (
        lambda t: cat.solved_subset(t.attempts, odd_questions(t)),
        "SELECT DISTINCT player, question FROM attempts WHERE finished_at IS NOT NULL AND question IN (SELECT id FROM questions WHERE difficulty >= 4)",
    ),
    "format_elapsed": (
        lambda t: t.snapshots.select("id", fn.format_elapsed(F.col("elapsed_seconds")).alias("elapsed")),
        "SELECT id, printf('%02d:%02d:%02d', elapsed_seconds // 3600, elapsed_seconds // 60 % 60, elapsed_seconds % 60) AS elapsed FROM snapshots",
    ),
    "difficulty_label": (
        lambda t: t.questions.select("id", fn.difficulty_label(F.col("difficulty")).alias("label"), fn.star_bar(F.col("difficulty")).alias("stars")),
        "SELECT id, CASE difficulty " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in fn.DIFFICULTY.items()) + " END AS label, repeat('★', difficulty) || repeat('☆', 5 - difficulty) AS stars FROM questions",
    ),
    "percent_round": (
        lambda t: t.snapshots.select("id", fn.percent_round(F.col("progress")).alias("percent")),
        "SELECT id, CAST(floor(progress * 100 + 0.5) AS BIGINT) AS percent FROM snapshots",
    ),
    "percent_text": (
        lambda t: t.snapshots.select("id", fn.percent_text(F.col("progress") * 100).alias("percent")),
        "SELECT id, (CAST(floor(progress * 100 * 10 + 0.5) AS BIGINT) // 10) || '.' || (CAST(floor(progress * 100 * 10 + 0.5) AS BIGINT) % 10) || ' %' AS percent FROM snapshots",
    ),
    "board_area": (
        lambda t: t.questions.select("id", fn.board_area(F.nullif("width", F.lit(7)), F.col("height")).alias("area")),
        "SELECT id, coalesce(nullif(width, 7), 0) * height AS area FROM questions",
    ),
    "parse_value_key": (
        lambda t: t.questions.select("id", fn.parse_value_key(F.when(F.col("id") % 3 == 0, F.concat("width", F.lit(","), "height")).when(F.col("id") % 3 == 1, F.concat(F.lit("h:"), "width", F.lit(","), "height")).otherwise(F.lit("bad"))).alias("k")).select("id", "k.*"),
        "SELECT id, CASE id % 3 WHEN 0 THEN 'cell' WHEN 1 THEN 'h' END AS layer, CASE id % 3 WHEN 0 THEN height WHEN 1 THEN width END AS r, CASE id % 3 WHEN 0 THEN width WHEN 1 THEN height END AS c FROM questions",
    ),
    "strip_fences_json": (
        lambda t: t.read("conversations").select(
            "conv_id", "turn", F.from_json(fn.strip_fences(F.when(F.col("turn") % 2 == 0, F.concat(F.lit("```json\n[["), "conv_id", F.lit(", "), "turn", F.lit("]]\n```"))).otherwise(F.col("text"))), "array<array<bigint>>")[0].alias("cells")
        ).select("conv_id", "turn", F.get("cells", F.lit(0)).alias("a"), F.get("cells", F.lit(1)).alias("b")),
        "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN conv_id END AS a, CASE WHEN turn % 2 = 0 THEN turn END AS b FROM conversations",
    ),
    "slug": (lambda t: t.questions.select("id", fn.slug(F.concat(F.lower(F.col("author")), F.lit("_x"))).alias("slug")), "SELECT id, replace(lower(author) || '_x', '_', '-') AS slug FROM questions"),
    "file_parts": (
        lambda t: t.collections.select("id", fn.file_parts(F.upper("cover_src")).alias("f")).select("id", "f.*"),
        "SELECT id, CASE WHEN cover_src IS NOT NULL THEN id || '.PNG' END AS name, CASE WHEN cover_src IS NOT NULL THEN 'png' ELSE '' END AS extension FROM collections",
    ),
    "milestone_text": (lambda t: definitions(t).filter("category = 'type'").select("id", "name", "description"), f"SELECT id, name, description FROM ({DEFINITIONS}) WHERE category = 'type'"),
    "parse_clue_text": (
        lambda t: t.questions.select("id", F.array_join(fn.parse_clue_text(F.when(F.col("id") % 4 == 0, "").when(F.col("id") % 4 == 1, F.concat("width", F.lit(", x -3 "), "height")).otherwise(F.col("height").cast("string"))), " ").alias("clue")),
        "SELECT id, CASE id % 4 WHEN 0 THEN '0' WHEN 1 THEN width || ' ' || height ELSE CAST(height AS VARCHAR) END AS clue FROM questions",
    ),
}
