"""Queries of the writing jobs and of the feeds: name to (function of Tables, SQL)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.operators import ingest, stats
from loomgrid.plans.boards import verdict_sql
from loomgrid.plans.relational import REACHED, definitions, membership
from loomgrid.sources import boards, tables
from loomgrid.sources.analog import CTE, Tables
from loomgrid.streaming import feeds


def candidates(t: Tables):
    docs = boards.documents(t, "slitherlink").withColumnRenamed("board_id", "id")
    return t.questions.select("id", "title", "author", "difficulty", F.coalesce("src_collection", F.lit(0)).alias("src_collection")).join(docs, "id").withColumn("puzzle_type", F.when(F.col("id") % 9 != 0, 5))


CREATED = f"""SELECT id, CASE WHEN id % 9 = 0 THEN 'puzzle_type is required' ELSE nullif(reasons, '') END AS reason
FROM questions JOIN ({verdict_sql('slitherlink')}) ON board_id = id"""


def patched(t: Tables):
    """Questions of type 5 after patches of several fields, boards included; refused patches have their reason."""
    questions = t.questions.withColumns({"puzzle_type": F.lit(5), "canon_repr": F.lit('{"cells":[[0]]}')})
    drawn = F.concat(F.lit('{"difficulty":2,"canonRepr":'), F.when(F.col("id") % 3 == 0, '{"cells":[[0,9]]}').otherwise('{"cells":[[0,1,2],[3,-1,0]]}'), F.lit("}"))
    text = F.when(F.col("id") % 4 == 0, F.lit('{"title":"","difficulty":5}')).when(F.col("id") % 4 == 2, F.concat(F.lit('{"author":"A'), "id", F.lit('","src_collection":0}'))).when(F.col("id") % 8 == 1, drawn).otherwise(F.lit('{"other":1}'))
    patches = questions.filter("id % 8 <> 3").select("id", text.alias("patch"))
    now, refused = ingest.bulk_patch(questions, patches.unionByName(patches.filter("id % 100 = 6").withColumn("id", -F.col("id"))))
    return now.select("id", "title", "author", "difficulty", "width", "height", "src_collection", "canon_repr").join(refused, "id", "full")


def seeded(t: Tables):
    """Types, accounts and puzzles after they were seeded twice."""
    folder = tables.shared_folder(t.spark, "seed")
    dimensions = {"puzzle_types": t.types, "player_account": t.players, "puzzle_questions": t.questions.select("id", F.col("title").alias("name"))}
    ingest.reset_and_seed({k: v.filter("id % 2 = 0") for k, v in dimensions.items()}, folder)
    made = ingest.reset_and_seed(dimensions, folder)
    return reduce(DataFrame.unionByName, [rows.select(F.lit(name).alias("name"), F.col("id").cast("long").alias("id"), F.col("name").alias("label")) for name, rows in made.items()])


def deleted(t: Tables):
    ids = t.questions.filter("id % 10 = 3").select("id")
    stay, blocked = ingest.bulk_delete(t.questions, ids, t.attempts)
    return stay.select("id", F.lit("stays").alias("state")).unionByName(blocked.select("id", F.lit("blocked").alias("state")))


def latest(t: Tables):
    feed = t.spark.readStream.schema(t.read("events").schema).option("pathGlobFilter", "*.parquet").parquet(f"{t.sf_dir}/events*.parquet")
    rows = feed.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("attempt"), F.least(F.col("value") / 500, F.lit(1.0)).alias("progress"), F.floor(F.col("value") * 60).cast("int").alias("elapsed_seconds"), (F.col("event_type") == "purchase").alias("finished"), F.col("ts").alias("created_at")
    )
    return feeds.stream_latest_snapshot(rows, tables.shared_folder(t.spark, "latest"), "60 days")


def achieved(t: Tables, attempts):
    """(player, achievement_id) of all definitions; collections are completed by players folded to ten."""
    whole = stats.completed_collections(membership(t), attempts.withColumn("player", F.col("player") % 10))
    return stats.evaluate_achievements(stats.metrics(stats.solved_by_type_difficulty(t.questions, attempts), whole), definitions(t))


def finishes(t: Tables, lines):
    """Finished attempts with what is known of their questions; each once for its player, and once for one of ten further players."""
    orders = t.read("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("player"))
    inside = membership(t)
    known = t.questions.select(F.col("id").alias("question"), "puzzle_type", "difficulty").join(inside, "question").join(inside.groupBy("collection").agg(F.count("*").alias("size")), "collection")
    own = lines.filter("l_linestatus = 'F' and l_shipdate is not null").join(orders, "l_orderkey").select(F.explode(F.array("player", -1 - F.col("player") % 10)).alias("player"), F.col("l_partkey").alias("question"))
    return own.join(known, "question")


def unlocks(t: Tables):
    feed = t.spark.readStream.schema(t.read("lineitem").schema).parquet(f"{t.sf_dir}/lineitem*.parquet")
    return feeds.stream_unlocks(finishes(t, feed), definitions(t), tables.shared_folder(t.spark, "unlocks"))


#: Achievements of the players and of ten further ones.
DOUBLED = "doubled AS (SELECT player, question, finished_at FROM attempts UNION ALL SELECT -1 - player % 10, question, finished_at FROM attempts)"
REACHED_BY_FEED = f"{DOUBLED}, " + REACHED.replace("FROM attempts a", "FROM doubled a").replace("SELECT player % 10 AS player, question, finished_at FROM attempts", "SELECT player, question, finished_at FROM doubled")
QUERIES = {
    "image_manifest": (
        lambda t: tables.image_manifest(t.questions.select(F.when(F.col("id") % 3 == 0, F.concat(F.lit("__MACOSX/"), "id", F.lit(".png"))).when(F.col("id") % 3 == 1, F.concat(F.lit("a/"), "id", F.lit(".PNG"))).otherwise(F.concat("id", F.lit(".txt"))).alias("path"))),
        CTE + """, w AS (SELECT 'a/' || id || '.PNG' AS path, id || '.PNG' AS name FROM questions WHERE id % 3 = 1),
          k AS (SELECT *, row_number() OVER (ORDER BY path) - 1 AS k, count(*) OVER () > 50 AS truncated FROM w)
          SELECT k || '-' || name AS id, path, truncated FROM k WHERE k < 50""",
    ),
    "bulk_create_puzzles": (
        lambda t: ingest.bulk_create(candidates(t)).select("id", "reason", "status", "title", "src_collection", "width", "height"),
        CTE + f"""SELECT q.id, reason, CASE WHEN reason IS NULL THEN 'created' ELSE 'failed' END AS status, title, src_collection,
          CASE WHEN reason IS NULL THEN 2 END AS width, CASE WHEN reason IS NULL THEN 2 END AS height FROM questions q JOIN ({CREATED}) USING (id)""",
    ),
    "ingest_status_counts": (
        lambda t: ingest.status_counts(ingest.bulk_create(candidates(t))),
        CTE + f"SELECT count(*) FILTER (reason IS NULL) AS created, count(*) FILTER (reason IS NOT NULL) AS failed FROM ({CREATED})",
    ),
    "manifest_index": (
        lambda t: tables.manifest_index(t.questions.select(F.when(F.col("id") % 3 == 0, F.concat(F.lit("__MACOSX/"), "id", F.lit(".png"))).when(F.col("id") % 3 == 1, F.concat(F.lit("a/"), "id", F.lit(".PNG"))).otherwise(F.concat("id", F.lit(".webp"))).alias("path"))),
        CTE + """, w AS (SELECT CASE WHEN id % 3 = 1 THEN 'a/' || id || '.PNG' ELSE id || '.webp' END AS path, id || CASE WHEN id % 3 = 1 THEN '.PNG' ELSE '.webp' END AS name FROM questions WHERE id % 3 > 0)
          SELECT (row_number() OVER (ORDER BY path) - 1) || '-' || name AS id, path FROM w""",
    ),
    "batch_status_counts": (
        lambda t: ingest.batch_counts(ingest.bulk_create(candidates(t)).withColumnRenamed("status", "create_status").withColumns({"status": F.element_at(F.array(*[F.lit(x) for x in ("success", "error", "parsing", "pending")]), (F.col("id") % 5 % 4 + 1).cast("int")), "checked": F.col("id") % 3 != 0})),
        CTE + f""", i AS (SELECT id, reason, ['success', 'error', 'parsing', 'pending'][id % 5 % 4 + 1] AS status, id % 3 <> 0 AS checked FROM ({CREATED}))
          SELECT count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'error') AS error, count(*) FILTER (status = 'parsing') AS parsing, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (checked) AS checked,
            count(*) FILTER (status = 'success' AND checked AND reason IS NULL) AS created, count(*) FILTER (status = 'success' AND checked AND reason IS NOT NULL) AS failed FROM i""",
    ),
    "ids_and_times": (
        lambda t: ingest.started(t.attempt_list.select("player")).agg(F.count("*").alias("n"), F.count_distinct("id").alias("ids"), F.count_if(F.col("id").rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$")).alias("formed"), F.count_distinct("created_at").alias("times")),
        CTE + "SELECT count(*) AS n, count(*) AS ids, count(*) AS formed, CAST(1 AS BIGINT) AS times FROM attempt_list",
    ),
    "reset_and_seed": (
        seeded,
        CTE + "SELECT 'puzzle_types' AS name, CAST(id AS BIGINT) AS id, name AS label FROM types UNION ALL SELECT 'player_account', id, name FROM players UNION ALL SELECT 'puzzle_questions', id, title FROM questions",
    ),
    "bulk_patch_puzzles": (
        patched,
        CTE + """, q AS (SELECT *, CASE WHEN id % 8 = 3 THEN 'none' WHEN id % 4 = 0 THEN 'title' WHEN id % 4 = 2 THEN 'author' WHEN id % 8 = 1 THEN 'board' ELSE 'nothing' END AS patch FROM questions)
          SELECT id, CASE WHEN patch <> 'title' THEN title END AS title, CASE WHEN patch = 'author' THEN 'A' || id ELSE author END AS author,
          CASE WHEN patch = 'title' THEN 5 WHEN patch = 'board' AND id % 3 <> 0 THEN 2 ELSE difficulty END AS difficulty, CASE WHEN patch = 'board' AND id % 3 <> 0 THEN 3 ELSE width END AS width, CASE WHEN patch = 'board' AND id % 3 <> 0 THEN 2 ELSE height END AS height,
          CASE WHEN patch <> 'author' THEN src_collection END AS src_collection, CASE WHEN patch = 'board' AND id % 3 <> 0 THEN '{"cells":[[0,1,2],[3,-1,0]]}' ELSE '{"cells":[[0]]}' END AS canon_repr,
          CASE WHEN patch = 'board' AND id % 3 = 0 THEN 'range:cells' WHEN patch = 'nothing' THEN 'no fields to update' END AS reason FROM q
          UNION ALL SELECT -id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'puzzle not found' FROM questions WHERE id % 100 = 6""",
    ),
    "bulk_delete_puzzles": (
        deleted,
        CTE + """, used AS (SELECT DISTINCT question AS id FROM attempts)
          SELECT id, 'stays' AS state FROM questions WHERE id % 10 <> 3 OR id IN (SELECT id FROM used) UNION ALL
          SELECT id, 'blocked' FROM questions WHERE id % 10 = 3 AND id IN (SELECT id FROM used)""",
    ),
    "append_collections": (
        lambda t: ingest.append_collections(t.collections, t.types.select(F.when(F.col("id") != 2, F.col("name")).alias("name"), F.lit("").alias("publisher"), F.lit("x.png").alias("cover_src"), F.lit(None).cast("date").alias("publish_at"))),
        CTE + """SELECT CAST((SELECT max(id) FROM collections) + row_number() OVER (ORDER BY name) AS INTEGER) AS id, name, CAST(NULL AS VARCHAR) AS publisher, 'x.png' AS cover_src, CAST(NULL AS DATE) AS publish_at FROM types WHERE id <> 2""",
    ),
    "start_attempts": (
        lambda t: (lambda pair: pair[0].select("id", "player").join(pair[1].withColumnRenamed("attempt", "id"), "id").select("id", "player", "current_answer", "progress", "elapsed_seconds", "finished"))(
            ingest.start_attempts(t.attempt_list.select("id", "player", (F.col("id") % 100).alias("question"), F.when(F.col("id") % 2 == 0, "[1]").alias("answer"), F.col("created_at").alias("at")))
        ),
        CTE + "SELECT id, player, CASE WHEN id % 2 = 0 THEN '[1]' ELSE '{}' END AS current_answer, CAST(0 AS DOUBLE) AS progress, 0 AS elapsed_seconds, false AS finished FROM attempt_list",
    ),
    "apply_snapshots": (
        lambda t: ingest.apply_snapshots(t.attempt_list, t.snapshots),
        CTE + """SELECT a.id, player, a.created_at, coalesce(s.e, finished_at) AS finished_at FROM attempt_list a
          LEFT JOIN (SELECT attempt, max(created_at) AS e FROM snapshots WHERE finished GROUP BY ALL) s ON s.attempt = a.id""",
    ),
    "unlock_append": (
        lambda t: (lambda x: ingest.unlock_append(x.filter("player % 3 = 0"), x.unionByName(x)))(achieved(t, t.attempts)),
        CTE + f", {REACHED} SELECT player, achievement_id FROM reached WHERE player % 3 <> 0",
    ),
    "stream_latest_snapshot": (
        latest,
        CTE + "SELECT id, attempt, progress, elapsed_seconds, finished, created_at FROM snapshots QUALIFY row_number() OVER (PARTITION BY attempt ORDER BY created_at DESC, id DESC) = 1",
    ),
    "stream_unlocks": (unlocks, CTE + f", {REACHED_BY_FEED} SELECT player, achievement_id FROM reached"),
}
