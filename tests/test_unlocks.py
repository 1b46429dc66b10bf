"""Achievements of the write job and of the feed count completed collections, too."""

from types import SimpleNamespace

from pyspark.sql import functions as F

from loomgrid.operators import stats
from loomgrid.plans import writes
from loomgrid.sources.analog import Tables
from loomgrid.streaming import feeds

DATA = "/root/testdata/sf0.001"


def finished(t, players):
    """Attempts of ``players`` that finish all six questions of collection 1 twice."""
    twice = t.questions.filter("id div 6 = 1").select(F.col("id").alias("question"), F.explode(F.array(F.lit(1), F.lit(2))).alias("day"))
    every = twice.join(t.spark.createDataFrame([(p,) for p in players], "player long"))
    return every.select("player", F.col("question").cast("long").alias("question"), F.make_date(F.lit(2020), F.lit(1), "day").cast("timestamp_ntz").alias("finished_at"))


def test_unlock_append_gives_collections(spark):
    t = Tables(spark, DATA)
    made = SimpleNamespace(spark=spark, questions=t.questions, types=t.types, attempts=finished(t, [1, 3]))
    rows = writes.QUERIES["unlock_append"][0](made).collect()
    assert {r.player for r in rows if r.achievement_id == "collection_complete_1"} == {1}


FINISH = "player long, question long, puzzle_type int, difficulty int, collection long, size long"


def test_feed_gives_collections(spark, tmp_path):
    t = Tables(spark, DATA)
    inside = t.questions.select(F.col("id").alias("question"), "puzzle_type", "difficulty").withColumns({"collection": F.expr("question div 6"), "size": F.lit(6).cast("long")})
    finished(t, [1, 2]).join(inside, "question").select(*[c.split()[0] for c in FINISH.split(", ")]).coalesce(1).write.parquet(f"{tmp_path}/in")
    made = feeds.stream_unlocks(spark.readStream.schema(FINISH).parquet(f"{tmp_path}/in"), stats.achievement_definitions(spark, t.types), f"file://{tmp_path}/state")
    assert {r.player for r in made.collect() if r.achievement_id == "collection_complete_1"} == {1, 2}


def test_feeds_go_on_after_a_restart(spark, tmp_path):
    schema = "id long, attempt long, progress double, elapsed_seconds int, finished boolean, created_at timestamp_ntz"

    def feed(rows, name):
        spark.createDataFrame(rows, schema.replace("created_at timestamp_ntz", "at string")).selectExpr("id", "attempt", "progress", "elapsed_seconds", "finished", "cast(at as timestamp_ntz) as created_at").coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        return {r.attempt: r.id for r in feeds.stream_latest_snapshot(stream, f"file://{tmp_path}/state").collect()}

    assert feed([(k, k % 3, 0.1, 1, False, f"2024-01-01 00:00:{k:02d}") for k in range(9)], "a") == {0: 6, 1: 7, 2: 8}
    assert feed([(20, 1, 0.2, 2, False, "2024-01-02 00:00:00"), (21, 9, 0.2, 2, False, "2024-01-02 00:00:00"), (22, 2, 0.2, 2, False, "2023-01-02 00:00:00")], "b") == {0: 6, 1: 20, 2: 8, 9: 21}

    three = spark.createDataFrame([("three", "total", None, 3)], "id string, metric string, key int, threshold int")

    def unlocks(rows, name):
        spark.createDataFrame([(p, q, 1, 1, None, None) for p, q in rows], FINISH).coalesce(1).write.parquet(f"{tmp_path}/on/{name}")
        stream = spark.readStream.schema(FINISH).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/on")
        return sorted(r.player for r in feeds.stream_unlocks(stream, three, f"file://{tmp_path}/unlocks").collect())

    assert unlocks([(1, 1), (1, 2), (2, 1), (2, 2), (2, 3)], "a") == [2]
    assert unlocks([(1, 3), (2, 4), (3, 1)], "b") == [1, 2]


def test_batches_read_neither_history_nor_old_versions(spark, tmp_path):
    """Whatever the number of batches: rows read and players loaded are those of the batch, two versions of a bucket and two manifests stay."""
    import glob

    wanted = spark.createDataFrame([(f"t{n}", "total", None, n) for n in (1, 2, 5, 9)] + [("s", "superhard", None, 3), ("k2", "type", 2, 4)], "id string, metric string, key int, threshold int")
    rows = [(p, b, b % 3, b % 5 + 1, None, None) for b in range(10) for p in (b % 4, 10, 10)]
    for b in range(10):
        spark.createDataFrame(rows[3 * b : 3 * b + 3], FINISH).coalesce(1).write.parquet(f"{tmp_path}/in/b{b}")
    seen = []
    from pyspark.sql.streaming import StreamingQueryListener

    class Listener(StreamingQueryListener):
        def onQueryStarted(self, event): ...

        def onQueryTerminated(self, event): ...

        def onQueryProgress(self, event):
            p = event.progress
            seen.append((p.sources[0].numInputRows, p.stateOperators[0].numRowsUpdated if p.stateOperators else 0))

    listener = Listener()
    spark.streams.addListener(listener)
    stream = spark.readStream.schema(FINISH).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    made = sorted((r.player, r.achievement_id) for r in feeds.stream_unlocks(stream, wanted, f"file://{tmp_path}/state").collect())
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    spark.streams.removeListener(listener)
    assert [s for s in seen if s[0]] == [(3, 2)] * 10
    flags = {}
    for p, q, kind, difficulty, *_ in rows:
        flags.setdefault(p, {})[q] = (kind, difficulty)
    want = []
    for p, own in flags.items():
        want += [(p, f"t{n}") for n in (1, 2, 5, 9) if len(own) >= n]
        want += [(p, "s")] if sum(d == 5 for _, d in own.values()) >= 3 else []
        want += [(p, "k2")] if sum(k == 2 for k, _ in own.values()) >= 4 else []
    assert made == sorted(want)

    schema = feeds.SNAPSHOT
    for b in range(6):
        spark.createDataFrame([(b * 10 + k, k, 0.1 * b, b, False, f"2024-01-0{b + 1} 00:00:00") for k in range(3)], schema.replace("created_at timestamp_ntz", "at string")).selectExpr("id", "attempt", "progress", "elapsed_seconds", "finished", "cast(at as timestamp_ntz) as created_at").coalesce(1).write.parquet(f"{tmp_path}/snap/b{b}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/snap")
        got = feeds.stream_latest_snapshot(stream, f"file://{tmp_path}/latest")
        assert {r.attempt: r.id for r in got.collect()} == {k: b * 10 + k for k in range(3)}
        assert len(glob.glob(f"{tmp_path}/latest/latest/manifest/number=*")) <= 2
        assert len(glob.glob(f"{tmp_path}/latest/latest/v*/bucket=*")) <= 2 * 3


def test_late_and_repeated_snapshots(spark, tmp_path):
    schema = feeds.SNAPSHOT

    def feed(rows, name):
        spark.createDataFrame(rows, "id long, attempt long, at string").selectExpr("id", "attempt", "0.5D as progress", "1 as elapsed_seconds", "false as finished", "cast(at as timestamp_ntz) as created_at").coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        return {r.attempt: (r.id, str(r.created_at)[:10]) for r in feeds.stream_latest_snapshot(stream, f"file://{tmp_path}/state", "2 days").collect()}

    assert feed([(1, 1, "2024-01-10"), (1, 1, "2024-01-10"), (2, 2, "2024-01-09")], "a") == {1: (1, "2024-01-10"), 2: (2, "2024-01-09")}
    # An id that comes again, changed, is the one that is known; a row within two days counts, one later than that doesn't.
    assert feed([(1, 1, "2024-01-11"), (3, 3, "2024-01-09"), (4, 4, "2024-01-01")], "b") == {1: (1, "2024-01-10"), 2: (2, "2024-01-09"), 3: (3, "2024-01-09")}
