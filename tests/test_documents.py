"""Numbers without one task, pairs without one broadcast, documents of unknown shape, second-tier checks, patches, restored values."""

import json

import pytest
from pyspark.sql import functions as F

from loomgrid.operators import answers, ingest, numbering, quality, registry, stats
from loomgrid.plans import registry as plans
from loomgrid.sources import documents
from loomgrid.sources.analog import Tables

DATA = "/root/testdata/sf0.001"


def test_a_million_new_collections_are_numbered_by_all_tasks(spark):
    have = spark.createDataFrame([(7, "x")], "id int, name string")
    rows = spark.range(1_000_000).select(F.format_string("n%07d", F.pmod(F.col("id") * 7919, F.lit(1_000_000))).alias("name"), F.lit("").alias("publisher"), F.lit(None).cast("string").alias("cover_src"), F.lit(None).cast("date").alias("publish_at"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        made = ingest.append_collections(have, rows.unionByName(rows.limit(5).withColumn("name", F.lit(""))))
        told = made.agg(F.count("*"), F.count_distinct("id"), F.min("id"), F.max("id"), F.count_if(F.col("id") != F.substring("name", 2, 7).cast("int") + 8), F.count("publisher")).first()
        assert tuple(told) == (1_000_000, 1_000_000, 8, 1_000_007, 0, 0)
        parts = numbering.numbered(rows, ["name"]).groupBy(F.spark_partition_id()).count().collect()
        assert len(parts) >= 4 and max(p["count"] for p in parts) < 500_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_numbers_of_ties_nulls_and_nothing(spark):
    rows = spark.createDataFrame([(None, 1), ("a", 2), ("a", 3), (None, 4), ("b", 5)], "name string, x int").repartition(3)
    got = sorted((r.k, r.name) for r in numbering.numbered(rows, ["name"]).collect())
    assert got == [(0, None), (1, None), (2, "a"), (3, "a"), (4, "b")]
    assert numbering.numbered(rows.limit(0), ["name"]).collect() == []
    assert ingest.append_collections(spark.createDataFrame([], "id int, name string"), spark.createDataFrame([("n", "p", None, None)], "name string, publisher string, cover_src string, publish_at date")).collect() == [(1, "n", "p", None, None)]


@pytest.mark.parametrize("limit", [100, 10, 3, 1])
def test_pairs_whatever_the_size(spark, limit):
    many, few = spark.range(7).withColumnRenamed("id", "a"), spark.range(10).withColumnRenamed("id", "b")
    made = numbering.every_pair(many, few, limit)
    assert sorted(map(tuple, made.collect())) == [(a, b) for a in range(7) for b in range(10)]
    if limit < 10:
        plan = made._jdf.queryExecution().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_stats_are_the_same_in_blocks(spark, monkeypatch):
    t = Tables(spark, DATA)
    every = lambda: sorted(map(tuple, stats.collection_stats(t.players, t.types, t.collections, t.questions, t.attempts).collect()))
    want = every()
    monkeypatch.setattr(stats, "every_pair", lambda a, b: numbering.every_pair(a, b, 20))
    assert every() == want


def test_key_paths(spark):
    docs = [(1, {"a": 1, "b": {"c": [1, {"d": None}], "e": "x"}}), (2, {"a": [[1, 2], [{"f": {}}]]}), (3, [1, {"g": 2}]), (4, 5)]
    rows = [(k, json.dumps(d)) for k, d in docs] + [(5, "{"), (6, None)]

    def walk(d, at="$"):
        inner = [(f"{at}.{k}", v) for k, v in d.items()] if isinstance(d, dict) else [(f"{at}[]", v) for v in d] if isinstance(d, list) else []
        return {p for p, v in inner} | {q for p, v in inner for q in walk(v, p)}

    from loomgrid.operators.graph import ensure_checkpoints

    df = spark.createDataFrame(rows, "board_id long, canon string")
    ensure_checkpoints(df)
    assert {(r.board_id, r.path) for r in documents.key_paths(df).collect()} == {(k, p) for k, d in docs for p in walk(d)}
    diff = documents.schema_key_diff(df.filter("board_id < 2"), df.filter("board_id = 2")).collect()
    assert {(r.path, r.only_a, r.only_b, r.n_a, r.n_b) for r in diff if r.path in ("$.a", "$.b.e", "$.a[][].f")} == {("$.a", False, False, 1, 1), ("$.b.e", True, False, 1, 0), ("$.a[][].f", False, True, 0, 1)}


def test_files_and_quarantine(spark, tmp_path):
    for name, text in {"good": '{"hints":[[1]]}', "blank": " \n", "bad": '{"hints":', "list": "[1]", "word": '"x"', "spaced": '\n {"a":1}\n'}.items():
        (tmp_path / f"{name}.json").write_text(text)
    boards, aside = documents.read_board_json(spark, str(tmp_path / "*.json"))
    short = lambda p: p.rsplit("/", 1)[1][:-5]
    assert {short(r.path): r.canon for r in boards.collect()} == {"good": '{"hints":[[1]]}', "spaced": '{"a":1}'}
    assert {short(r.path): r.reason for r in aside.collect()} == {"blank": "empty", "bad": "not JSON", "list": "not an object", "word": "not an object"}


def test_text_or_document(spark):
    rows = [(1, '{"a":[1,2]}'), (2, json.dumps('{"a":[1,2]}')), (3, json.dumps('{"a":')), (4, json.dumps("word")), (5, "null"), (6, "7")]
    df = spark.createDataFrame(rows, "id int, t string").select("id", documents.json_or_struct(F.parse_json("t")).alias("v"))
    got = {r.id: r.s for r in df.select("id", F.to_json("v").alias("s")).collect()}
    assert got == {1: '{"a":[1,2]}', 2: '{"a":[1,2]}', 3: None, 4: None, 5: "null", 6: "7"}


NINE = [[0] * 9] * 9
FLAT = {"cells": [[0, 1], [1, 0]]}
BORDERED = FLAT | {"grids": {"h": [[0, 1]], "v": [[0], [1]]}}
SLALOM = FLAT | {"start": {"row": 1, "col": 1}, "gateCount": 1, "gates": [{"orientation": "h", "line": 0, "from": 0, "to": 1, "number": None}]}
SECOND = [
    (1, {"hints": NINE}, ""), (1, {"hints": NINE[:8]}, "shape"), (1, {"hints": [*NINE[:8], [10] + [0] * 8]}, "range"), (2, {"subboards": [{"hints": NINE}]}, ""), (2, {"subboards": [{"hints": NINE}, {"hints": [[1]]}]}, "shape"),
    (3, BORDERED, ""), (3, BORDERED | {"cells": [[0, 1], [1]]}, "ragged"), (3, BORDERED | {"cells": [[0, 5], [1, 0]]}, "range"), (3, BORDERED | {"grids": {"h": [[0]], "v": [[0], [2]]}}, "h,v"), (3, {"cells": [[1]], "grids": {"h": [], "v": [[]]}}, "small"),
    (4, {"cells": [[[0, 1], [1, 0]], [[0, 0], [1, 3]]]}, ""), (4, {"cells": [[[0, 1], [2, 0]], [[0, 0], [1, 3]]]}, "range"), (4, {"cells": [[[0, 1], [1, -1]], [[0, 0], [1]]]}, "range"), (5, {"cells": [[3, -1]]}, ""), (5, {"cells": [[4]]}, "range"),
    (6, {"rowClues": [[0]], "colClues": [[1, 2]]}, ""), (6, {"rowClues": [[]], "colClues": [[-1]]}, "shape,range"), (7, {"cells": [[2, 0], [1]]}, ""), (7, {"cells": [[3]]}, "range"), (8, {"cells": [[-4, 99]]}, ""), (8, {"cells": [[-5]]}, "range"),
    (9, BORDERED, ""), (9, BORDERED | {"cells": [[0, -1], [1, 0]]}, "range"), (10, SLALOM, ""), (10, SLALOM | {"start": {"row": 2, "col": 0}}, "start"), (10, SLALOM | {"gateCount": 0}, "gateCount"),
    (10, SLALOM | {"gates": [{"orientation": "x", "line": 0, "from": 0, "to": 1, "number": 1}]}, "gates"), (10, SLALOM | {"gates": [{"orientation": "v", "line": 0, "from": 2, "to": 1, "number": 1}]}, "gates"), (10, SLALOM | {"cells": [[0, 2], [0, 0]]}, "range"),
    (11, {"cells": [[-1, 5]]}, ""), (11, {"cells": [[-1], [0, 1]]}, "ragged"), (11, {"cells": [[6]]}, "range"), (12, {}, "unknown"), (5, {}, "unreadable"), (1, {"hints": "x"}, "unreadable"), (5, {"cells": [[1.5]]}, "range"),
]


def test_second_tier(spark):
    df = spark.createDataFrame([(k, kind, json.dumps(doc)) for k, (kind, doc, _) in enumerate(SECOND)] + [(900, 5, None), (901, 5, "{")], "k int, kind int, canon string")
    got = {r.k: ",".join(r.reasons) for r in df.select("k", quality.validate_second(F.col("kind"), F.col("canon")).alias("reasons")).collect()}
    assert got == {k: want for k, (_, _, want) in enumerate(SECOND)} | {900: "unreadable", 901: "unreadable"}


def test_patches_are_validated_and_measured(spark):
    have = spark.createDataFrame([(k, 5, "t", "a", 1, 9, 9, 4, "{}") for k in range(8)], "id long, puzzle_type int, title string, author string, difficulty int, width int, height int, src_collection int, canon_repr string")
    patches = [(0, '{"title":"n"}'), (1, '{"canonRepr":{"cells":[[1,2,3]]}}'), (2, '{"title":"n","canonRepr":{"cells":[[9]]}}'), (3, "{}"), (4, '{"width":3}'), (5, '{"src_collection":0,"author":""}'), (6, "not JSON"), (99, '{"title":"n"}')]
    now, refused = ingest.bulk_patch(have, spark.createDataFrame(patches, "id long, patch string"))
    got = {r.id: (r.title, r.author, r.width, r.height, r.src_collection, r.canon_repr) for r in now.collect()}
    plain = ("t", "a", 9, 9, 4, "{}")
    assert got == {k: plain for k in range(8)} | {0: ("n", *plain[1:]), 1: ("t", "a", 3, 1, 4, '{"cells":[[1,2,3]]}'), 5: ("t", None, 9, 9, None, "{}")}
    assert {r.id: r.reason for r in refused.collect()} == {2: "range:cells", 3: "no fields to update", 4: "no fields to update", 6: "no fields to update", 99: "puzzle not found"}


def test_restored_values_are_those_that_were_set(spark):
    """restore(extract(x)) = x for all kinds but the hints of type 1, the black cells of type 11 and places beyond the board, which type 4 has here."""
    games = plans.games(Tables(spark, DATA)).persist()
    back = {(r.board_id, r.layer, r.r, r.c, r.v) for r in registry.restore(games).collect()}
    valid = games.filter("puzzle_type <> 77 and board_id % 29 <> 3")
    given = {(r.board_id, r.layer, r.r, r.c, r.v) for r in answers.value_rows(valid.select("board_id", "values")).collect()}
    assert back <= given
    lost = {r.board_id for r in spark.createDataFrame([(x[0],) for x in given - back] or [(0,)], "board_id long").distinct().collect()}
    kinds = {r.board_id: r.puzzle_type for r in valid.select("board_id", "puzzle_type").collect()}
    assert {kinds[b] for b in lost if b in kinds} <= {1, 4, 11}
    games.unpersist()


def test_games_of_no_kind_and_broken_documents(spark):
    games = spark.createDataFrame([(1, 5, '{"cells":[[3]]}', {"h:0,0": 1, "h:1,0": 1, "v:0,0": 1}), (2, 99, "{}", {}), (3, 5, "{", {}), (4, None, None, None), (5, 5, '{"cells":[[9]]}', {}), (6, 11, '{"cells":[[0]]}', None)], "board_id long, puzzle_type int, canon string, values map<string,int>")
    got = {r.board_id: (r.reasons, r.progress, r.passed) for r in registry.evaluate(games).collect()}
    assert got == {1: ("", 100.0, False), 2: ("type:unknown", 0.0, False), 3: ("type:document", 0.0, False), 4: ("type:unknown", 0.0, False), 5: ("range:cells", 0.0, False), 6: ("", 100.0, True)}
