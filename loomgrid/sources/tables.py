"""Reading and writing the catalogue's tables, and a folder that all executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the tables as they are stored; passwords are dropped on ingest.
SCHEMAS = {
    "puzzle_types": "id int, name string, rule string",
    "puzzle_collections": "id int, name string, publisher string, cover_src string, publish_at date",
    "player_account": "id int, name string, role string",
    "puzzle_questions": "id string, puzzle_type int, title string, author string, difficulty int, width int, height int, canon_repr string, src_collection int, created_at timestamp, updated_at timestamp",
    "player_attempt": "id string, player int, question string, created_at timestamp, finished_at timestamp",
    "player_attempt_snapshot": "id string, attempt string, current_answer string, progress double, elapsed_seconds int, finished boolean, created_at timestamp",
    "player_achievement": "id int, player int, achievement_id string, unlocked_at timestamp",
}
IMAGE = r"\.(png|jpe?g|webp)$"
MANIFEST_SIZE = 50


def load(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All tables below ``folder``; only the columns that a query uses are read."""
    return {name: spark.read.schema(schema).parquet(f"{folder}/{name}") for name, schema in SCHEMAS.items()}


def load_jdbc(spark: SparkSession, url: str, name: str, **options: str) -> DataFrame:
    """One table from a database; filters and columns are pushed to it."""
    columns = [c.split()[0] for c in SCHEMAS[name].split(", ")]
    return spark.read.format("jdbc").options(url=url, dbtable=name, **options).load().select(*columns)


def read_boards(spark: SparkSession, paths: str) -> DataFrame:
    """(path, canon): one board document per file."""
    return spark.read.text(paths, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("canon"))


def images(files: DataFrame) -> DataFrame:
    """(path, name) of the images of a drop, without hidden files."""
    name = F.element_at(F.split("path", "/"), -1)
    wanted = files.filter(~F.col("path").contains("__MACOSX/") & ~name.startswith(".") & F.lower(name).rlike(IMAGE))
    return wanted.select("path", name.alias("name"))


def manifest_index(files: DataFrame) -> DataFrame:
    """(id, path): all images of a drop, numbered by path."""
    from loomgrid.operators.numbering import numbered

    return numbered(images(files), ["path"]).select(F.concat_ws("-", "k", "name").alias("id"), "path")


def image_manifest(files: DataFrame, limit: int = MANIFEST_SIZE) -> DataFrame:
    """(id, path, truncated): images of a drop (path) without hidden files, numbered, the first ``limit``.

    The cut is part of the drop's contract; ``truncated`` tells that there were more.
    """
    from pyspark.sql import Window

    first = images(files).orderBy("path").limit(limit + 1)
    numbered = first.withColumn("k", F.row_number().over(Window.orderBy("path")) - 1)  # limit + 1 rows
    more = F.max("k").over(Window.partitionBy()) >= limit
    return numbered.withColumn("truncated", more).filter(F.col("k") < limit).select(F.concat_ws("-", "k", "name").alias("id"), "path", "truncated")


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length) of the files below ``folder``; contents aren't read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that driver and executors see; only a local session that names none gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="loomgrid-")
        spark.conf.set("spark.checkpoint.dir", root)
    root = root if ":/" in root else "file://" + os.path.abspath(root)
    return f"{root.rstrip('/')}/loomgrid/{name}-{uuid.uuid4().hex[:12]}"
