"""Helpers that the operators of this subpackage share.

Intermediate tables are Parquet in the folder that the cluster names in
``spark.checkpoint.dir``: a lost executor then costs no more than the tasks
that read them.
"""

from __future__ import annotations

import json
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contracts: space and \t \n \v \f \r.
SPACES = " \t\n\x0b\x0c\r"
#: The same as a regular expression for Java and for DuckDB.
SPACE_RE = r"[\x20\x09-\x0D]+"


#: Removes a query's shuffle files when it is done; a query that runs again makes them anew.  Set once for a session.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """The shared folder; only a local session that names none gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root if ":/" in root else "file://" + os.path.abspath(root)


class Workspace:
    """The tables of one run: a database of its own whose place is a fresh folder below the shared one."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.tables = spark, []
        self.database = f"{name}_{uuid.uuid4().hex[:12]}".replace("-", "_")
        self.path = f"{shared_root(spark).rstrip('/')}/loomgrid/{self.database}"
        spark.conf.set(_CLEAN, "true")
        spark.sql(f"CREATE DATABASE {self.database} LOCATION '{self.path}'")

    def _name(self, name: str) -> str:
        return f"{self.database}.{name.replace('-', '_')}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return it as read again, so that lineage ends here."""
        df.write.format("parquet").option("compression", "zstd").saveAsTable(self._name(name))
        self.tables.append(name)
        return self.read(name)

    def read(self, name: str) -> DataFrame:
        return self.spark.table(self._name(name))

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        for name in names:
            self.spark.sql(f"DROP TABLE {self._name(name)}")
            self.tables.remove(name)

    def finish(self, df: DataFrame) -> DataFrame:
        """Write the run's result and delete every other table."""
        out = self.table(df, "result")
        self.drop(*[t for t in self.tables if t != "result"])
        return out


def partitions(spark: SparkSession, least: int = 1) -> int:
    """Number of shuffle partitions that the session asks for."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def lookup(values: list, at: Column, kind: str = "bigint") -> Column:
    """``values[at]`` from a literal array of bounded length."""
    return F.get(F.from_json(F.lit(json.dumps(values)), f"array<{kind}>"), at)
