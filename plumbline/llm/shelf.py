"""Tables in the cluster's shared folder, used to cut lineage.

The folder is the one named by ``spark.checkpoint.dir``.  Only where that is
unset, on a local master (tests), a temporary folder takes its place.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

BROADCAST_BYTES = 16 << 20  #: a side is broadcast only if its measured size is at most this


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    at = "file://" + tempfile.mkdtemp(prefix="plumbline-")
    spark.conf.set("spark.checkpoint.dir", at)
    return at


class Shelf:
    """Parquet tables that belong to one operator call; Spark removes them when the session ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/plumbline-{uuid.uuid4().hex}"
        self._made = 0
        self._paths: dict[int, str] = {}
        self._fs().deleteOnExit(self._path(self.root))

    def _path(self, at: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(at)

    def _fs(self):
        return self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def put(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and return the table read back."""
        self._made += 1
        at = f"{self.root}/{self._made}"
        df.write.parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        self._paths[id(out)] = at
        out._shelf_path = at
        return out

    def bytes(self, table: DataFrame) -> int:
        """Size on disk of a table made by ``put``."""
        return self._fs().getContentSummary(self._path(table._shelf_path)).getLength()

    def drop(self, table: DataFrame | None) -> None:
        """Delete a table that nothing will read again."""
        if table is not None:
            self._fs().delete(self._path(table._shelf_path), True)

    def small(self, table: DataFrame, expansion: int = 3) -> DataFrame:
        """The table with a broadcast hint if its measured size allows it, else with a shuffle-hash hint."""
        if self.bytes(table) * expansion <= BROADCAST_BYTES:
            return F.broadcast(table)
        return table.hint("shuffle_hash")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names derived from ``names`` that clash with no column of ``df``, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        got = f"__{name}"
        while got.lower() in taken:
            got = f"_{got}"
        taken.add(got.lower())
        out.append(got)
    return out
