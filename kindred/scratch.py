"""Durable intermediate tables.

Iterative operators cut their lineage by writing each state as a table in the shared folder that the cluster names in
``spark.checkpoint.dir``; a lost executor then costs a re-read, never a recomputation of all earlier rounds.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
import warnings

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The shared folder: ``spark.checkpoint.dir``, else a checkpoint folder set by the caller, else (local master only) a temporary one."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    context = spark.sparkContext._jsc.sc().getCheckpointDir()
    if context.isDefined():
        return context.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    key = spark.sparkContext.applicationId
    if key not in _LOCAL:
        _LOCAL[key] = "file://" + tempfile.mkdtemp(prefix="kindred-")
    return _LOCAL[key]


class Scratch:
    """Tables of one operator run. ``cut`` writes and reads back, ``drop`` deletes what a later state replaced."""

    def __init__(self, spark: SparkSession, label: str = "run"):
        self.spark = spark
        self.root = f"{shared_root(spark)}/kindred-{label}-{uuid.uuid4().hex}"
        self._n = 0
        atexit.register(self.clear)

    def cut(self, df: DataFrame, by: str | None = None) -> DataFrame:
        """Write df, with a folder a value of the column ``by`` if given, and return a DataFrame over what was written."""
        self._n += 1
        path = f"{self.root}/{self._n:04d}"
        (df.write.partitionBy(by) if by else df.write).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def kept(self, df: DataFrame) -> DataFrame:
        """df itself if it is a written table, else what ``cut`` makes of it; columns without a type, which no file holds, are added again."""
        if getattr(df, "_scratch_path", None):
            return df
        void = [c for c, kind in df.dtypes if kind == "void"]
        if not void:
            return self.cut(df)
        out = self.cut(df.drop(*void))
        path, out = out._scratch_path, out.withColumns({c: F.lit(None) for c in void}).select(*df.columns)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame | None) -> None:
        for table in tables:
            path = getattr(table, "_scratch_path", None)
            if path:
                self._delete(path)

    def clear(self) -> None:
        """Delete all tables of the run; after the session's end the cluster's own cleaning has to do it."""
        context = self.spark.sparkContext
        if context._jsc is None:
            return
        try:
            if not context._jsc.sc().isStopped():
                self._delete(self.root)
        except (Py4JError, OSError) as error:
            warnings.warn(f"could not delete {self.root}: {error}", RuntimeWarning, stacklevel=2)

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
