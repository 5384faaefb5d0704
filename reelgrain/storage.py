"""Reading input tables and keeping intermediate results in the cluster's shared folder."""

from __future__ import annotations

import functools
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_made: ContextVar[list[str] | None] = ContextVar("tables of the running query", default=None)
_left: set[str] = set()
_own: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; only where that is unset (local tests) a temporary one is made, one per application."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
        if context_dir.isDefined():
            return context_dir.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        # the setting can't be changed in a running session, so the folder is remembered here
        folder = _own.get(app := spark.sparkContext.applicationId)
        if folder is None:
            folder = _own[app] = tempfile.mkdtemp(prefix="reelgrain-")
            fs, p = _file_system(spark, folder)
            fs.deleteOnExit(p)
    return folder


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def materialize(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    Cuts the lineage, survives the loss of executors, and unlike checkpoint() keeps columns compressed
    and prunable. The table is deleted by drop(), at the end of a scoped() query whose result doesn't read it, by
    release(), or when the application ends, whichever comes first.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, p = _file_system(spark, path)
    fs.deleteOnExit(p)
    _left.add(path)
    if (made := _made.get()) is not None:
        made.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    fs, p = _file_system(spark, path)
    fs.delete(p, True)
    fs.cancelDeleteOnExit(p)
    _left.discard(path)


def drop(*tables: DataFrame) -> None:
    """Delete tables that materialize() gave and that nothing reads any more."""
    for t in tables:
        if path := getattr(t, "_table", None):
            _delete(t.sparkSession, path)


def scoped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, after which only those of its intermediate tables are left that its result still reads."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made: list[str] = []
        token = _made.set(made)
        result = None
        try:
            result = query(spark, sf_dir)
        finally:
            _made.reset(token)
            here = [p for p in made if p in _left]
            read = "\n".join(result.inputFiles()) if result is not None and here else ""
            for path in here:
                if path.rsplit("/", 1)[1] not in read:
                    _delete(spark, path)
        return result

    return run


def release(spark: SparkSession) -> None:
    """Delete all intermediate tables; for long sessions, once the results have been read."""
    for path in list(_left):
        _delete(spark, path)
